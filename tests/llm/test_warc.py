import hashlib

from balance_spark.llm import warc
from balance_spark.llm.common import new_folder

LONG = "<p>é語\r\nWARC/1.1\r\n\r\n</p>" * 60


def test_round_trip(spark):
    pages = [
        (1, "http://a/b c\nd", LONG), (2, None, LONG), (9, "http://x", LONG), (9, "http://y", LONG),
        (3, "http://s", "short"), (4, "http://s", "short"), (5, "u", None), (6, "u", ""),
        (None, "u", LONG), (7, "u", "z" * 3_000_000),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    table = table.selectExpr("*", "'x' AS record", "1 AS chunk", "'y' AS digest")
    files = warc.write_archives(table, new_folder(spark, "warc-test"), chunk_bytes=1000)
    got = warc.read_records(files, chunk_bytes=700).collect()
    assert len(got) == len(pages)
    rows = sorted([(r[0], r[2], r[3], r[4], r[5]) for r in got], key=repr)
    want = []
    for page, _, html in pages:
        data = (html or "").encode()
        old = html == LONG and page in (1, 2)
        want.append(
            (page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if old else "response", 9 if old else None)
        )
    assert rows == sorted(want, key=repr)
    assert {r["url"] for r in got} >= {"http://a/b%20c%0Ad", None}
    assert len({r["record_id"] for r in got}) == len(pages)
    chunks = warc.read_chunks(files, chunk_bytes=700).collect()
    whole = {}
    for c in sorted(chunks, key=lambda c: (c["record_id"], c["chunk"])):
        whole[c["record_id"]] = whole.get(c["record_id"], b"") + bytes(c["data"])
        assert c["digest_so_far"] == hashlib.sha1(whole[c["record_id"]]).hexdigest()
        assert len(c["data"]) <= 700
    assert "z" * 3_000_000 in {w.decode() for w in whole.values()}


def test_empty(spark):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write_archives(table, new_folder(spark, "warc-test"))
    assert files.count() == 0 and warc.read_records(files).count() == 0


def test_chunks_make_up_every_payload(spark):
    """Cut by bytes, also inside characters, over pieces of 64 chunks."""
    texts = ["é" * 1000, "a", "語" * 333 + "x", "y" * 64 * 7, "z" * (64 * 7 + 1), "ab" * 5000]
    table = spark.createDataFrame(list(enumerate(texts)), "record long, html string")
    held = {}
    for record, chunk, data in sorted(map(tuple, warc._chunks(table, 7).collect())):
        assert chunk == len(held.setdefault(record, [])) and 0 < len(data) <= 7
        held[record].append(bytes(data))
    assert {k: b"".join(v).decode() for k, v in held.items()} == dict(enumerate(texts))


def test_time_grows_with_the_payload(spark):
    """Four times the payload takes no more than some eight times as long."""
    import time

    def seconds(size):
        table = spark.range(1).selectExpr("id AS record", f"repeat('é23456789012345 ', {size >> 4}) AS html")
        start = time.time()
        warc._chunks(table, 1 << 18).selectExpr("sum(octet_length(data))").collect()
        return time.time() - start

    seconds(1 << 20)
    assert seconds(1 << 26) < 8 * seconds(1 << 24) + 2
