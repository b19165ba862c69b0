"""WARC archives written and read as streams of chunks.

A page's payload is cut into ``(record, chunk number)`` rows before it is shuffled, so that
an oversized page never has to be whole in one writer or reader: both hold one chunk and the
state of a digest that is carried from chunk to chunk.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balance_spark.llm.common import durable, new_folder, task_file

#: Headers of the HTTP message in front of every payload.
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``(page_id, digest, refers_to)`` of the pages that revisit another.

    Only identifiers and digests are shuffled.  The rows of a digest are joined to its one
    keeper over 16 salts, so that a digest with a third of all pages is spread.
    """
    light = pages.select("page_id", "digest", "bytes").filter(F.col("bytes") >= min_bytes)
    keeper = (
        light.groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    )
    salted = light.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(16)))
    return (
        salted.join(keeper, ["digest", "salt"])
        .filter("page_id < refers_to")
        .select("page_id", "digest", "refers_to")
        .distinct()
    )


def _chunks(pages: DataFrame, size: int) -> DataFrame:
    """``record, chunk, data``: the payloads in pieces of ``size`` bytes.

    Bytes are cut by their place, not counted off from the start as characters are.  A row that
    holds a payload is copied for each piece of it, so payloads are cut into pieces of 64 chunks
    first, and these into chunks.
    """

    def cut(table, data, step, name):
        last = F.ceil(F.octet_length(data) / F.lit(step)).cast("int") - 1
        # No payload is empty; the plain form would first ask so.
        dealt = table.select("*", F.posexplode_outer(F.sequence(F.lit(0), last)).alias(name, "at"))
        return dealt.withColumn("data", F.expr(f"substring({data}, at * {step} + 1, {step})")).drop("at")

    whole = pages.select("record", F.col("html").cast("binary").alias("whole"))
    pieces = cut(whole, "whole", 64 * size, "piece").select("record", "piece", F.col("data").alias("part"))
    return cut(pieces, "part", size, "within").select(
        "record", (F.col("piece") * 64 + F.col("within")).alias("chunk"), "data"
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    *,
    min_bytes: int = 1000,
    chunk_bytes: int = 1 << 18,
    file_bytes: int = 64 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write gzipped WARC files of ``pages (page_id, url, html)``; return ``(path, bytes)``.

    Every row becomes one record.  Of rows with equal payloads of at least ``min_bytes``
    that with the largest ``page_id`` is a response, those with smaller ones revisit it.
    A NULL payload is empty, a NULL url is left out, a NULL ``page_id`` never revisits and
    is never referred to, equal rows with the largest ``page_id`` are all responses; an
    empty table gives no file.  Other columns are not read.

    Files have about ``file_bytes`` of payload.  The returned table is already computed.
    """
    pages = pages.select(
        F.monotonically_increasing_id().alias("record"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha1(F.encode("html", "utf-8")), "bytes": F.octet_length("html")})
    total = pages.agg(F.sum("bytes")).first()[0] or 0
    kinds = decide(pages, min_bytes)
    head = (
        pages.drop("html")
        .join(kinds, ["page_id", "digest"], "left")
        .select(
            "record", F.lit(-1).alias("chunk"), "page_id", "url", "digest",
            F.col("bytes").cast("long").alias("bytes"), "refers_to",
            F.lit(None).cast("binary").alias("data"),
        )
    )
    body = _chunks(pages.filter("bytes > 0"), chunk_bytes).select(
        "record", "chunk",
        F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("bytes"),
        F.lit(None).cast("long").alias("refers_to"), "data",
    )
    files = max(1, -(-total // file_bytes), min(8, -(-total // (1 << 20))))
    rows = (
        head.unionByName(body)
        .repartition(int(files), "record")
        .sortWithinPartitions("record", "chunk")
    )

    def write(batches):
        batches = iter(batches)
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        filesystem, path = pafs.FileSystem.from_uri(folder)

        def fill(stream):
            writer = _RecordWriter(stream, date)
            held = batch
            while held is not None:
                for row in held.to_pylist():
                    writer.add(row)
                held = next(batches, None)
            writer.close()

        final, size = task_file(filesystem, path, ".warc.gz", fill)
        name = folder.rstrip("/") + "/" + final.rsplit("/", 1)[1]
        yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size]})

    return durable(rows.mapInArrow(write, "path string, bytes long"))


class _RecordWriter:
    """Puts head rows and chunk rows, in order, into gzip members of one record each."""

    def __init__(self, stream, date):
        self.stream, self.date = stream, date
        self.packer = self.digest = self.head = None

    def _put(self, data: bytes):
        self.stream.write(self.packer.compress(data))

    def add(self, row):
        if row["chunk"] < 0:
            self._finish()
            self._begin(row)
        elif self.head["refers_to"] is None:
            data = row["data"]
            self.digest.update(data)
            self._put(data)

    def _begin(self, row):
        self.head, self.digest = row, hashlib.sha1()
        self.packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        revisit = row["refers_to"] is not None
        own = base64.b32encode(bytes.fromhex(row["digest"])).decode()
        size = len(HTTP) + (0 if revisit else row["bytes"])
        lines = [
            "WARC/1.1",
            f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:x-page:{row['record']}>",
            f"WARC-Date: {self.date}",
            f"WARC-Payload-Digest: sha1:{own}",
            f"X-Payload-Length: {row['bytes']}",
            "Content-Type: application/http;msgtype=response",
            f"Content-Length: {size}",
        ]
        if row["page_id"] is not None:
            lines.append(f"X-Page-ID: {row['page_id']}")
        if row["url"] is not None:
            uri = "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in row["url"])
            lines.append(f"WARC-Target-URI: {uri}")
        if revisit:
            lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {row['refers_to']}"]
        self._put(("\r\n".join(lines) + "\r\n\r\n").encode() + HTTP)

    def _finish(self):
        if self.head is None:
            return
        whole = self.head["refers_to"] is not None
        if not whole and self.digest.hexdigest() != self.head["digest"]:
            raise ValueError(f"record {self.head['record']}: chunks do not make up the payload")
        self._put(b"\r\n\r\n")
        self.stream.write(self.packer.flush())

    def close(self):
        self._finish()


def _records(stream, chunk_bytes):
    """``(headers, chunks)`` of every record; chunks must be used up before the next one."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        left = int(headers["content-length"])
        while left:
            line = stream.readline()
            left -= len(line)
            if line in (b"\r\n", b""):
                break

        def chunks(left=left):
            while left:
                data = stream.read(min(left, chunk_bytes))
                if not data:
                    raise ValueError("the archive ends inside a record")
                left -= len(data)
                yield data

        yield headers, chunks()


def _read(files: DataFrame, spark: SparkSession, per_record, schema, columns, chunk_bytes):
    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                filesystem, inner = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with filesystem.open_input_stream(inner, compression=None) as raw, gzip.GzipFile(fileobj=raw) as f:
                    for headers, chunks in _records(f, chunk_bytes):
                        for row, weight in per_record(headers, chunks):
                            rows.append(row)
                            size += weight
                            if len(rows) >= 4096 or size >= 8 << 20:
                                yield _batch(rows, columns)
                                rows, size = [], 0
                if rows:
                    yield _batch(rows, columns)

    spread = files.select("path").repartition(max(1, min(files.count(), 10_000)), "path")
    return spread.mapInArrow(read, schema)


def _batch(rows, columns):
    cells = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(cells, columns)], names=[n for n, _ in columns]
    )


def _number(text):
    return None if text is None else int(text)


def read_records(files: DataFrame, *, chunk_bytes: int = 1 << 20) -> DataFrame:
    """One row per record of the archives in ``files (path)``.

    The digest and length of a response are those of the bytes that were read, chunk by
    chunk; those of a revisit, which has no payload of its own, are what its head states.
    """
    columns = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("record_id", pa.string()),
    ]

    def one(headers, chunks):
        digest, size = hashlib.sha1(), 0
        for data in chunks:
            digest.update(data)
            size += len(data)
        stated = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
        kind = headers["warc-type"]
        if kind == "revisit":
            size = int(headers["x-payload-length"])
        elif digest.hexdigest() != stated:
            raise ValueError(f"{headers['warc-record-id']}: payload and digest differ")
        yield (
            _number(headers.get("x-page-id")), headers.get("warc-target-uri"), size, stated,
            kind, _number(headers.get("x-refers-to-page-id")), headers["warc-record-id"],
        ), 200

    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, record_id string"
    )
    return _read(files, files.sparkSession, one, schema, columns, chunk_bytes)


def read_chunks(files: DataFrame, *, chunk_bytes: int = 1 << 20) -> DataFrame:
    """The payloads as rows ``(record_id, chunk, data, digest_so_far)``."""
    columns = [
        ("record_id", pa.string()), ("chunk", pa.int64()), ("data", pa.binary()),
        ("digest_so_far", pa.string()),
    ]

    def one(headers, chunks):
        digest = hashlib.sha1()
        for k, data in enumerate(chunks):
            digest.update(data)
            yield (headers["warc-record-id"], k, data, digest.copy().hexdigest()), len(data)

    schema = "record_id string, chunk long, data binary, digest_so_far string"
    return _read(files, files.sparkSession, one, schema, columns, chunk_bytes)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    files = write_archives(pages, new_folder(spark, "warc"))
    return read_records(files).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP8_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html,
           octet_length(encode(coalesce(html, ''))) AS n
    FROM pages
), k AS (
    SELECT html, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY html
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html AND n >= 1000
"""
