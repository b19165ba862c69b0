import random

from pyspark.sql import functions as F

from balance_spark.llm import quality


def test_edges(documents, clashing, spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (7, None)], "doc_id long, quality int")
    docs = documents((1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f g h i j", None), (4, "x # %"), (None, "a"))
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(clashing(docs), labels).collect()}
    assert got[4, 10]["kept"] and not got[4, 10]["base_failed"]
    assert got[4, 3]["n_symbols"] == 2 and got[4, 3]["word_chars"] == 3
    assert got[1, 0]["base_failed"] and got[2, 0]["base_failed"] and got[3, 0]["base_failed"]
    kept = quality.keep_good(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and kept.count() == 1
    assert quality.judge(docs.filter("false"), labels).count() == 0
    assert quality.judge(docs, labels.filter("false")).count() == 6


def repeat_words(found):
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 5))
    return len(covered)


def test_repeats_match_brute_force(documents, spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["a b c d e " * 3, "x" * 50_000, "l\nl\n \n\nl", "z " * 20_000]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(documents(*enumerate(texts)), labels).collect()}
    for k, text in enumerate(texts[:-1]):
        assert got[k]["n_repeat_words"] == repeat_words(text.split()), text
    assert got[len(texts) - 1]["n_repeat_words"] == 20_000
    assert got[len(texts) - 2]["n_dup_lines"] == 2


def test_exact_tail(spark):
    import math

    cases = [(n, k) for n in (1, 50, 400, 3000) for k in (0, 1, 3, 10, 14) if k <= n]
    table = spark.createDataFrame(cases, "n long, k long").withColumn("level", F.lit(0.01))
    for row in table.withColumn("ok", quality.tail_within("k", "n", 0.005, "level")).collect():
        tail = sum(
            math.comb(row["n"], i) * 0.005**i * 0.995 ** (row["n"] - i) for i in range(row["k"] + 1)
        )
        assert row["ok"] == (tail <= 0.01)


def test_cutoffs_limit_the_loss(spark, documents):
    """Junk is cut where labels prove that good documents stay; a stratum with few labels
    keeps all."""
    rng = random.Random(2)
    plain = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(12))
    junk = lambda: " ".join(f"w{rng.randrange(9999)}$$$" for _ in range(12))
    rows = [(i, plain(), "en") for i in range(1500)]
    rows += [(i, junk(), "en") for i in range(1500, 1700)]
    rows += [(i, junk(), "de") for i in range(1700, 1720)]
    labels = spark.createDataFrame(
        [(i, int(i < 1500)) for i in range(1720)], "doc_id long, quality int"
    )
    kept = quality.judge(documents(*rows), labels).filter("kept").select("doc_id").collect()
    kept = {r[0] for r in kept}
    assert kept == set(range(1500)) | set(range(1700, 1720))
