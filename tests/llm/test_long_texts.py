"""Very long texts, and tables with everything odd at once, through operators and stages."""

import random

import corpus_pipeline
import pytest

from balance_spark.llm import chat, decontam, linededup, simhash, suffixes

FOLDER = "/root/testdata/sf0.001"
#: About 1.5 MB of words on one line.
LONG = " ".join(f"w{random.Random(1).randrange(10**5)}x{k}" for k in range(100_000))


@pytest.fixture
def long_docs(documents):
    half = LONG[: len(LONG) // 2].rsplit(" ", 1)[0]
    changed = LONG.replace("x50000", "y50000")
    return documents((1, LONG), (2, changed), (3, half), (4, "short text"), (5, LONG))


def test_long_texts_are_near_copies(long_docs):
    parts = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(long_docs).collect()}
    assert parts[1] == parts[2] == parts[5] == 1 and parts[4] == 4
    assert {r["doc_id"] for r in simhash.keep_one(long_docs).collect()} == {1, 3, 4}


def test_long_lines_go(long_docs):
    gone = {(r["doc"], r["line"], r["copy"]) for r in linededup.removed_lines(long_docs).collect()}
    assert gone == {(2, 0, False), (5, 0, True)}


def test_long_runs_are_found(long_docs):
    spans = {}
    for r in suffixes.repeated_spans(long_docs).collect():
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    assert spans[1] == spans[5] == [(0, 100_000)] and 4 not in spans
    with pytest.raises(ValueError):
        suffixes.repeated_spans(long_docs, min_words=74)


def test_items_are_found_at_the_end_of_long_texts(spark, documents):
    item = "the quick brown fox jumps over the lazy dog and then some more"
    docs = documents((1, f"{LONG} {item}"), (2, LONG))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    (found,) = decontam.contaminations(docs, bench).collect()
    assert (found["doc_id"], found["item_id"], found["distance"]) == (1, 7, 0)


def test_long_turns_are_formatted_whole(spark):
    said = spark.createDataFrame([(1, 0, "user", LONG)], "conv_id long, turn int, role string, text string")
    ((_, turns),) = chat.format_turns(said).collect()
    assert LONG in turns[0]


def test_stages_take_odd_tables(spark, documents, clashing):
    rng = random.Random(3)

    def text(n):
        return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(n))

    same = text(60)
    rows = [(k, text(40)) for k in range(12)]
    rows += [(20, same), (21, same), (None, same), (None, text(30)), (20, text(30)), (30, None), (31, ""),
             (32, " \n\t"), (33, "one"), (34, text(30) + "\n" + same), (35, text(30_000))]
    docs = clashing(documents(*rows))
    docs = docs.unionByName(docs.filter("doc_id = 3")).withColumn("lang", docs["lang"])
    held = docs.selectExpr(*[f"IF(doc_id = 7, NULL, {c}) AS {c}" if c not in ("doc_id", "text") else c for c in docs.columns])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, held, FOLDER)
        assert left.columns == docs.columns, name
        before, after = held.count(), left.count()
        assert 12 <= after <= before, name
        assert stage(spark, held.filter("false"), FOLDER).count() == 0, name
        held = left.checkpoint()
    packed = corpus_pipeline.STAGES[-1][1](spark, held, FOLDER)
    assert sum(r["n_tokens"] for r in packed.collect()) == sum(
        len((r["text"] or "").split()) for r in held.collect()
    )
    texts = [r["text"] for r in held.collect()]
    assert sum(same in (t or "") for t in texts) == 1
