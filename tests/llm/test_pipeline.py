"""The stages of the pipeline, each against brute force on what the one before kept."""

import corpus_pipeline
from balance_spark.llm.common import stored
from balance_spark.llm.decontam import EditPlan, normalised
from test_decontam import contained
from test_linededup import brute_force
from test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, held = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        held.append(stored(stage(spark, held[-1], FOLDER), "stage"))
    raw, good, lines, near, clean, packed = [t.collect() for t in held]
    assert all(t.columns == columns for t in held[:-1])
    texts = {r["doc_id"]: r["text"] for r in raw}
    assert all(r["text"] == texts[r["doc_id"]] for r in good)

    gone = brute_force([(r["doc_id"], r["text"]) for r in good])
    want = {}
    for r in good:
        said = r["text"].split("\n")
        left = [x for k, x in enumerate(said) if (r["doc_id"], k) not in gone]
        if left:
            want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in lines} == want
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    named = plain_components({k: plain_fingerprint(t) for k, t in want.items()})
    assert {r["doc_id"] for r in near} == set(named.values())

    items = [normalised(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    plan = EditPlan()
    for r in near:
        own = normalised(r["text"])
        least = min(contained(i, own) - plan.edits(len(i)) for i in items)
        exact = any(contained(i, own) == 0 for i in items)
        kept = r["doc_id"] in {c["doc_id"] for c in clean}
        assert not exact or not kept
        assert kept or least <= 0
    assert sum(r["n_tokens"] for r in packed) == sum(len(r["text"].split()) for r in clean)
