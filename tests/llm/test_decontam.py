import random

from balance_spark.llm import decontam


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def contained(item, text):
    """The least edit distance of an item to a part of a text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"x{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"x{rng.randrange(10**6)}")
        elif len(words) > 1:
            del words[at]
    return words


def test_recall_and_exactness(spark, documents, clashing):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(400)}"
    items = [[word() for _ in range(rng.randrange(14, 60))] for _ in range(20)]
    rows, truth = [], set()
    for d in range(240):
        text = [word() for _ in range(rng.randrange(80))]
        if d % 4:
            item = rng.choice(items)
            text += edited(rng, item, rng.randrange(0, len(item) // 4)) + [word() for _ in range(30)]
        rows.append((d, "!  ".join(w.upper() for w in text)))
        for k, item in enumerate(items):
            if contained(item, text) <= int(0.2 * len(item)):
                truth.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    found = decontam.contaminations(clashing(documents(*rows)), clashing(bench)).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got <= truth
    assert len(got) >= 0.9 * len(truth)
    texts = dict(rows)
    for r in found:
        own = decontam.normalised(texts[r["doc_id"]])
        assert r["distance"] >= contained(items[r["item_id"]], own)
    exact = {(d, k) for d, k in truth if contained(items[k], decontam.normalised(texts[d])) == 0}
    assert exact <= got
    # In blocks, the same.
    plan = decontam.EditPlan(block_bytes=2000)
    again = decontam.contaminations(documents(*rows), bench, plan).collect()
    assert {(r["doc_id"], r["item_id"]) for r in again} <= truth
    assert len(again) >= 0.9 * len(truth)


def test_edges(spark, documents, clashing):
    bench = spark.createDataFrame(
        [(1, "one two three four five"), (2, "one two three four five"), (3, None), (4, "?!"), (None, "solo")],
        "item_id long, text string",
    )
    docs = documents((1, None), (2, ""), (3, "ONE, two three; four five."), (3, "solo"), (None, "solo"), (4, "one two three four"))
    found = decontam.contaminations(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in found}
    exact = {(3, 1, 0), (3, 2, 0), (3, None, 0), (None, None, 0)}
    assert exact <= got <= exact | {(4, 1, 1), (4, 2, 1)}  # one edit is found by chance
    left = decontam.without_contaminated(clashing(docs), bench)
    assert left.columns == clashing(docs).columns
    assert {1, 2} <= {r["doc_id"] for r in left.collect()} <= {1, 2, 4}
    assert decontam.contaminations(docs.filter("false"), bench).count() == 0
    assert decontam.contaminations(docs, bench.filter("false")).count() == 0
