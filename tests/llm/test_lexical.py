import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from balance_spark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [t.translate({k: k + 32 for k in range(65, 91)}) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    """Every document scored for every item."""
    held = [(d, plain_terms(t)) for d, t in docs]
    held = [(d, Counter(t), len(t)) for d, t in held if t]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    rows = []
    for item, text in items:
        scores = []
        for doc, c, n in held:
            m = 100 - 75 + 75 * n * count // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in plain_terms(text)
                if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort()
        rows += [(item, r, s[3], -s[0]) for r, s in enumerate(scores[:k], 1)]
    return sorted(rows, key=repr)


@pytest.fixture
def search(spark, documents):
    def run(docs, items, **options):
        table = spark.createDataFrame(items, "item_id long, text string, score string, term string")
        found = lexical.ranked(documents(*docs).withColumn("n", lexical.F.lit("x")), table, **options)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        return sorted((tuple(r) for r in found.collect()), key=repr)

    return lambda docs, items, **options: run(docs, [(*i, "", "") for i in items], **options)


def texts(rng, n, longest, size=300):
    def one():
        return " ".join(f"w{int(size * rng.random() ** 3)}" for _ in range(rng.randrange(longest)))

    return [one() for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"chunk": 64, "leaf": 4}, {"leaf": 1}, {"block_bytes": 500}])
def test_equals_brute_force(search, options):
    rng = random.Random(4)
    docs = list(enumerate(texts(rng, 700, 60)))
    docs += [(1000 + k, docs[k % 3][1]) for k in range(250)]  # a third are copies: ties
    items = list(enumerate(texts(rng, 25, 30))) + [(90, "w0 w0 w0"), (91, "nothing")]
    assert search(docs, items, **options) == plain(docs, items)


def test_edges(search):
    docs = [
        (1, "Ärger ärger a-b_c"), (1, "Ärger ärger a-b_c"), (None, "a b C"), (None, "a b C"), (2, None),
        (3, ""), (4, " .,;! "), (5, "ÄRGER a\x00b"), (6, "語 語 a"), (7, "long text A " * 50_000),
    ]
    items = [(1, "a B c 語"), (1, "a B c 語"), (None, "ärger"), (2, None), (3, ""), (4, "long a a")]
    assert search(docs, items) == plain(docs, items)
    assert search(docs, items, k=2) == plain(docs, items, 2)
    assert search([], items) == [] and search(docs, []) == []


def test_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(lexical, "_SLICE", 7)
    text = "One twó, threefourfivesixseven eight-nine ZÉRO".encode()
    assert [t for p in lexical.terms(text) for t in p] == lexical._TERM.findall(text.lower())


@pytest.mark.parametrize("spread", [0.0, 0.2, 1.0])
def test_bounds_hold_and_prune(spread):
    """No row beats the bound of a ball it is in; the nearer the rows, the fewer leaves open."""
    rng = np.random.default_rng(5)
    middle = {g: (np.sort(rng.choice(500, 40, replace=False)), rng.random(40)) for g in range(20)}
    columns, values = [], []
    for k in range(2000):
        held, own = middle[k % 20]
        columns.append(held)
        values.append((1e9 * (own * (1 - spread) + rng.random(40) * spread)).astype(np.int64) + 1)
    starts = np.arange(0, 80_001, 40)
    vectors = lexical.Vectors(starts, np.concatenate(columns), np.concatenate(values))
    tree = lexical.BallTree(vectors, 500, 16)
    assert sorted(tree.order.tolist()) == list(range(2000))
    leaves, opened = sum(left < 0 for left in tree.left), 0
    for group in range(20):
        asked = np.sort(rng.choice(middle[group][0], 12, replace=False))
        counts = rng.integers(1, 4, 12)
        dense = np.zeros(500, np.int64)
        dense[asked] = counts
        products = tree.vectors.dot(dense)
        for node, bound in enumerate(tree.bounds(asked, counts)):
            assert products[tree.low[node] : tree.high[node]].max() <= bound
        best = []
        opened += tree.search(asked, counts, dense, best, list(range(2000)), 10)
        assert sorted(s for s, _ in best) == sorted(vectors.dot(dense).tolist())[-10:]
    assert opened < 20 * leaves * (0.25 if spread < 0.5 else 1)
