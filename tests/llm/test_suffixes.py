import random

import numpy as np
import pyarrow as pa

from balance_spark.llm import suffixes
from balance_spark.llm.common import Texts


def brute_force(rows, least=50):
    seen = {}
    for doc, text in rows:
        found = (text or "").split()
        for i in range(len(found) - least + 1):
            seen.setdefault(tuple(found[i : i + least]), []).append((doc, i))
    spans = set()
    covered = sorted(p for places in seen.values() if len(places) > 1 for p in places)
    for doc in {d for d, _ in covered}:
        starts = [i for d, i in covered if d == doc]
        begin = end = None
        for i in starts:
            if begin is None or i > end:
                if begin is not None:
                    spans.add((doc, begin, end))
                begin = i
            end = i + least
        spans.add((doc, begin, end))
    return spans


def corpus(rng):
    word = lambda: f"w{rng.randrange(4000)}"
    passages = [[word() for _ in range(rng.choice([49, 50, 51, 60, 130]))] for _ in range(8)]
    rows = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            copy = list(rng.choice(passages))
            if rng.random() < 0.3:
                copy[rng.randrange(len(copy))] = word()
            text += copy + [word() for _ in range(rng.randrange(40))]
        rows.append((d, " ".join(text)))
    return rows + [(60, "a b " * 80), (61, rows[0][1]), (62, None), (63, " ")]


def test_matches_brute_force(documents, clashing, monkeypatch):
    rows = corpus(random.Random(5))
    want = brute_force(rows)
    for limit in (16384, 3):  # with and without dealing out frequent runs
        monkeypatch.setattr(suffixes, "GROUP", limit)
        found = suffixes.repeated_spans(clashing(documents(*rows))).collect()
        assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in found} == want


def test_edges(documents):
    long = " ".join(f"w{i}" for i in range(60))
    docs = documents((1, long), (1, long), (None, long), (2, None), (3, ""))
    got = sorted((str(r["doc_id"]), r["start_word"], r["end_word"]) for r in suffixes.repeated_spans(docs).collect())
    assert got == [("1", 0, 60), ("1", 0, 60), ("None", 0, 60)]
    assert suffixes.repeated_spans(docs.filter("false")).count() == 0


def test_words_of_a_batch():
    texts = ["a b", None, "", " c", "dé\x0be\n", "f", "g h"]
    held = Texts(pa.array(texts + ["zz"], pa.string()).slice(0, 7))
    assert np.diff(held.first).tolist() == [2, 0, 0, 1, 2, 1, 2]
    alone = [Texts(pa.array([t])).hashes() for t in texts]
    assert held.hashes().tolist() == [h for part in alone for h in part.tolist()]
    again = Texts(pa.array(["x a", "a"])).hashes()
    assert again[1] == again[2] != again[0]
