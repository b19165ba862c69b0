import itertools
import random

import numpy as np

from balance_spark.llm import packing


def cost_of(lengths, sizes, price, bins):
    total = 0
    for b in bins:
        need = sum(lengths[i] for i in b)
        total += price(min(s for s in sizes if s >= need))
    return total


def partitions(items, most, lengths):
    if not items:
        yield []
        return
    first, rest = items[0], items[1:]
    for k in range(len(rest) + 1):
        for others in itertools.combinations(rest, k):
            group = (first, *others)
            if sum(lengths[i] for i in group) <= most:
                left = [i for i in rest if i not in others]
                for tail in partitions(left, most, lengths):
                    yield [group, *tail]


def test_near_the_best_packing():
    rng = random.Random(6)
    sizes, price = (8, 16, 32), packing.cost
    for _ in range(15):
        lengths = [rng.randrange(1, 33) for _ in range(7)]
        best = min(cost_of(lengths, sizes, price, p) for p in partitions(list(range(7)), 32, lengths))
        bins, offsets, held = packing.best_fit(np.array(lengths), sizes, price)
        used = [0] * len(held)
        for i in np.lexsort((offsets, bins)).tolist():
            assert offsets[i] == used[bins[i]]
            used[bins[i]] += lengths[i]
        assert all(u == min(u, c) and c == min(s for s in sizes if s >= u) for u, c in zip(used, held.tolist()))
        assert sum(price(c) for c in held.tolist()) <= 1.25 * best


def test_documents_are_whole(documents, clashing):
    rng = random.Random(7)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 60)))) for i in range(200)]
    rows += [(200, "x " * 1000), (5, "again"), (None, "a b"), (201, None), (202, "  ")]
    got = packing.pack(clashing(documents(*rows)), capacities=(16, 64), window=50).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len((t or "").split()) for _, t in rows)
    by_bin = {}
    for r in got:
        if r["n_tokens"]:
            by_bin.setdefault(r["bin_id"], []).append(r)
        else:
            assert r["bin_id"] is None and r["doc_id"] in (201, 202)
    for held in by_bin.values():
        held.sort(key=lambda r: r["bin_offset"])
        end = 0
        for r in held:
            assert r["bin_offset"] == end
            end += r["n_tokens"]
        assert held[0]["bin_capacity"] == (16 if end <= 16 else 64) and end <= 64
    long = sorted((r["piece_start"], r["n_tokens"]) for r in got if r["doc_id"] == 200)
    assert long == [(s, min(64, 1000 - s)) for s in range(0, 1000, 64)]
    assert packing.pack(documents((1, "x")).filter("false")).count() == 0
