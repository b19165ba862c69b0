import math
import random

import numpy as np
import pytest

from balance_spark.llm import whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, n string, component string, x string"


def plain(rows, k=4):
    """``{vec_id: [(deviation, whitened...)]}`` by the covariance itself."""
    usable = [
        (name, tuple(math.floor(256 * c) for c in v))
        for name, v in rows
        if v and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = sorted({x for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = [
        (name, sum((n * c - s) ** 2 for c, s in zip(x, sums)), (np.array(x) - mean) @ vectors / np.sqrt(values))
        for name, x in usable
    ]
    return n, values / np.trace(centred.T @ centred / n), out


def check(table, rows, k=4):
    n, explained, want = plain(rows, k)
    got = table.collect()
    assert len(got) == len(want) * len(explained)
    signs = {}
    by_row = {}
    for r in got:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
    for name, deviation, projected in want:
        for r in by_row[name, deviation]:
            j = r["component"] - 1
            assert r["n"] == n and 0 <= r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(explained[j], rel=1e-10)
            if abs(projected[j]) > 1e-6:
                signs.setdefault(j, []).append(r["whitened"] / projected[j])
    for ratios in signs.values():
        assert np.allclose(ratios, np.sign(ratios[0]), atol=1e-6)


def test_equals_the_covariance(spark):
    rng = np.random.default_rng(3)
    spread = rng.random(30) + np.array([3, 2, 1.5, 1.2, *[0.3] * 26])
    rows = [(k, (rng.standard_normal(30) * spread + 5).tolist()) for k in range(900)]
    rows += [(2000 + k, rows[3][1]) for k in range(450)]  # a third are copies of one vector
    table = spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA).repartition(7)
    rows = [(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect()]
    check(whitening.whitened(table), rows)
    check(whitening.whitened(table, 2), rows, 2)


def test_unusable_rows_and_edges(spark):
    rng = random.Random(5)
    good = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(20)]
    odd = [
        (50, None), (51, []), (52, [1.0, None, 2.0]), (53, [1.0, float("nan"), 2.0]),
        (54, [float("inf"), 0.0, 0.0]), (55, [3e38, 0.0, 0.0]), (56, [1.0, 2.0]),
    ]
    rows = [*good, good[0], (None, good[1][1]), (None, good[2][1]), (21, [-0.0, 200.0, -1000.0])]
    table = spark.createDataFrame([(*r, "", "", "") for r in rows + odd], SCHEMA)
    plain_rows = [
        (r["vec_id"], r["embedding"]) for r in table.collect() if (r["vec_id"] or 0) < 50
    ]
    check(whitening.whitened(table), plain_rows)
    one = spark.createDataFrame([(*good[0], "", "", "")] * 3, SCHEMA)
    for empty in (one, table.filter("vec_id = 50"), table.filter("false")):
        found = whitening.whitened(empty)
        assert found.count() == 0 and found.columns == whitening.whitened(table).columns
    flat = spark.createDataFrame([(k, [float(k), 1.0, 2.0], "", "", "") for k in range(9)], SCHEMA)
    assert {r["component"] for r in whitening.whitened(flat).collect()} == {1}


def test_wide_numbers_and_long_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.standard_normal(4) * 10.0 ** rng.integers(-2, 9)).tolist()) for k in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {len(r["x"]) for r in whitening.whole_vectors(table).collect()} >= {8, 16, 32}
    n, _, want = plain(rows)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(table).collect()}
    assert got == {name: d if d < 1 << 63 else None for name, d, _ in want}
    rows = [(k, rng.standard_normal(3000).tolist()) for k in range(12)]
    check(whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows)


@pytest.mark.parametrize(
    "spectrum",
    [
        np.linspace(1, 1.05, 80),
        np.array([1e6, 900.0, 1.01, *np.linspace(0.9, 1, 77)]),
        np.array([5.0, 5.0, 5.0, 5.0, 5.0, *[1.0] * 75]),
        np.array([3.0, 1.0, *[0.0] * 78]),
        np.ones(80),
        np.geomspace(1e-8, 1e4, 80),
    ],
    ids=["flat", "dominant", "ties", "rank 2", "equal", "steep"],
)
def test_spectra(spectrum):
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    matrix = turn * spectrum @ turn.T
    calls = []
    values, vectors, residuals = whitening.leading(lambda b: (calls.append(1), matrix @ b)[1], 80, 4)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=1e-10, atol=1e-10 * spectrum.max())
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-9 * spectrum.max())
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    assert len(calls) < 160


def test_query(spark):
    rows = [
        (r["vec_id"], r["embedding"])
        for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    ]
    check(whitening.op13_whitening(spark, FOLDER), rows)
