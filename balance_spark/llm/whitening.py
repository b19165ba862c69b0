"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found without forming it: a pass over the data
multiplies a narrow block Q by it (``XᵀXQ`` over centred rows, summed over the tasks), a
three-term recurrence of such passes applies a Chebyshev polynomial that is small on the
unwanted part of the spectrum and grows fast beyond it, QR makes the block orthonormal again,
and Rayleigh-Ritz turns it towards eigenvectors.  This goes on until the residuals certify the
wanted ones.  Only the block (dimensions x some 16 numbers) passes through the driver.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balance_spark.llm.common import stored

#: Entries become whole 256ths (fixed by the contract).
SCALE = 256
VECTORS = "vec_id long, dims int, x binary"
WHITENED = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)
_VECTORS = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("x", pa.binary())])
_WHITENED = pa.schema(
    [
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()),
        ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()),
        ("identity_error", pa.float64()),
    ]
)
_KINDS = ("<i2", "<i4", "<i8")


def _code(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest kind that holds them all, so equal vectors are equal."""
    least, most = int(x.min()), int(x.max())
    for kind in _KINDS:
        limits = np.iinfo(kind)
        if limits.min <= least and most <= limits.max:
            return x.astype(kind).tobytes()


def whole_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, dims, x`` of the rows with a usable vector, ``x`` as bytes of whole numbers."""

    def convert(batches):
        for batch in batches:
            names, column = batch.column(0).to_pylist(), batch.column(1)
            out = []
            for name, own in zip(names, column):
                if not own.is_valid or not len(own.values) or own.values.null_count:
                    continue
                x = np.floor(SCALE * own.values.to_numpy())
                if (np.abs(x) < 2.0**63).all():  # neither NaN nor infinite nor beyond a long
                    out.append((name, len(x), _code(x)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), _VECTORS)], schema=_VECTORS
                )

    return table.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).mapInArrow(convert, VECTORS)


def _matrices(column, dims: int):
    """``(rows, matrix)`` of a column of coded vectors, for each kind of number in it."""
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1])
    for kind in _KINDS:
        rows = np.flatnonzero(sizes == dims * np.dtype(kind).itemsize)
        if len(rows):
            data = b"".join(column.take(pa.array(rows)).to_pylist())
            yield rows, np.frombuffer(data, kind).reshape(len(rows), dims).astype(np.int64)


class Covariance:
    """Products with the covariance of a stored table of distinct vectors (column ``x``)."""

    def __init__(self, fit: DataFrame, dims: int):
        self.fit, self.dims = fit, dims
        self.n, self.sums, self.largest = self._totals()
        self.mean = np.array([float(s) / self.n if abs(s) < 1 << 52 else s / self.n for s in self.sums])
        self.passes = 0

    def _totals(self):
        dims = self.dims

        def add(batches):
            total, count, largest = [0] * dims, 0, 0
            for batch in batches:
                for rows, x in _matrices(batch.column(0), dims):
                    count += len(rows)
                    widest = max(abs(int(x.min())), abs(int(x.max())))
                    largest = max(largest, widest)
                    own = x.sum(axis=0) if widest * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
                    total = [a + int(b) for a, b in zip(total, own)]
            kinds = pa.int32(), pa.decimal128(38, 0)
            # Place -1 counts the rows, place -2 has the largest entry.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([-2, -1, *range(dims)], kinds[0]),
                    pa.array([Decimal(v) for v in (largest, count, *total)], kinds[1]),
                ],
                names=["place", "value"],
            )

        rows = self.fit.select("x").mapInArrow(add, "place int, value decimal(38,0)")
        found = {
            r["place"]: (int(r["total"]), int(r["largest"]))
            for r in rows.groupBy("place")
            .agg(F.sum("value").alias("total"), F.max("value").alias("largest"))
            .collect()
        }
        return found[-1][0], [found[k][0] for k in range(dims)], found[-2][1]

    def _sum(self, partial, shape) -> np.ndarray:
        """The sum of ``partial(centred rows)`` over all rows, added up on Spark."""
        dims, size, mean = self.dims, int(np.prod(shape)), self.mean

        def add(batches):
            total = np.zeros(shape)
            for batch in batches:
                for _, x in _matrices(batch.column(0), dims):
                    total += partial(x - mean)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size, dtype=np.int32)), pa.array(total.ravel())],
                names=["place", "value"],
            )

        self.passes += 1
        rows = self.fit.select("x").mapInArrow(add, "place int, value double")
        total = np.zeros(size)
        for place, value in rows.groupBy("place").agg(F.sum("value")).collect():
            total[place] = value
        return total.reshape(shape)

    def trace(self) -> float:
        return float(self._sum(lambda centred: np.array(np.square(centred).sum()), ())) / self.n

    def times(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of columns."""
        return self._sum(lambda centred: centred.T @ (centred @ block), block.shape) / self.n

    def of(self, weights: np.ndarray) -> np.ndarray:
        """The covariance of the centred rows times ``weights``."""
        k = weights.shape[1]

        def partial(centred):
            z = centred @ weights
            return np.concatenate([z.T @ z, z.sum(axis=0)[None, :]])

        total = self._sum(partial, (k + 1, k)) / self.n
        return total[:k] - np.outer(total[k], total[k])


def _ends(times, size: int, rng, steps: int = 8):
    """Rough ends of the spectrum by a few Lanczos steps from one random vector."""
    steps = min(steps, size)
    vectors, heads, sides = [rng.standard_normal(size)], [], []
    vectors[0] /= np.linalg.norm(vectors[0])
    for _ in range(steps):
        image = times(vectors[-1][:, None])[:, 0]
        heads.append(float(vectors[-1] @ image))
        for _ in range(2):
            for vector in vectors:
                image = image - (vector @ image) * vector
        sides.append(float(np.linalg.norm(image)))
        if sides[-1] <= 1e-12 * abs(heads[0]):
            break
        vectors.append(image / sides[-1])
    chain = np.diag(heads) + np.diag(sides[: len(heads) - 1], 1) + np.diag(sides[: len(heads) - 1], -1)
    values = np.linalg.eigvalsh(chain)
    return max(0.0, float(values[0])), float(values[-1] + sides[-1])


def leading(
    times, size: int, k: int, *, guard: int = 12, degree: int = 12, tolerance: float = 1e-13,
    rounds: int = 500, seed: int = 11,
):
    """``(values, vectors, residuals)``: the k largest eigenvalues, falling, with unit vectors.

    ``times(block)`` multiplies with a symmetric matrix without negative eigenvalues.  A vector
    is certified when its residual is at most ``tolerance`` of the largest eigenvalue; where
    rounding stops all progress a little above, 1000 times as much will do.  One column of the
    block is drawn anew each round, so no direction stays unseen.
    """
    rng = np.random.default_rng(seed)
    k = min(k, size)
    width = min(size, k + guard)
    low, _ = _ends(times, size, rng)
    basis = np.linalg.qr(rng.standard_normal((size, width)))[0]
    history: list[float] = []
    for _ in range(rounds):
        image = times(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        residuals = np.linalg.norm(image - basis * values, axis=0)
        allowed = tolerance * max(values[0], 0.0)
        history.append(float(residuals[:k].max()))
        stuck = len(history) > 4 and history[-1] > 0.5 * min(history[-5:-1])
        if history[-1] <= allowed or (stuck and history[-1] <= 1000 * allowed):
            return values[:k], basis[:, :k], residuals[:k]
        locked = int(np.argmax(np.append(residuals[:k] > allowed, True)))
        basis = _filtered(times, basis, values, locked, low, degree, rng)
    raise ArithmeticError(f"eigenvectors not certified: residual {history[-1]:.3g}")


def _filtered(times, basis, values, locked, low, degree, rng):
    """The block after one polynomial; its first ``locked`` columns stay as they are."""
    kept, block = basis[:, :locked], basis[:, locked:].copy()
    if block.shape[1] > 1:
        block[:, -1] = rng.standard_normal(len(block))
    top, cut = values[locked], values[-1]
    half = max((cut - low) / 2, 1e-6 * top)
    middle = cut - half
    # So far that the first column of the block does not drown the last.
    reach = np.arccosh(max((top - middle) / half, 1 + 1e-9))
    steps = int(np.clip(np.log(1e10) / reach, 2, degree))

    def apart(columns):
        return columns - kept @ (kept.T @ columns)

    before, now = apart(block), None
    now = apart((times(before) - middle * before) / half)
    for _ in range(steps - 1):
        before, now = now, apart(2 * (times(now) - middle * now) / half - before)
    now = now / np.maximum(np.linalg.norm(now, axis=0), 1e-300)
    for _ in range(2):  # twice is enough
        now = np.linalg.qr(apart(now))[0]
    return np.concatenate([kept, now], axis=1)


def whitened(table: DataFrame, components: int = 4, vector: str = "embedding") -> DataFrame:
    """Each usable row of ``table`` on the leading components of the distinct vectors.

    ``table`` has ``vec_id`` and a vector column.  Rows whose vector is NULL, empty, or holds
    NULL, NaN, an infinite entry or one beyond 2^63 / 256 are dropped; so are vectors of
    another length than the most frequent one (of two, the longer).  The fit counts each
    distinct vector once, so copies do not pull; every row, repeated ones and those without
    ``vec_id`` too, is returned with each component.  Components without variance (under 1e-12
    of the first) are left out, so one distinct vector, or an empty table, gives no row.
    ``deviation`` is NULL where it does not fit a long.  Vectors may be long: a task holds a
    batch of them and ``dims`` x 16 numbers.  Other columns are not read.

    The usable rows and the distinct vectors are written to the shared folder; the latter are
    shuffled once, copies combined before.  Every pass then reads them where they lie.
    """
    spark = table.sparkSession
    rows = stored(whole_vectors(table, vector), "whitening-rows")
    lengths = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], WHITENED)
    dims = lengths[0]["dims"]
    rows = rows.filter(F.col("dims") == dims)
    covariance = Covariance(stored(rows.select("x").distinct(), "whitening-fit"), dims)
    trace = covariance.trace()
    if not trace > 0:
        return spark.createDataFrame([], WHITENED)
    values, vectors, _ = leading(covariance.times, dims, components)
    real = values > 1e-12 * values[0]
    values, vectors = values[real], vectors[:, real]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    weights = vectors * signs / np.sqrt(values)
    error = float(np.abs(covariance.of(weights) - np.eye(len(values))).max())
    n, sums, mean = covariance.n, covariance.sums, covariance.mean
    explained, k = values / trace, len(values)
    widest = n * covariance.largest + max(abs(s) for s in sums)
    exact = dims * widest * widest < 1 << 62

    def deviations(x):
        own = x if exact else x.astype(object)
        squares = ((n * own - np.array(sums, dtype=np.int64 if exact else object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in squares]

    def project(batches):
        for batch in batches:
            names = batch.column(0)
            for at, x in _matrices(batch.column(1), dims):
                of = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.take(pa.array(at[of])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(of), n)),
                        pa.array(deviations(x), pa.int64()).take(pa.array(of)),
                        pa.array(((x - mean) @ weights).ravel()),
                        pa.array(np.tile(explained, len(at))),
                        pa.array(np.full(len(of), error)),
                    ],
                    schema=_WHITENED,
                )

    return rows.select("vec_id", "x").mapInArrow(project, WHITENED)


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))
