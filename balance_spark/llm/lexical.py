"""Ranked lexical search: exact inner products, pruned by ball trees over sparse vectors.

A document is a vector with an entry for each term that an item has, an item one with the
number of times it has the term; their inner product is the score.  Each task sorts the
vectors it reads into trees of balls (a centroid, and a radius that reaches every vector
below).  For an item q no vector in a ball scores more than q.c + |q| r, so balls are opened
best first until the next one cannot reach the item's k-th score.  An item has few of the
terms a radius is made of, so a ball also has its radius along each term: how far a vector
below goes beyond the centroid there.  Over the item's terms these add up to a second bound,
and the lesser one counts.  Bounds are doubles, rounded up; scores are exact integers,
computed in the leaves.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from balance_spark.llm.common import stored

#: Terms: ASCII letters and digits and everything beyond ASCII (fixed by the contract).
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_SLICE = 1 << 22


def terms(text: bytes | None):
    """Lists of the terms of a text in order, one list for each few MB; NULL has none."""
    text, at = text or b"", 0
    while at < len(text):
        end = len(text)
        if end - at > _SLICE:
            found = _BREAK.search(text, at + _SLICE)
            end = found.start() if found else end
        # ``bytes.lower`` changes A-Z alone.
        yield _TERM.findall(text[at:end].lower())
        at = end


class Vectors:
    """Rows of a sparse matrix with whole numbers, none of the rows empty."""

    def __init__(self, starts, columns, values):
        self.starts, self.columns, self.values = starts, columns, values
        self.lengths = np.diff(starts)

    def __len__(self):
        return len(self.lengths)

    def take(self, rows) -> Vectors:
        lengths = self.lengths[rows]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(self.starts[rows] - starts[:-1], lengths) + np.arange(starts[-1])
        return Vectors(starts, self.columns[places], self.values[places])

    def dot(self, dense) -> np.ndarray:
        """The product of each row with a dense vector, in the vector's kind of numbers."""
        return np.add.reduceat(dense[self.columns] * self.values, self.starts[:-1])


class BallTree:
    """Balls over the rows of ``vectors``; ``size`` is the number of columns.

    ``order`` has the rows of the leaves, from left to right; node k covers ``low[k]`` to
    ``high[k]`` of it, and has the children ``left[k]`` and ``right[k]`` (-1 for a leaf).
    """

    def __init__(self, vectors: Vectors, size: int, leaf: int = 32):
        self.leaf, self.dense = leaf, np.zeros(size)
        self.low, self.high, self.left, self.right, self.radius = [], [], [], [], []
        self.order, self._centres = np.empty(len(vectors), np.int64), []
        if len(vectors):
            self._add(vectors, np.arange(len(vectors)), 0)
        self.vectors = vectors.take(self.order)
        self.radius = np.array(self.radius)
        # Centroids by column, so that an item reads the columns of its terms alone.
        columns = np.concatenate([c for c, _, _ in self._centres] or [np.zeros(0, np.int64)])
        nodes = np.repeat(np.arange(len(self._centres)), [len(c) for c, _, _ in self._centres])
        by = np.argsort(columns, kind="stable")
        self.centre_columns, self.centre_nodes = columns[by], nodes[by]
        self.centre_values, self.centre_reach = (
            np.concatenate([own[k] for own in self._centres] or [np.zeros(0)])[by] for k in (1, 2)
        )
        del self._centres, self.dense

    def _add(self, vectors: Vectors, rows, low: int) -> int:
        node, count = len(self.low), len(rows)
        sums = np.bincount(vectors.columns, vectors.values, len(self.dense))
        held = np.flatnonzero(sums)
        centre = sums[held] / count
        np.maximum.at(self.dense, vectors.columns, vectors.values)
        reach = self.dense[held] - centre
        self.dense[held] = centre
        norms = np.add.reduceat(np.square(vectors.values, dtype=float), vectors.starts[:-1])
        own = float(centre @ centre)
        squares = norms + own - 2 * vectors.dot(self.dense)
        self.dense[held] = 0
        # The difference of large squares is off by some 1e-16 of them for each entry.
        squares = np.maximum(squares, 0) + 1e-12 * (norms + own)
        self.low.append(low), self.high.append(low + count)
        self.left.append(-1), self.right.append(-1)
        self.radius.append(float(np.sqrt(squares.max())))
        self._centres.append((held, centre, reach))
        if count <= self.leaf:
            self.order[low : low + count] = rows
            return node
        # Two far vectors; the half that is nearer to the one goes left.
        first = self._to(vectors, int(squares.argmax()))
        away = norms - 2 * first
        second = self._to(vectors, int(away.argmax()))
        half = count // 2
        side = np.argpartition(second - first, half)
        near, far = np.sort(side[:half]), np.sort(side[half:])
        self.left[node] = self._add(vectors.take(near), rows[near], low)
        self.right[node] = self._add(vectors.take(far), rows[far], low + half)
        return node

    def _to(self, vectors: Vectors, row: int):
        """The product of each row with one of them."""
        part = slice(vectors.starts[row], vectors.starts[row + 1])
        self.dense[vectors.columns[part]] = vectors.values[part]
        products = vectors.dot(self.dense)
        self.dense[vectors.columns[part]] = 0
        return products

    def bounds(self, columns, counts) -> np.ndarray:
        """For each node, a number that no row below it has a larger product than."""
        first = np.searchsorted(self.centre_columns, columns, "left")
        last = np.searchsorted(self.centre_columns, columns, "right")
        lengths = last - first
        before = np.cumsum(lengths) - lengths
        places = np.repeat(first - before, lengths) + np.arange(lengths.sum())
        nodes, counts_ = self.centre_nodes[places], np.repeat(counts, lengths)
        products, reach = (
            np.bincount(nodes, own[places] * counts_, len(self.radius))
            for own in (self.centre_values, self.centre_reach)
        )
        length = math.sqrt(float(np.square(counts, dtype=float).sum()))
        return (products + np.minimum(length * self.radius, reach)) * (1 + 1e-9) + 1

    def search(self, columns, counts, dense, best: list, names, k: int) -> int:
        """Bring the k best rows into the heap ``best``; gives the number of leaves opened.

        Entries are ``(score, -name)``, so the least entry is the first to go.  ``dense``
        has the item's counts as whole numbers.
        """
        if not len(self.radius):
            return 0
        bounds = self.bounds(columns, counts).tolist()
        queue, opened = [(-bounds[0], 0)], 0
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < (best[0][0] if len(best) == k else 1):
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(queue, (-bounds[child], child))
                continue
            opened += 1
            low, high = self.low[node], self.high[node]
            starts = self.vectors.starts[low : high + 1]
            part = slice(starts[0], starts[-1])
            products = dense[self.vectors.columns[part]] * self.vectors.values[part]
            scores = np.add.reduceat(products, starts[:-1] - starts[0])
            least = best[0][0] if len(best) == k else 1
            for at in np.flatnonzero(scores >= least).tolist():
                entry = int(scores[at]), -names[self.order[low + at]]
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return opened


#: Stands for a missing ``doc_id``: after all others.
_LAST = 1 << 63
COUNTED = "doc_id long, n long, terms array<int>, counts array<int>"
_COUNTED = pa.schema(
    [
        ("doc_id", pa.int64()), ("n", pa.int64()),
        ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())),
    ]
)
FOUND = "item int, doc_id long, score long, slot int"
_FOUND = pa.schema(
    [("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64()), ("slot", pa.int32())]
)


def counted(docs: DataFrame, vocabulary) -> DataFrame:
    """For each text with a term: how many it has, and how often those of the vocabulary."""

    def count(batches):
        known = vocabulary.value.get
        for batch in batches:
            ids, texts, out = batch.column(0).to_pylist(), batch.column(1), []
            for k in range(len(ids)):
                total, held = 0, Counter()
                for part in terms(texts[k].as_py()):
                    total += len(part)
                    held.update(map(known, part))
                held.pop(None, None)
                if total:
                    out.append((ids[k], total, list(held), list(held.values())))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), _COUNTED)], schema=_COUNTED
                )

    return docs.mapInArrow(count, COUNTED)


def _searched(rows: DataFrame, items, weights, documents, total, k, chunk, leaf) -> DataFrame:
    """The k best rows of each task for each item."""

    def search(batches):
        own, weight = items.value, weights.value
        size = len(weight)
        best: list[list] = [[] for _ in own]
        names, parts, entries = [], [], 0

        def flush():
            nonlocal names, parts, entries
            if not names:
                return
            starts = np.concatenate([[0], np.cumsum([len(c) for c, _ in parts])])
            vectors = Vectors(
                starts,
                np.concatenate([c for c, _ in parts]),
                np.concatenate([v for _, v in parts]),
            )
            tree, dense = BallTree(vectors, size, leaf), np.zeros(size, np.int64)
            for heap, (columns, counts) in zip(best, own):
                dense[columns] = counts
                tree.search(columns, counts, dense, heap, names, k)
                dense[columns] = 0
            names, parts, entries = [], [], 0

        for batch in batches:
            ids, length = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lists, counts = batch.column(2), batch.column(3)
            bounds = lists.offsets.to_numpy()
            columns, numbers = lists.values.to_numpy(), counts.values.to_numpy().astype(np.int64)
            shift = counts.offsets.to_numpy()
            for at in range(len(ids)):
                low, high = bounds[at], bounds[at + 1]
                if low == high:
                    continue
                tf = numbers[shift[at] : shift[at + 1]]
                m = 25 + 75 * int(length[at]) * documents // total
                column = columns[low:high]
                value = weight[column] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
                names.append(_LAST if ids[at] is None else ids[at])
                parts.append((column, value))
                entries += len(column)
                if len(names) >= chunk or entries >= chunk << 8:
                    flush()
        flush()
        slot = TaskContext.get().partitionId()
        out = [
            (number, None if name == -_LAST else -name, score, slot)
            for number, heap in enumerate(best)
            for score, name in heap
        ]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND
            )

    return rows.mapInArrow(search, FOUND)


def _blocks(items: DataFrame, block_bytes: int):
    """The items in blocks of about ``block_bytes`` of text: lists of ``(item_id, text)``."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r["item_id"], Counter(t for p in terms(r["text"]) for t in p)) for r in part.collect()]


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    *,
    block_bytes: int = 8 << 20,
    chunk: int = 1 << 14,
    leaf: int = 32,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents with the highest scores of each item.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; the scores are those of
    the module's query (see ``op12_lexical``), over all documents with a term.  Only scores
    above 0 count; equal scores go by ``doc_id``, NULL last.  Items and documents that are
    NULL, empty or without a term find nothing and are not found; every row counts, so
    repeated rows are ranked each; texts of any length are read whole, a few MB at a time;
    empty tables give no row.  Other columns are not read.

    Items are a stated set of queries.  However many there are, the driver and a task hold a
    block of ``block_bytes`` of their text at a time, and documents are read once for each
    block.  ``chunk`` is the number of vectors (or 256 times as many entries) in a tree.  The
    term counts of each block are written to the shared folder; only the k best rows of each
    task are shuffled, and cut once by groups of tasks before each item's are brought together.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    items = items.select(
        F.col("item_id").cast("long").alias("item_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
    )
    answer = None
    for block in _blocks(items, block_bytes):
        vocabulary = {t: n for n, t in enumerate(sorted({t for _, own in block for t in own}))}
        rows = stored(counted(docs, context.broadcast(vocabulary)), "lexical-counts")
        documents, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        weight = np.zeros(len(vocabulary), np.int64)
        for term, df in held:
            weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        vectors = []
        for _, own in block:
            columns = np.array(sorted(vocabulary[t] for t in own), np.int64)
            count = {vocabulary[t]: c for t, c in own.items()}
            vectors.append((columns, np.array([count[c] for c in columns.tolist()], np.int64)))
        found = _searched(
            rows, context.broadcast(vectors), context.broadcast(weight), documents, total, k,
            chunk, leaf,
        )
        names = spark.createDataFrame(
            [(n, item_id) for n, (item_id, _) in enumerate(block)], "item int, item_id long"
        )
        order = F.desc("score"), F.asc_nulls_last("doc_id")
        for keys in (["item", F.pmod("slot", F.lit(64))], ["item"]):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
            found = found.withColumn("rank", place).filter(F.col("rank") <= k)
        part = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        answer = part if answer is None else answer.unionByName(part)
    return answer


def op12_lexical(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return ranked(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


_TERMS_SQL = r"""unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

OP12_SQL = f"""
WITH words AS (
    SELECT doc, doc_id, {_TERMS_SQL} AS term
    FROM (SELECT row_number() OVER () AS doc, doc_id, text FROM documents)),
held AS (SELECT doc, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc, count(*) AS n FROM words GROUP BY doc),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sizes),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM held, whole GROUP BY term, docs),
values_ AS (
    SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf
        + 8 * (100 - 75 + (75 * n * docs) // total))) AS v
    FROM held JOIN sizes USING (doc) JOIN weights USING (term), whole),
asked AS (
    SELECT item, item_id, {_TERMS_SQL} AS term
    FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
scores AS (
    SELECT item, item_id, doc, doc_id, sum(v)::BIGINT AS score
    FROM asked JOIN values_ USING (term) GROUP BY ALL HAVING sum(v) > 0),
placed AS (
    SELECT item_id, doc_id, score, row_number() OVER (
        PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
    FROM scores)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
