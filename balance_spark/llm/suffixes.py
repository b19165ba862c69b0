"""Repeated passages by sparse suffix arrays.

Of every text only suffixes at minimiser positions are kept: in each run of ``min_words``
words that of its word runs of length ``GRAM`` whose hash is least.  Two copies of a passage
of ``min_words`` words choose the same position, so one of their kept suffixes begins inside
both.  Suffixes that begin with the same word run are sorted, neighbours are compared, and
matches are extended to both sides.  A neighbour in the order of what follows need not be the
one that also agrees on the left; so suffixes are sorted once for each number of words to the
left that a passage can have there, by these words first and then by what follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from balance_spark.llm.common import Texts, mixed, partitions, stored

#: Words of the run by which suffixes are chosen and grouped.
GRAM = 10
#: Suffixes that are sorted together at most.
GROUP = 16384
_MAX = np.uint64((1 << 64) - 1)


def _gram_hashes(codes, first):
    """A hash of the ``GRAM`` words from each word on; the largest number where a text ends."""
    count = len(codes)
    total = np.zeros(count, np.uint64)
    for k in range(GRAM):
        total[: count - k] = mixed(total[: count - k] + codes[k:])
    ends = np.repeat(first[1:], np.diff(first))
    total[np.arange(count) + GRAM > ends] = _MAX
    return total


def minimisers(codes, first, min_words):
    """``(position, hash)`` of the chosen word runs; positions count the batch's words."""
    width = min_words - GRAM + 1
    if len(codes) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = _gram_hashes(codes, first)
    ends = np.repeat(first[1:], np.diff(first))
    starts = np.flatnonzero(np.arange(len(codes)) + min_words <= ends)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, width)
    chosen = [
        part + windows[part].argmin(axis=1)
        for part in np.array_split(starts, max(1, len(starts) >> 16))
    ]
    at = np.unique(np.concatenate(chosen))
    return at, hashes[at]


def _portions(column, most=4 << 20):
    """Rows of a few MB of text at a time, or one longer text."""
    sizes = np.array(
        [0 if n is None else n for n in pc.binary_length(column).to_pylist()], np.int64
    )
    at, size = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if size and size + n > most:
            yield at, k
            at, size = k, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )


def sampled_suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """``(row_id, at, gram)`` of every kept suffix: its row, its first word, its word run."""

    def sample(batches):
        for batch in batches:
            rows, column = batch.column("row_id"), batch.column("text")
            for low, high in _portions(column):
                texts = Texts(column.slice(low, high - low))
                at, grams = minimisers(texts.hashes(), texts.first, min_words)
                row = np.searchsorted(texts.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.slice(low).take(pa.array(row)),
                        pa.array(at - texts.first[row]),
                        pa.array(grams.view(np.int64)),
                    ],
                    names=["row_id", "at", "gram"],
                )

    numbered = _numbered(docs).select("row_id", "text")
    return numbered.mapInArrow(sample, "row_id long, at long, gram long")


def _contexts(docs: DataFrame, suffixes: DataFrame, min_words: int) -> DataFrame:
    """Suffixes with the words around them: ``left`` going back, ``right`` behind the run.

    ``context`` is a hash of run, left and right.  Words are four-byte hashes.
    """
    reach = min_words - GRAM
    wanted = suffixes.groupBy("row_id").agg(F.sort_array(F.collect_list("at")).alias("places"))
    rows = _numbered(docs).join(wanted, "row_id").select("row_id", "doc_id", "places", "text")
    names = ["row_id", "doc_id", "at", "gram", "context", "left", "right"]

    def cut(batches):
        for batch in batches:
            column = batch.column("text")
            for low, high in _portions(column):
                texts = Texts(column.slice(low, high - low))
                codes = texts.hashes()
                grams = _gram_hashes(codes, texts.first)
                short = codes.astype(np.uint32)
                places = batch.column("places").slice(low, high - low)
                row = np.repeat(np.arange(high - low), np.diff(places.offsets.to_numpy()))
                at = places.flatten().to_numpy()
                begin = texts.first[row]
                here, end = begin + at, texts.first[row + 1]
                left = np.minimum(reach, at)
                right = np.minimum(reach, end - here - GRAM)
                before = _gathered(short, here - 1, left, reach, -1)
                after = _gathered(short, here + GRAM, right, reach, 1)
                context = grams[here].copy()
                for words, sizes in ((before, left), (after, right)):
                    context = mixed(context + sizes.astype(np.uint64))
                    for k in range(reach):
                        context = mixed(context ^ words[:, k].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low).take(pa.array(row)),
                        batch.column(1).slice(low).take(pa.array(row)),
                        pa.array(at), pa.array(grams[here].view(np.int64)),
                        pa.array(context.view(np.int64)),
                        pa.array([w[:n].tobytes() for w, n in zip(before, left.tolist())], pa.binary()),
                        pa.array([w[:n].tobytes() for w, n in zip(after, right.tolist())], pa.binary()),
                    ],
                    names=names,
                )

    return rows.mapInArrow(
        cut,
        "row_id long, doc_id long, at long, gram long, context long, left binary, right binary",
    )


def _gathered(codes, start, sizes, reach, step):
    """``[suffix, reach]`` word codes from ``start`` on, 0 behind ``sizes`` of them."""
    place = start[:, None] + step * np.arange(reach)[None, :]
    out = codes[np.clip(place, 0, max(0, len(codes) - 1))]
    out[np.arange(reach)[None, :] >= sizes[:, None]] = 0
    return out


def _matrix(column, reach):
    """Packed words of an Arrow column as ``[row, reach]`` and the number in each row."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    sizes = np.diff(offsets) // 4
    data = np.frombuffer(column.buffers()[2] or b"", np.uint32)[offsets[0] // 4 : offsets[-1] // 4]
    out = np.zeros((len(column), reach), np.uint32)
    out[np.arange(reach)[None, :] < sizes[:, None]] = data
    return out, sizes


def repeats(gram, left, n_left, right, n_right, reach):
    """For each suffix a bit for every number of words to the left with which the passage
    of ``reach`` more words than the run stands elsewhere too."""
    found = np.zeros(len(gram), np.uint64)
    if len(gram) < 2:
        return found
    # Big-endian bytes sort as the words do.
    follows = right.astype(">u4").view(f"S{4 * reach}").ravel()
    rank = np.empty(len(gram), np.int64)
    rank[np.argsort(follows, kind="stable")] = np.arange(len(gram))
    key = gram.astype(np.uint64)
    for o in range(reach + 1):
        if o:
            key = mixed(key ^ left[:, o - 1])
        able = np.flatnonzero((n_left >= o) & (n_right >= reach - o))
        order = able[np.lexsort((rank[able], key[able]))]
        a, b = order[:-1], order[1:]
        same = key[a] == key[b]
        a, b = a[same], b[same]
        alike = (right[a, : reach - o] == right[b, : reach - o]).all(axis=1)
        bit = np.uint64(1 << o)
        found[a[alike]] |= bit
        found[b[alike]] |= bit
    return found


def _groups(contexts: DataFrame, reach: int) -> DataFrame:
    """``(context, found, open)``: the bits of ``repeats`` for every distinct context.

    A word run with more than ``GROUP`` contexts is dealt out in parts; its passages are also
    given by their hashes (``open``), to be matched over all parts.
    """
    session = contexts.sparkSession
    distinct = contexts.groupBy("context").agg(
        F.first("gram").alias("gram"), F.first("left").alias("left"),
        F.first("right").alias("right"), F.count("*").alias("copies"),
    )
    distinct = stored(distinct, "contexts")
    sizes = distinct.groupBy("gram").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / F.lit(GROUP))
    rows = (
        distinct.join(sizes, "gram")
        .withColumn("part", F.pmod("context", parts).cast("int"))
        .withColumn("large", parts > 1)
        .repartition(partitions(session), "gram", "part")
        .sortWithinPartitions("gram", "part")
        .select("gram", "part", "context", "left", "right", "copies", "large")
    )

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < GROUP:
                continue
            gram, part = (held.column(k).to_numpy() for k in (0, 1))
            cut = len(gram) - 1
            last = np.flatnonzero((gram != gram[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield one(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield one(held)

    def one(table):
        batch = table.combine_chunks().to_batches()[0]
        gram = batch.column(0).to_numpy().view(np.uint64)
        left, n_left = _matrix(batch.column(3), reach)
        right, n_right = _matrix(batch.column(4), reach)
        # Parts of one run are apart.
        group = mixed(gram + batch.column(1).to_numpy().astype(np.uint64))
        found = repeats(group, left, n_left, right, n_right, reach)
        able = np.zeros(len(gram), np.uint64)
        for o in range(reach + 1):
            able |= ((n_left >= o) & (n_right >= reach - o)).astype(np.uint64) << np.uint64(o)
        found = np.where(batch.column(5).to_numpy() > 1, able, found)
        large = np.flatnonzero(batch.column(6).to_numpy(zero_copy_only=False))
        passages = _passages(gram[large], left[large], right[large], reach)
        opened = [[] for _ in range(len(gram))]
        for k, own, hashes in zip(large.tolist(), able[large].tolist(), passages.tolist()):
            opened[k] = [{"o": o, "passage": h} for o, h in enumerate(hashes) if own >> o & 1]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(2), pa.array(found.view(np.int64)),
                pa.array(opened, _OPEN),
            ],
            names=["context", "found", "open"],
        )

    return rows.mapInArrow(
        compare, "context long, found long, open array<struct<o:int,passage:long>>"
    )


_OPEN = pa.list_(pa.struct([("o", pa.int32()), ("passage", pa.int64())]))


def _passages(gram, left, right, reach):
    """``[suffix, o]``: a hash of the passage that begins ``o`` words before the run."""
    before, after = [gram.astype(np.uint64)], [gram.astype(np.uint64)]
    for k in range(reach):
        before.append(mixed(before[-1] ^ left[:, k]))
        after.append(mixed(after[-1] ^ right[:, k]))
    whole = [mixed(before[o] ^ mixed(after[reach - o] + np.uint64(o))) for o in range(reach + 1)]
    return np.stack(whole, axis=1).view(np.int64)


def repeated_spans(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """``(row_id, doc_id, start_word, end_word)``: what stands elsewhere too.

    The spans cover exactly the words that are part of a run of at least ``min_words`` equal
    words occurring twice or more, in other rows of ``docs (doc_id, text)`` or in the same;
    spans that touch are one.  All copies are given, the first among them.  Words are what
    stands between white space, compared as they are (by 64-bit hashes of the chosen run and
    32-bit hashes of each word around it).  NULL, empty and short texts have no span; rows
    without ``doc_id`` and repeated rows are rows like others; an empty table gives an empty
    result.  Other columns are not read.  A text of any length is read whole, by the task that
    holds it.  ``min_words`` is between 11 and 73, as that many words are compared at once.
    """
    if not 11 <= min_words <= 73:
        raise ValueError(f"min_words must be between 11 and 73, not {min_words}")
    reach = min_words - GRAM
    suffixes = stored(sampled_suffixes(docs, min_words), "suffixes")
    shared = suffixes.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    kept = suffixes.join(shared.select("gram"), "gram", "left_semi")
    contexts = stored(_contexts(docs, kept, min_words), "around")
    found = stored(_groups(contexts, reach), "found")
    opened = found.select("context", F.explode("open").alias("x")).select("context", "x.*")
    again = opened.groupBy("passage").agg(F.count("*").alias("n")).filter("n > 1")
    late = (
        opened.join(again, "passage", "left_semi")
        .groupBy("context")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("o"))).alias("late"))
    )
    bits = (
        found.select("context", "found")
        .join(late, "context", "left")
        .select(
            "context", F.col("found").bitwiseOR(F.coalesce("late", F.lit(0).cast("long"))).alias("found")
        )
        .filter("found <> 0")
    )
    # A run of bits from o to p is a span from p words before the place to where o's ends.
    runs = F.expr(
        f"filter(sequence(0, {reach}), o -> (found >> o) & 1 = 1 AND "
        f"(o = 0 OR (found >> (o - 1)) & 1 = 0))"
    )
    last = F.expr(
        f"filter(sequence(0, {reach}), o -> (found >> o) & 1 = 1 AND "
        f"(o = {reach} OR (found >> (o + 1)) & 1 = 0))"
    )
    spans = (
        contexts.select("row_id", "doc_id", "at", "context")
        .join(bits, "context")
        .select("row_id", "doc_id", "at", F.explode(F.arrays_zip(runs.alias("a"), last.alias("b"))).alias("r"))
        .select(
            "row_id", "doc_id", (F.col("at") - F.col("r.b")).alias("start_word"),
            (F.col("at") - F.col("r.a") + min_words).alias("end_word"),
        )
    )
    order = Window.partitionBy("row_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh_span = F.when(F.col("start_word") <= before, 0).otherwise(1)
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        spans.withColumn("new", fresh_span)
        .withColumn("island", island)
        .groupBy("row_id", "doc_id", "island")
        .agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
        .drop("island")
    )


def op2_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return repeated_spans(docs).select("doc_id", "start_word", "end_word")


OP2_SQL = r"""
WITH said AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
    SELECT doc_id, i, hash(list_slice(w, i + 1, i + 50)) AS h
    FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM said WHERE len(w) >= 50)
), again AS (
    SELECT doc_id, i FROM runs WHERE h IN (SELECT h FROM runs GROUP BY h HAVING count(*) > 1)
), cut AS (
    SELECT *, i > 50 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS new FROM again
), island AS (
    SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k
    FROM cut
)
SELECT doc_id, min(i) AS start_word, max(i) + 50 AS end_word FROM island GROUP BY doc_id, k
"""
