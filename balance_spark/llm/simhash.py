"""SimHash near-duplicates: blocks give candidates, pivot distances discard most of them.

Two fingerprints with at most three differing bits agree on three of six blocks, so they meet
under one of the 20 keys made of three blocks.  Among fingerprints with one key, distances to
fixed reference fingerprints (pivots) are compared: by the triangle inequality a pair differs
in no distance by more than it differs itself.  Pairs that pass are verified bit by bit.
Documents with equal fingerprints are one fingerprint throughout.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balance_spark.llm.common import WORD_BYTES, durable, fresh, mixed, partitions
from balance_spark.llm.components import components

_WORD = re.compile(WORD_BYTES)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SHINGLE, SEED = 3, 42
_PART = 1 << 15


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit number."""
    found = _WORD.findall(text.translate(_LOWER))
    if not found:
        return 0
    if len(found) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
        return int(np.array(hashes, np.uint64).view(np.int64)[0])
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - SHINGLE + 1].tolist()
    ends = ends[SHINGLE - 1 :].tolist()
    one, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _PART):
        part = zip(starts[at : at + _PART], ends[at : at + _PART])
        hashes = np.array([one(joined[a:b], SEED) for a, b in part], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    value = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(value.view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(row_id, doc_id, fp)`` of every row; ``row_id`` numbers the rows of the table."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def batch_fingerprints(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            values = pa.array([fingerprint(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), values],
                names=["row_id", "doc_id", "fp"],
            )

    return rows.mapInArrow(batch_fingerprints, "row_id long, doc_id long, fp long")


def _masks(bits: int) -> list[int]:
    """Masks that keep ``bits`` of ``2 * bits`` blocks of the 64 bits, as signed numbers."""
    blocks, low = [], 0
    for k in range(2 * bits):
        high = 64 * (k + 1) // (2 * bits)
        blocks.append(((1 << high) - 1) ^ ((1 << low) - 1))
        low = high
    kept = (sum(chosen) for chosen in combinations(blocks, bits))
    return [m - (1 << 64) if m >> 63 else m for m in kept]


def pivots(count: int = 16) -> np.ndarray:
    """Reference fingerprints; their bits come from a fixed rule."""
    return mixed(np.arange(7001, 7001 + count, dtype=np.uint64))


def links(distinct: DataFrame, *, bits: int = 3, group_rows: int = 4096) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints ``fp`` within ``bits`` of each other.

    Within a key every component is given as a star around its smallest fingerprint, so the
    rows follow the number of fingerprints, not of pairs.  A key with more than
    ``group_rows`` fingerprints is dealt out in chunks, and every pair of chunks is a group
    of its own; so no task ever holds a whole large key.
    """
    first = int(pivots(1).view(np.int64)[0])
    keys = F.array(
        *[
            F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("m"))
            for k, m in enumerate(_masks(bits))
        ]
    )
    keyed = distinct.select("fp", F.explode(keys).alias("key")).select("fp", "key.t", "key.m")
    shared = keyed.groupBy("t", "m").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(group_rows)).cast("int")
    dealt = (
        keyed.join(shared, ["t", "m"])
        .withColumn("own", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(
            "t", "m", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"),
            "fp", F.bit_count(F.col("fp").bitwiseXOR(F.lit(first))).alias("near"),
        )
    )
    by = ["t", "m", "c", "d"]
    rows = dealt.repartition(partitions(distinct.sparkSession), *by).sortWithinPartitions(
        *by, "near", "fp"
    )
    table = pivots()

    def compare(batches):
        held = None
        for batch in batches:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            changes = np.zeros(len(held[0]), bool)
            for column in held[:4]:
                changes[1:] |= column[1:] != column[:-1]
            group = np.cumsum(changes)
            if not len(group):
                continue
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if cut:
                yield _edges(group[:cut], held[4][:cut], table, bits)
                held = [column[cut:] for column in held]
        if held is not None and len(held[0]):
            changes = np.zeros(len(held[0]), bool)
            yield _edges(np.cumsum(changes), held[4], table, bits)

    return rows.select(*by, "fp").mapInArrow(compare, "a long, b long")


def _edges(group, fps, table, bits):
    """Stars of the components in each group; rows come sorted by group and first pivot."""
    fps = fps.view(np.uint64)
    far = np.bitwise_count(fps[:, None] ^ table[None, :]).astype(np.int8)
    root = np.arange(len(fps))
    alive = np.arange(len(fps))
    for step in range(1, len(fps)):
        alive = alive[alive + step < len(fps)]
        other = alive + step
        # Later rows of a group are only farther from the first pivot.
        near = (group[alive] == group[other]) & (far[other, 0] - far[alive, 0] <= bits)
        alive, other = alive[near], other[near]
        if not len(alive):
            break
        open_ = root[alive] != root[other]
        i, j = alive[open_], other[open_]
        passed = np.abs(far[i] - far[j]).max(axis=1, initial=0) <= bits
        i, j = i[passed], j[passed]
        linked = np.bitwise_count(fps[i] ^ fps[j]) <= bits
        i, j = i[linked], j[linked]
        while len(i):
            high, low = np.maximum(root[i], root[j]), np.minimum(root[i], root[j])
            np.minimum.at(root, high, low)
            while True:
                shorter = root[root]
                if np.array_equal(shorter, root):
                    break
                root = shorter
            differ = root[i] != root[j]
            i, j = i[differ], j[differ]
    tied = np.flatnonzero(root != np.arange(len(fps)))
    values = fps.view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(values[tied]), pa.array(values[root[tied]])], names=["a", "b"]
    )


def near_duplicates(docs: DataFrame, *, bits: int = 3) -> DataFrame:
    """``(row_id, doc_id, fp, component_id)`` of every row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` that the row reaches over links of at most
    ``bits`` differing bits.  NULL, empty and blank texts have fingerprint zero and are
    linked like any other; rows without ``doc_id`` belong to a component but never name it
    (NULL if none there has one); repeated rows stay, each with its row; an empty table gives
    an empty result.  Other columns are not read.  Texts of any length count whole: bits are
    counted over all their shingles.
    """
    prints = durable(fingerprints(docs))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = components(links(distinct, bits=bits)).withColumnRenamed("node", "fp")
    rooted = distinct.join(tied, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp")


def keep_one(docs: DataFrame, *, bits: int = 3) -> DataFrame:
    """The documents without near-duplicates of another: each component keeps one row.

    That is the row with the smallest ``doc_id``, the first in the table among equals; rows
    without ``doc_id`` come last.  All columns stay as they are.
    """
    (row,) = fresh(docs, "row_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_id"))
    kept = (
        near_duplicates(docs, bits=bits)
        .groupBy("root")
        .agg(F.min_by("row_id", order).alias(row))
        .select(row)
    )
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    return numbered.join(kept, row, "left_semi").drop(row)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
