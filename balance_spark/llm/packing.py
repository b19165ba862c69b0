"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balance_spark.llm.common import words

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
SCHEMA = (
    "doc_id long, piece long, piece_start long, n_tokens long, bin_id long, "
    "bin_offset long, bin_capacity long"
)


def cost(capacity: int) -> float:
    """What a sequence costs: its positions, attention over them, and a fixed share."""
    return capacity + capacity * capacity / 32768 + 16


def best_fit(lengths, capacities: Sequence[int], price: Callable[[int], float]):
    """Pack pieces into bins; ``(bin, offset, capacity of each bin)``.

    Pieces go in by decreasing length, each into the open bin that it leaves the least room
    in.  Where none has room a bin opens whose size has the least cost for a token of what
    is still to come.  Packing is done once for each set of the smallest sizes that hold the
    longest piece, every bin is cut down to the least size that holds its contents, and the
    packing with the least total cost is taken.
    """
    capacities = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths[order[0]]) if len(order) else 0
    best = None
    for count in range(1, len(capacities) + 1):
        sizes = capacities[:count]
        if sizes[-1] < longest:
            continue
        packed = _pack(lengths[order].tolist(), sizes, price)
        down = np.array(sizes)[np.searchsorted(sizes, packed[2])]
        total = sum(price(int(c)) * int(n) for c, n in zip(*np.unique(down, return_counts=True)))
        if best is None or total < best[0]:
            best = total, packed[0], packed[1], down
    bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    if best is None:
        return bins, offsets, np.zeros(0, np.int64)
    bins[order], offsets[order] = best[1], best[2]
    return bins, offsets, best[3]


def _pack(lengths, sizes, price):
    room = [[] for _ in range(sizes[-1] + 1)]  # bins by the room they have
    mask = 0  # bit r: some bin has room r
    left, bins, offsets, filled, held = sum(lengths), [], [], [], []
    for n in lengths:
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            b = len(filled)
            free = min(
                (s for s in sizes if s >= n), key=lambda s: (price(s) / max(1, min(s, left)), s)
            )
            filled.append(0)
            held.append(free)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        free -= n
        left -= n
        if free:
            room[free].append(b)
            mask |= 1 << free
    return bins, offsets, filled


def pack(
    docs: DataFrame,
    *,
    capacities: Sequence[int] = CAPACITIES,
    price: Callable[[int], float] = cost,
    window: int = 1 << 18,
) -> DataFrame:
    """Place every document of ``docs (doc_id, text)`` in bins; tokens are words.

    One row per piece: ``doc_id, piece, piece_start, n_tokens, bin_id, bin_offset,
    bin_capacity``.  Documents longer than the largest capacity are split into pieces of that
    length and a rest.  Documents without a word (NULL, empty, blank) have one piece of no
    tokens, without bin.  Repeated rows and rows without ``doc_id`` are packed like others;
    an empty table gives no row.  Other columns are not read.

    Nothing is shuffled: each task packs what it reads, up to ``window`` pieces at once, and
    bins never span tasks.  Against packing all at once that costs the last bins of a task,
    which are cut down like the others.
    """
    largest = max(capacities)
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size(words(F.col("text").cast("string"))).cast("long").alias("n"),
    )

    def place(batches):
        part, number = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for batch in batches:
            ids, n = batch.column("doc_id"), batch.column("n").to_numpy()
            pieces = np.maximum(1, -(-n // largest))
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            tokens = np.minimum(largest, n[row] - piece * largest)
            held.append((ids.take(pa.array(row)), piece, tokens))
            size += len(row)
            if size >= window:
                out, number = flush(held, part, number)
                yield out
                held, size = [], 0
        if size:
            yield flush(held, part, number)[0]

    def flush(held, part, number):
        ids = pa.concat_arrays([h[0] for h in held])
        piece, tokens = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        some = np.flatnonzero(tokens)
        bins, offsets, sizes = best_fit(tokens[some], capacities, price)
        columns = np.zeros((3, len(tokens)), np.int64)
        if len(some):
            columns[:, some] = bins + number + (part << 32), offsets, sizes[bins]
        none = tokens == 0
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(piece), pa.array(piece * largest), pa.array(tokens)]
            + [pa.array(c, mask=none) for c in columns],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        ), number + len(sizes)

    return sized.mapInArrow(place, SCHEMA)


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"))
