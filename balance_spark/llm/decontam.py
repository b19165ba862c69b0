"""Benchmark decontamination by edit distance: CGK embedding, bit sampling, exact check.

Items and documents are sequences of normalised words.  A window of a document that has the
length of an item is embedded by a random walk (CGK): step j emits the word under the pointer
and moves the pointer on by a random bit that depends on j and that word.  Sequences within a
small edit distance become sequences within a small Hamming distance, which sampled steps find
with a known chance; this is repeated until the wanted recall is reached.  What is found is
verified by the exact edit distance.

Windows are only embedded where they can match: a sequence within the edit bound of an item
has one of the item's word runs of the length that the pigeonhole principle gives, unchanged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balance_spark.llm.common import mixed

_WORD = re.compile(r"\w+")
MATCHES = (
    "doc_id long, item_id long, distance int, item_words int, start_word long, end_word long"
)


@dataclass(frozen=True)
class EditPlan:
    """``ratio``: edits allowed per word of an item; ``samples`` steps per key; ``rounds``."""

    ratio: float = 0.2
    samples: int = 3
    rounds: int = 40
    seed: int = 1
    block_bytes: int = 8 << 20

    def edits(self, words: int) -> int:
        return int(self.ratio * words + 1e-9)


def normalised(text: str | None) -> list[str]:
    """The words that are compared: lower case, without punctuation."""
    return _WORD.findall(text.lower()) if text else []


class _Vocabulary(dict):
    def __missing__(self, word):
        return 0


class ItemIndex:
    """A block of benchmark items: word numbers, word runs, and sampled embeddings.

    Word 0 is any word that no item has, word 1 stands behind the end of a document.
    """

    def __init__(self, items, plan: EditPlan):
        self.plan = plan
        self.vocabulary = _Vocabulary()
        ids: dict[tuple, list] = {}
        for item_id, text in items:
            key = tuple(
                self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in normalised(text)
            )
            if key:
                ids.setdefault(key, []).append(item_id)
        self.items = [np.array(k, np.int64) for k in ids]
        self.ids = list(ids.values())
        self.codes = mixed(
            np.arange(len(self.vocabulary) + 2, dtype=np.uint64) + np.uint64(plan.seed << 32)
        )
        runs: dict[int, list] = {}
        for number, item in enumerate(self.items):
            edits = plan.edits(len(item))
            length = -(-(len(item) - edits) // (edits + 1))
            for at in range(len(item) - length + 1):
                runs.setdefault(length, []).append((self._run(item, at, length), number, at))
        self.runs = {}
        for length, found in runs.items():
            found.sort()
            self.runs[length] = [
                np.array([f[0] for f in found], np.uint64),
                np.array([f[1:] for f in found], np.int64).reshape(-1, 2),
            ]
        self.tables = {}
        for size in sorted({len(i) for i in self.items}):
            numbers = [k for k, i in enumerate(self.items) if len(i) == size]
            keys = self.keys(np.stack([self.items[k] for k in numbers]))
            order = np.argsort(keys, axis=1)
            self.tables[size] = np.take_along_axis(keys, order, 1), np.array(numbers)[order]

    def _run(self, words, at, length):
        return int(_folded(self.codes[words[at : at + length]][None, :])[0])

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """``[round, window]``: a number made of the sampled steps of each embedding."""
        plan, (count, size) = self.plan, windows.shape
        rng = np.random.default_rng((plan.seed, size))
        steps = 3 * size
        codes = np.concatenate([self.codes[windows], np.full((count, 1), self.codes[1])], axis=1)
        codes = codes.ravel()
        base = np.arange(count) * (size + 1)
        keys = np.zeros((plan.rounds, count), np.uint64)
        for k in range(plan.rounds):
            odd = rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            # Late steps mostly see the end of a window and tell little.
            sampled = set(rng.choice(2 * size, min(plan.samples, 2 * size), replace=False).tolist())
            pointer = base.copy()
            for step in range(max(sampled) + 1):
                seen = codes[pointer]
                if step in sampled:
                    keys[k] = mixed(keys[k] ^ seen) + np.uint64(step)
                pointer += ((seen * odd[step]) >> np.uint64(63)).astype(np.int64)
                np.minimum(pointer, base + size, out=pointer)
        return keys

    def matches(self, texts) -> list[tuple]:
        """``(row, item number, distance, start, end)`` of every item found in every text."""
        get = self.vocabulary.__getitem__
        parts, bounds, at = [], [], 0
        for text in texts:
            found = normalised(text)
            bounds.append((at, at + len(found)))
            parts.append(np.fromiter(map(get, found), np.int64, len(found)))
            parts.append(np.zeros(1, np.int64))
            at += len(found) + 1
        if not self.items or not parts:
            return []
        words = np.concatenate(parts)
        starts, ends = np.array(bounds).T
        windows = self._windows(words, starts)
        return self._verified(words, starts, ends, self._candidates(words, starts, ends, windows))

    def _windows(self, words, starts):
        """By window length, the places where an item with a shared word run may begin."""
        known = words > 0
        codes = self.codes[words]
        found: dict[int, list] = {}
        sizes = np.array([len(i) for i in self.items])
        for length, (keys, places) in self.runs.items():
            count = len(words) - length + 1
            if count <= 0:
                continue
            whole = known[:count].copy()
            for k in range(1, length):
                whole &= known[k : count + k]
            at = np.flatnonzero(whole)
            values = _folded(np.stack([codes[at + k] for k in range(length)], axis=1))
            low = np.searchsorted(keys, values, "left")
            high = np.searchsorted(keys, values, "right")
            some = high > low
            at, low, high = at[some], low[some], high[some]
            row = np.repeat(np.arange(len(at)), high - low)
            which = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            item, offset = places[low[row] + which].T
            begin = at[row] - offset
            text = np.searchsorted(starts, at[row], "right") - 1
            for size in np.unique(sizes[item]):
                edits = self.plan.edits(int(size))
                mine = sizes[item] == size
                spread = begin[mine][:, None] + np.arange(-edits, edits + 1)[None, :]
                spread = np.maximum(spread, starts[text[mine]][:, None])
                found.setdefault(int(size), []).append(spread.ravel())
        return {size: np.unique(np.concatenate(w)) for size, w in found.items()}

    def _candidates(self, words, starts, ends, windows):
        """``(item, start)`` of windows that share a key with an item."""
        items, begins = [], []
        for size, at in windows.items():
            tables, numbers = self.tables[size]
            step = max(1, (1 << 20) // size)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                places = part[:, None] + np.arange(size)[None, :]
                end = ends[np.searchsorted(starts, part, "right") - 1]
                held = np.where(
                    places < end[:, None], words[np.minimum(places, len(words) - 1)], 1
                )
                for table, number, keys in zip(tables, numbers, self.keys(held)):
                    low = np.searchsorted(table, keys, "left")
                    high = np.searchsorted(table, keys, "right")
                    while (open_ := np.flatnonzero(high > low)).size:
                        items.append(number[low[open_]])
                        begins.append(part[open_])
                        low[open_] += 1
        if not items:
            return np.zeros((0, 2), np.int64)
        return np.unique(np.stack([np.concatenate(items), np.concatenate(begins)], 1), axis=0)

    def _verified(self, words, starts, ends, candidates):
        """The best place of each item in each text, where it is within the edit bound."""
        rows = []
        for number in np.unique(candidates[:, 0]):
            item = self.items[number]
            size, edits = len(item), self.plan.edits(len(item))
            begin = candidates[candidates[:, 0] == number, 1]
            text = np.searchsorted(starts, begin, "right") - 1
            # Windows that begin within the bound of another are checked with it.
            keep, last = [], None
            for k, (b, t) in enumerate(zip(begin.tolist(), text.tolist())):
                if last is None or t != last[1] or b - last[0] > edits:
                    keep.append(k)
                    last = b, t
            begin, text = begin[keep], text[keep]
            low = np.maximum(begin - edits, starts[text])
            width = size + 3 * edits + 1
            step = max(1, (1 << 21) // width)
            for k in range(0, len(low), step):
                part, own = low[k : k + step], text[k : k + step]
                places = part[:, None] + np.arange(width)[None, :]
                held = np.where(
                    places < ends[own][:, None], words[np.minimum(places, len(words) - 1)], -1
                )
                distance, end = _edit_distances(item, held)
                for j in np.flatnonzero(distance <= edits).tolist():
                    start = int(begin[k + j] - starts[own[j]])
                    stop = int(part[j] + end[j] - starts[own[j]])
                    rows.append((int(own[j]), int(number), int(distance[j]), start, stop))
        best: dict[tuple, tuple] = {}
        for row in rows:
            key = row[:2]
            if key not in best or row[2:] < best[key][2:]:
                best[key] = row
        return sorted(best.values())


def _folded(codes):
    """One number for each row of word codes."""
    total = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        total = mixed(total ^ codes[:, k]) + np.uint64(k)
    return total


def _edit_distances(item, regions):
    """The least edit distance of the item to a part of each region, and where that ends."""
    across = np.arange(regions.shape[1] + 1)
    row = np.zeros((len(regions), regions.shape[1] + 1), np.int64)
    for k, word in enumerate(item.tolist(), 1):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (regions != word), out=new[:, 1:])
        new[:, 0] = k
        row = np.minimum.accumulate(new - across, axis=1) + across
    return row.min(axis=1), row.argmin(axis=1)


def item_indexes(benchmark: DataFrame, plan: EditPlan):
    """Broadcast indexes of the items, each of about ``block_bytes`` of their text at most.

    A benchmark is a stated set of queries; however large it is, the driver and a task hold
    one block of it at a time, and documents are read once for each block.
    """
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // plan.block_bytes))
    context = benchmark.sparkSession.sparkContext
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield context.broadcast(ItemIndex([tuple(r) for r in part.collect()], plan))


_STEP = 1 << 22


def _portions(texts):
    """Runs of rows with a few MB of text, or one longer row."""
    at, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > _STEP:
            yield at, k
            at, size = k, 0
        size += len(text or "")
    if at < len(texts):
        yield at, len(texts)


def contaminations(
    docs: DataFrame, benchmark: DataFrame, plan: EditPlan = EditPlan()
) -> DataFrame:
    """One row for each document and item found in it, with its least distance and place.

    ``docs`` has ``doc_id, text``; ``benchmark`` has ``item_id, text``.  Both are compared as
    lower-case words without punctuation; at most ``ratio`` edits (of words) per word of the
    item are allowed.  Texts and items that are NULL or have no word match nothing; items
    with equal words are each reported; repeated rows are reported each; rows without
    ``doc_id`` are reported with NULL; empty tables give no row.  Other columns are not read.
    Texts of any length are searched whole, a few MB of texts, or one longer text, at a time.
    Windows with more edits than none are found with a chance that ``rounds`` raises (an
    unchanged passage always is).
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    found = None
    for index in item_indexes(benchmark, plan):

        def search(batches, index=index):
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                texts = batch.column("text").to_pylist()
                out = []
                for low, high in _portions(texts):
                    for row, item, distance, start, end in index.value.matches(texts[low:high]):
                        size = len(index.value.items[item])
                        for item_id in index.value.ids[item]:
                            out.append((ids[low + row], item_id, distance, size, start, end))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(c, pa.int32() if k in (2, 3) else pa.int64())
                            for k, c in enumerate(zip(*out))
                        ],
                        names=[c.split()[0] for c in MATCHES.split(", ")],
                    )

        part = rows.mapInArrow(search, MATCHES)
        found = part if found is None else found.unionByName(part)
    return found


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, plan: EditPlan = EditPlan()
) -> DataFrame:
    """The rows of ``docs`` in whose text no item is found; all columns stay as they are."""
    at = docs.columns.index("text")
    for index in item_indexes(benchmark, plan):

        def clean(batches, index=index):
            for batch in batches:
                texts = batch.column(at).to_pylist()
                keep = np.ones(len(texts), bool)
                for low, high in _portions(texts):
                    for row, *_ in index.value.matches(texts[low:high]):
                        keep[low + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return contaminations(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
