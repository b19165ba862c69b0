"""Token ids in packed binary matrices.

Every task turns the documents that it reads into token ids, packs them by decreasing length,
each into the fullest sequence that still has room for it, and appends the sequences to one
binary file: a matrix of ids, row after row.  Beside it stands a table with one row for each
sequence: cumulative segment lengths, the places where positions start again, and which part
of which document each segment is.
"""

from __future__ import annotations

import base64
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balance_spark.llm.common import durable, mixed, new_folder, task_file

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed values of the tokenizer: its split pattern and the id that ends a text.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
END_ID = 50256

#: Pieces between which the pattern always splits, where blanks are spaces and line feeds.
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
_OTHER_BLANK = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
_CACHE_PIECES = 400_000


def encoder(ranks: bytes):
    """A tiktoken encoding of a rank file's lines (id and base64 bytes)."""
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


class _Pieces(dict):
    """Ids of the pieces seen so far, as bytes; emptied when it has grown too large."""

    def __init__(self, encoding, kind):
        super().__init__()
        self.encode, self.kind = encoding.encode_ordinary, kind

    def __missing__(self, piece):
        ids = np.array(self.encode(piece), self.kind).tobytes()
        if len(self) < _CACHE_PIECES and len(piece) < 64:
            self[piece] = ids
        return ids


def _pieces(ranks: bytes, kind) -> _Pieces:
    """The worker's pieces, kept for its next task."""
    kept = sys.modules.setdefault("llm_token_pieces", types.ModuleType("llm_token_pieces"))
    key = hash((ranks, np.dtype(kind).str))
    if getattr(kept, "key", None) != key:
        kept.key, kept.pieces = key, _Pieces(encoder(ranks), kind)
    elif len(kept.pieces) >= _CACHE_PIECES:
        kept.pieces.clear()
    return kept.pieces


def tokens(text: str, pieces: _Pieces) -> np.ndarray:
    """The ids of a whole text; the same as encoding it at once."""
    if not text:
        return np.zeros(0, pieces.kind)
    if _OTHER_BLANK.search(text):
        return np.array(pieces.encode(text), pieces.kind)
    found = _PIECE.findall(text)
    return np.frombuffer(b"".join(map(pieces.__getitem__, found)), pieces.kind)


class Rooms:
    """A segment tree over the room that sequences have: the least that is enough."""

    def __init__(self, most: int):
        self.size = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.size)
        self.held: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.held[room].append(sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A sequence with the least room of at least ``need``, and that room."""
        at, count = need + self.size, self.count
        if not count[at]:
            # Up to the first right neighbour that has something, then down its left side.
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at <<= 1
                if not count[at]:
                    at += 1
        room = at - self.size
        self._add(room, -1)
        return self.held[room].pop(), room

    def _add(self, room, by):
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_decreasing(lengths, capacity: int):
    """``(sequence, offset)`` of every piece; no piece is longer than ``capacity``."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    rooms, count = Rooms(capacity), 0
    sequence, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    for k in order.tolist():
        need = int(lengths[k])
        taken = rooms.take(need)
        if taken is None:
            taken = count, capacity
            count += 1
        sequence[k], offset[k] = taken[0], capacity - taken[1]
        if taken[1] > need:
            rooms.put(taken[1] - need, taken[0])
    return sequence, offset, count


_SEGMENT = [("doc_row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]
_INDEX = pa.schema(
    [
        ("path", pa.string()), ("sequence", pa.int64()), ("n_tokens", pa.int64()),
        ("cu_seqlens", pa.list_(pa.int64())), ("position_resets", pa.list_(pa.int64())),
        ("segments", pa.list_(pa.struct(_SEGMENT))),
    ]
)
INDEX = (
    "path string, sequence long, n_tokens long, cu_seqlens array<long>, "
    "position_resets array<long>, "
    "segments array<struct<doc_row:long,doc_id:long,start:long,length:long>>"
)


def write_packed(
    docs: DataFrame,
    folder: str,
    *,
    ranks_path: str = RANKS,
    end_id: int = END_ID,
    length: int = 2048,
    window: int = 1 << 22,
) -> DataFrame:
    """Write packed sequences of ``docs (doc_id, text)``; return their index, computed.

    Ids are uint16 where the vocabulary fits, else uint32, little-endian; a file is a matrix
    with rows of ``length`` ids.  Each document ends with ``end_id``; what a sequence has no
    token for is filled with it, outside all segments.  Documents longer than ``length``
    are split into pieces of that length and a rest, nothing is left out.  NULL and empty
    texts are the end id alone.  Repeated rows and rows without ``doc_id`` are documents like
    others (``doc_row`` tells them apart); an empty table gives no file.  Other columns are
    not read.

    Nothing is shuffled: a task packs what it reads, about ``window`` tokens at once.
    """
    context = docs.sparkSession.sparkContext
    with open(ranks_path, "rb") as file:
        ranks = context.broadcast(file.read())
    rows = docs.select(
        F.monotonically_increasing_id().alias("doc_row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    kind = np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")

    def write(batches):
        pieces = _pieces(ranks.value, kind)
        batches = iter(batches)
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        filesystem, path = pafs.FileSystem.from_uri(folder)
        index: list[dict] = []

        def fill(stream):
            held, size, done, current = [], 0, 0, batch
            while current is not None:
                columns = [current.column(k).to_pylist() for k in range(3)]
                for row, doc, text in zip(*columns):
                    ids = np.append(tokens(text, pieces), kind.type(end_id))
                    held.append((row, doc, ids))
                    size += len(ids)
                    if size >= window:
                        done = put(stream, held, done)
                        held, size = [], 0
                current = next(batches, None)
            if held:
                put(stream, held, done)

        def put(stream, held, done):
            places = [
                (row, doc, start, ids[start : start + length])
                for row, doc, ids in held
                for start in range(0, len(ids), length)
            ]
            sizes = np.array([len(p[3]) for p in places])
            sequence, offset, count = best_fit_decreasing(sizes, length)
            for low in range(0, count, 1024):
                high = min(count, low + 1024)
                matrix = np.full((high - low, length), end_id, kind)
                inside = np.flatnonzero((sequence >= low) & (sequence < high))
                inside = inside[np.lexsort((offset[inside], sequence[inside]))]
                segments = [[] for _ in range(high - low)]
                for k in inside.tolist():
                    row, doc, start, ids = places[k]
                    at = int(offset[k])
                    matrix[sequence[k] - low, at : at + len(ids)] = ids
                    segments[sequence[k] - low].append(
                        {"doc_row": row, "doc_id": doc, "start": start, "length": len(ids)}
                    )
                stream.write(matrix.tobytes())
                for k, parts in enumerate(segments):
                    ends = np.cumsum([p["length"] for p in parts]).tolist()
                    index.append(
                        {
                            "sequence": done + low + k, "n_tokens": ends[-1],
                            "cu_seqlens": [0, *ends], "position_resets": [0, *ends[:-1]],
                            "segments": parts,
                        }
                    )
            return done + count

        final, _ = task_file(filesystem, path, ".bin", fill)
        name = folder.rstrip("/") + "/" + final.rsplit("/", 1)[1]
        for at in range(0, len(index), 2048):
            part = [{**r, "path": name} for r in index[at : at + 2048]]
            yield pa.RecordBatch.from_pylist(part, schema=_INDEX)

    return durable(rows.mapInArrow(write, INDEX))


def position_ids(cu_seqlens, length: int) -> np.ndarray:
    """The position of every id of a sequence: each segment, and the filling, begins at 0."""
    starts = np.asarray(cu_seqlens)
    place = np.arange(length)
    return place - starts[np.searchsorted(starts, place, "right") - 1]


def read_segments(index: DataFrame, *, end_id: int = END_ID, length: int = 2048) -> DataFrame:
    """Each segment as it stands in the files: ``doc_row, doc_id, start, n_tokens, path,
    sequence, offset, ids_hash`` (a hash of the ids in order)."""
    kind = np.dtype("<u2") if end_id < 1 << 16 else np.dtype("<u4")
    schema = (
        "doc_row long, doc_id long, start long, n_tokens long, path string, sequence long, "
        "offset long, ids_hash long"
    )

    def read(batches):
        for batch in batches:
            out, opened = [], {}
            for row in batch.to_pylist():
                if row["path"] not in opened:
                    opened.clear()
                    filesystem, inner = pafs.FileSystem.from_uri(row["path"])
                    opened[row["path"]] = filesystem.open_input_file(inner)
                data = opened[row["path"]].read_at(
                    length * kind.itemsize, row["sequence"] * length * kind.itemsize
                )
                ids = np.frombuffer(data, kind)
                for low, part in zip(row["cu_seqlens"], row["segments"]):
                    own = ids[low : low + part["length"]]
                    out.append(
                        (
                            part["doc_row"], part["doc_id"], part["start"], part["length"],
                            row["path"].rsplit("/", 1)[1], row["sequence"], low, ids_hash(own),
                        )
                    )
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in zip(*out)], schema=_READ
                )

    return index.mapInArrow(read, schema)


_READ = pa.schema(
    [
        ("doc_row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
        ("n_tokens", pa.int64()), ("path", pa.string()), ("sequence", pa.int64()),
        ("offset", pa.int64()), ("ids_hash", pa.int64()),
    ]
)


def ids_hash(ids) -> int:
    """A 64-bit hash of token ids that depends on their order."""
    place = np.arange(1, len(ids) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mixed(ids.astype(np.uint64) + place).sum(dtype=np.uint64).view(np.int64))


def op7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return read_segments(write_packed(docs, new_folder(spark, "tokens")))
