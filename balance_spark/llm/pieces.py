"""SentencePiece encoding by backtracking over longest matches.

A BPE encoding is settled by its neighbours: a row of tokens is what merging gives exactly
when merging any two adjacent tokens' characters gives these two tokens back.  (No merge
crosses a border of the whole that would not cross it in the pair.)  And each prefix of a
text has one encoding.  So a text is walked from the left: take the longest piece that begins
here, found by an Aho-Corasick automaton; keep it if it goes with the token before, else try
the next shorter piece; where none goes, give the last token back and mark its end as failed
in a bit field, so that no place is tried twice.
"""

from __future__ import annotations

import re
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
#: Fixed by the file format: the mark of a blank; field numbers and the number of "BPE".
BLANK = "▁"
_TRAINER, _MODEL_TYPE, _BYTE_FALLBACK, _BPE = 2, 3, 35, 2
_STEP = 1 << 21
_NEVER = float("-inf")


def _fields(data: bytes):
    """``(number, value)`` of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Failed:
    """A bit for each position of a text."""

    def __init__(self, size: int):
        self.bits = bytearray((size >> 3) + 1)

    def add(self, at: int):
        self.bits[at >> 3] |= 1 << (at & 7)

    def __contains__(self, at: int) -> bool:
        return self.bits[at >> 3] >> (at & 7) & 1 == 1


class _Chunks(dict):
    """Encodings of short chunks: those used since the last turn, and those of the turn before."""

    def __init__(self, encode, limit: int = 1 << 19, longest: int = 64):
        super().__init__()
        self.encode, self.limit, self.longest, self.before = encode, limit, longest, {}

    def __missing__(self, chunk):
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class MergeEncoder:
    """Encodes and decodes with one BPE model file (its bytes).

    The model must be of type BPE, with byte fallback, and without user-defined or unused
    pieces; others are refused.
    """

    def __init__(self, model: bytes):
        settings = {}
        for number, value in _fields(model):
            if number == _TRAINER:
                settings = dict(_fields(value))
        if settings.get(_MODEL_TYPE) != _BPE or not settings.get(_BYTE_FALLBACK):
            raise ValueError("the model is not BPE with byte fallback")
        self.library = library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids, self.scores, self.bytes = {}, {}, [0] * 256
        for k in range(library.get_piece_size()):
            piece = library.id_to_piece(k)
            if library.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
            elif library.is_unused(k):
                raise ValueError("the model has unused pieces")
            elif not (library.is_control(k) or library.is_unknown(k)):
                self.ids[piece], self.scores[piece] = k, library.get_score(k)
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[str, str | None] = {}
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
            cut = len(piece) - 1
            while cut > 1 and piece[:cut] not in self.ids:
                cut -= 1
            self.shorter[piece] = piece[:cut] if cut else None
        self.automaton.make_automaton()
        # Where no piece goes on with a blank after another character, no merge crosses there.
        apart = not any(re.search(f"[^{BLANK}]{BLANK}", piece) for piece in self.ids)
        # Nor where a character stands in no longer piece.
        inner = "".join(sorted({c for piece in self.ids if len(piece) > 1 for c in piece} - {BLANK}))
        inner = re.escape(inner)
        pattern = f"{BLANK}+[{inner}]*|[{inner}]+|[^{BLANK}{inner}]+" if apart else ".+"
        self.cut = re.compile(pattern, re.DOTALL).findall
        self.chunks = _Chunks(self.chunk_ids)
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by merging: best score first, then leftmost."""
        symbols, score = list(text), self.scores.get
        # The score of each symbol with the next; ``_NEVER`` where they make no piece.
        own = [score(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while own and (best := max(own)) > _NEVER:
            k = own.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del own[k]
            if k:
                own[k - 1] = score(symbols[k - 1] + symbols[k], _NEVER)
            if k < len(own):
                own[k] = score(symbols[k] + symbols[k + 1], _NEVER)
        return symbols

    def compatible(self, before: str, token: str) -> bool:
        """Whether merging the two again gives the two; ``before`` is empty at the start."""
        if len(self.pairs) >= 1 << 20:
            self.pairs.clear()
        wanted = [before, token] if before else [token]
        known = self.pairs[before, token] = self.merged(before + token) == wanted
        return known

    def tokens(self, text: str) -> list[str]:
        """The tokens of a normalised text; a character without a piece is one of its own."""
        size, path, at, before, failed = len(text), [], 0, "", None
        if not size:
            return path
        known, shorter = self.pairs.get, self.shorter.get
        longest = list(text)
        for end, piece in self.automaton.iter(text):
            longest[end - len(piece) + 1] = piece  # ends rise, so the longest stays
        token = longest[0]
        while True:
            end = at + len(token)
            if failed is None or end not in failed:
                good = known((before, token))
                if good is None:
                    good = self.compatible(before, token)
                if good:
                    path.append(token)
                    if end == size:
                        return path
                    at, before, token = end, token, longest[end]
                    continue
            token = shorter(token)
            while token is None:
                failed = failed or Failed(size)
                failed.add(at)
                token = path.pop()
                at -= len(token)
                before = path[-1] if path else ""
                token = shorter(token)

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        tokens = self.tokens(chunk)
        found = tuple(map(self.ids.get, tokens))
        if None not in found:
            return found
        spelled = ([k] if k is not None else self.spelled(t) for k, t in zip(found, tokens))
        return tuple(chain.from_iterable(spelled))

    def spelled(self, token: str) -> list[int]:
        """The byte pieces of a character that is no piece."""
        return [self.bytes[b] for b in token.encode()]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text, without begin and end ids; NULL and empty texts have none."""
        normal = self.library.normalize(text or "")
        return list(chain.from_iterable(map(self.chunks.__getitem__, self.cut(normal))))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_ENCODERS: dict[bytes, MergeEncoder] = {}


def _encoder(model: bytes) -> MergeEncoder:
    if model not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model] = MergeEncoder(model)
    return _ENCODERS[model]


PIECES = "doc_id long, ids array<int>, decoded string"
_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
)


def portions(texts, step: int):
    """Runs of rows with about ``step`` characters of text, or one longer row."""
    at = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > step:
            yield at, k
            at, size = k, 0
        size += len(text or "")
    if at < len(texts):
        yield at, len(texts)


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the ids of every whole text and what they decode to.

    ``model`` is the path of a model file (by default the public 32k one), read once on the
    driver and sent along: its size is that of the vocabulary, not of the data.  NULL and
    empty texts have no ids and decode to the empty text; repeated rows and rows without
    ``doc_id`` are encoded each; a text of any length is encoded whole, in time in proportion
    to it, in the task that reads it; an empty table gives no row.  Only ``doc_id`` and
    ``text`` are read, so other columns do not matter.  Nothing is shuffled.
    """
    with open(model or tokenizer_path(MODEL), "rb") as file:
        data = file.read()
    MergeEncoder(data)  # refuse a model that does not fit before any task runs
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def encode(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            docs_, texts = batch.column(0), batch.column(1).to_pylist()
            for low, high in portions(texts, _STEP):
                ids = [encoder.encode(text) for text in texts[low:high]]
                decoded_ = [encoder.decode(i) if i else "" for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        docs_.slice(low, high - low),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array(decoded_, pa.string()),
                    ],
                    schema=_PIECES,
                )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(encode, PIECES)


def op11_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
