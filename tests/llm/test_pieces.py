import hashlib
import random

import pytest
import sentencepiece
from public_tokenizers import path

from balance_spark.llm import pieces

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    with open(path(pieces.MODEL), "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_ids_equal_the_library(model, library):
    encoder, rng = pieces.MergeEncoder(model), random.Random(1)
    alphabet = [
        "a", "e", "th", "the", " ", "  ", "▁", "\n", "é", "語", "中文", "😀", "\x00", "\t", "ing",
        "aaaa", "0", "12", "<0x41>", "<s>", "</s>", "<unk>", "ñ", "    ", "é", "﻿",
    ]
    known = list(encoder.ids)
    for source, length in ((alphabet, 25), (known, 8)):
        for _ in range(8000):
            text = "".join(rng.choice(source) for _ in range(rng.randrange(length)))
            assert encoder.encode(text) == library.encode(text)


def test_failed_places_are_given_back(model, library):
    """A walk over a row of letters without blanks takes longest matches back."""
    encoder, rng = pieces.MergeEncoder(model), random.Random(2)
    added, old = [], pieces.Failed.add
    pieces.Failed.add = lambda self, at: (added.append(at), old(self, at))[1]
    try:
        for _ in range(300):
            text = "".join(rng.choice("abcdefghinorst") for _ in range(60))
            assert encoder.encode(text) == library.encode(text)
    finally:
        pieces.Failed.add = old
    assert added


@pytest.mark.parametrize(
    "text",
    ["a" * 70_000, " " * 50_000, "ab" * 60_000, "中文字" * 20_000, "▁▁x" * 900, "word. \n" * 40_000],
    ids=["a", "blank", "ab", "han", "mark", "words"],
)
def test_very_long_texts(model, library, text):
    assert pieces.MergeEncoder(model).encode(text) == library.encode(text)


def test_small_memories_change_nothing(model, library):
    encoder = pieces.MergeEncoder(model)
    encoder.chunks.limit = 3
    text = "one two three one four five two one six. seven\none two" * 20
    assert encoder.encode(text) == library.encode(text) and len(encoder.chunks.before) == 3


def test_table(spark, documents, clashing, library):
    rows = [(1, "Some words."), (1, "Some words."), (None, "no id"), (2, None), (3, ""), (4, " ")]
    rows += [(5, "long wörds " * 9000)]
    table = clashing(documents(*rows)).withColumn("ids", pieces.F.lit(1))
    got = sorted((tuple(r) for r in pieces.encoded(table).collect()), key=repr)
    want = [(d, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t in rows]
    assert got == sorted(want, key=repr)
    assert got[-1][2] == "no id"
    assert pieces.encoded(table.filter("false")).count() == 0


def test_other_models_are_refused(spark, documents):
    with pytest.raises(ValueError):
        pieces.MergeEncoder(b"\x12\x04\x18\x01\x98\x02\x01"[:3] + b"\x18\x01")


def test_query(spark, library):
    rows = pieces.op11_pieces(spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(texts)

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for doc, count, ids_digest, decoded_digest in rows:
        ids = library.encode(texts[doc])
        assert count == len(ids)
        assert ids_digest == digest(",".join(map(str, ids)))
        assert decoded_digest == digest(library.decode(ids))
