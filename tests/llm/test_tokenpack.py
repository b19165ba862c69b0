import random

import numpy as np
import pyarrow.fs as pafs
import pytest

from balance_spark.llm import tokenpack
from balance_spark.llm.common import new_folder


@pytest.fixture(scope="module")
def encoding():
    with open(tokenpack.RANKS, "rb") as file:
        return tokenpack.encoder(file.read())


def test_pieces_equal_whole_texts(encoding):
    rng = random.Random(8)
    pieces = tokenpack._Pieces(encoding, np.dtype("<u2"))
    alphabet = ["a", "B", "é", "1", "'s", "don't", " ", "  ", "\n", "\n \n", "!", "ß", "語", "\t", " ", "\x1c", "\r"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text in [*texts, "", " ", "\n\n", "x " * 3000, "y" * 5000]:
        assert tokenpack.tokens(text, pieces).tolist() == encoding.encode_ordinary(text)


def test_segment_tree_finds_the_least_room():
    rng = random.Random(9)
    rooms, held = tokenpack.Rooms(100), []
    for k in range(3000):
        if held and rng.random() < 0.5:
            need = rng.randrange(101)
            fits = [r for r in held if r >= need]
            taken = rooms.take(need)
            assert (taken is None) == (not fits)
            if taken:
                assert taken[1] == min(fits)
                held.remove(taken[1])
        else:
            room = rng.randrange(101)
            rooms.put(room, k)
            held.append(room)


def test_round_trip(spark, documents, clashing, encoding):
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["red", "Grün", "b\n"]) for _ in range(rng.randrange(80))) for _ in range(90)]
    rows = [*enumerate(texts), (3, "again"), (None, "none"), (91, None), (92, ""), (93, "long " * 900)]
    folder = new_folder(spark, "tokens-test")
    index = tokenpack.write_packed(clashing(documents(*rows)), folder, length=64, window=500)
    read = {}
    for row in index.collect():
        filesystem, path = pafs.FileSystem.from_uri(row["path"])
        with filesystem.open_input_file(path) as file:
            ids = np.frombuffer(file.read_at(128, row["sequence"] * 128), "<u2")
        assert row["cu_seqlens"][-1] == row["n_tokens"] <= 64 and len(ids) == 64
        assert (ids[row["n_tokens"] :] == tokenpack.END_ID).all()
        assert row["position_resets"] == row["cu_seqlens"][:-1]
        positions = tokenpack.position_ids(row["cu_seqlens"], 64)
        for low, part in zip(row["cu_seqlens"], row["segments"]):
            read[part["doc_row"], part["start"]] = (part["doc_id"], ids[low : low + part["length"]])
            assert positions[low : low + part["length"]].tolist() == list(range(part["length"]))
    whole = {}
    for (doc_row, start), (doc, ids) in sorted(read.items()):
        before = whole.setdefault(doc_row, (doc, []))
        assert len(before[1]) == start
        before[1].extend(ids.tolist())
    want = [(d, [*encoding.encode_ordinary(t or ""), tokenpack.END_ID]) for d, t in rows]
    assert sorted(whole.values(), key=repr) == sorted(want, key=repr)
    segments = tokenpack.read_segments(index, length=64).collect()
    assert {(r["doc_row"], r["start"]): r["ids_hash"] for r in segments} == {
        k: tokenpack.ids_hash(v[1]) for k, v in read.items()
    }
    empty = documents((1, "x")).filter("false")
    assert tokenpack.write_packed(empty, new_folder(spark, "tokens-test")).count() == 0
