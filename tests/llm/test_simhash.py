import random

import xxhash

from balance_spark.llm import simhash


def plain_fingerprint(text):
    blanks = {" ", "\t", "\n", "\x0b", "\x0c", "\r"}
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = "".join(" " if c in blanks else c for c in text).split(" ")
    found = [w for w in found if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    bits = [2 * sum(h >> b & 1 for h in hashes) > len(hashes) for b in range(64)]
    return sum(1 << b for b in range(64) if bits[b])


def plain_components(prints):
    """``{doc: smallest reachable}`` over ``{doc: fingerprint}``, by breadth-first search."""
    out = {}
    for start in sorted(prints):
        if start in out:
            continue
        todo = [start]
        out[start] = start
        while todo:
            x = todo.pop()
            for y in prints:
                if y not in out and (prints[x] ^ prints[y]).bit_count() <= 3:
                    out[y] = start
                    todo.append(y)
    return out


def test_fingerprints():
    texts = ["", "One", "one two", "A b C d", "x y  z\tq", "Ärger über ÄRGER " * 40]
    for text in texts:
        assert simhash.fingerprint(text.encode()) % (1 << 64) == plain_fingerprint(text)


def test_edge_rows(documents, clashing, rows):
    docs = documents((3, None), (1, ""), (2, " \n"), (5, "a b c d"), (5, "a b c d"), (None, "q"))
    got = rows(simhash.near_duplicates(clashing(docs)), "doc_id", "component_id")
    assert got.count((5, 5)) == 2
    assert {(1, 1), (2, 1), (3, 1), (None, None)} <= set(got)
    kept = rows(simhash.keep_one(docs), "doc_id")
    assert kept == sorted([(1,), (5,), (None,)], key=repr)
    assert simhash.keep_one(docs).columns == docs.columns
    assert rows(simhash.near_duplicates(documents((1, "x")).filter("false"))) == []


def test_links_match_brute_force(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(30)]
    prints = {c for c in centre}
    for c in centre:
        at = c
        for _ in range(40):  # chains, so that ends are far apart
            for _ in range(rng.randrange(1, 4)):
                at ^= 1 << rng.randrange(64)
            prints.add(at)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = plain_components({s: s % (1 << 64) for s in signed})
    for limit in (4096, 8):  # with and without dealing out large keys
        edges = simhash.links(table, group_rows=limit)
        tied = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        assert {s: tied.get(s, s) for s in signed} == want


def test_query_matches_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    tied = plain_components(prints)
    got = {tuple(r) for r in simhash.op5_simhash(spark, folder).collect()}
    assert got == {(d, f"{p:016x}", tied[d]) for d, p in prints.items()}
