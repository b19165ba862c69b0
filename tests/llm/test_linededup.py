import random

from balance_spark.llm import linededup


def brute_force(rows, least=1):
    """``{(doc, line)}`` of the lines that go; rows have different ids."""
    lines = [
        (doc, k, frozenset(line.split()))
        for doc, text in sorted(rows)
        for k, line in enumerate((text or "").split("\n"))
        if len(line.split()) >= least
    ]
    gone = set()
    for i, (doc, k, own) in enumerate(lines):
        if any(10 * len(own & t) >= 8 * len(own | t) for _, _, t in lines[:i]):
            gone.add((doc, k))
    return gone


def variants(rng, line, count):
    out = []
    for _ in range(count):
        copy = list(line)
        for _ in range(rng.randrange(1 + max(3, len(line) // 5))):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_matches_brute_force(documents, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_LINES", 6)  # so that frequent words take two steps
    rng = random.Random(4)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 25))] for _ in range(12)]
    base += [[f"w{rng.randrange(900)}" for _ in range(n)] for n in (64, 80, 130)]
    pool = [v for line in base for v in variants(rng, line, 15)] + ["a b", "", "x y z", "z y x"]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(6))) for d in range(60)]
    got = linededup.removed_lines(documents(*rows)).collect()
    assert {(r["doc"], r["line"]) for r in got} == brute_force(rows)


def test_edges(documents, clashing, rows):
    docs = documents(
        (2, "one two three\nfour five six"), (1, "one two three"), (1, "one two three"),
        (3, None), (4, ""), (5, "short\none two three"), (None, "four five six"),
    )
    left = linededup.without_repeated_lines(clashing(docs))
    assert left.columns == clashing(docs).columns
    got = rows(left, "doc_id", "text", "n_chars")
    assert (2, "four five six", 13) in got and (5, "short", 5) in got
    assert got.count((1, "one two three", 13)) == 1  # the second row is the later one
    assert (3, None, 0) in got and (4, "", 0) in got
    assert not [r for r in got if r[0] is None]
    assert linededup.removed_lines(docs.filter("false")).count() == 0


def test_words_of_many_lines_do_not_multiply_rows(documents, monkeypatch):
    monkeypatch.setattr(linededup, "HOT_LINES", 8)
    made, keep = [], linededup.durable

    def counted(table):
        made.append(keep(table))
        return made[-1]

    monkeypatch.setattr(linededup, "durable", counted)
    rng = random.Random(9)
    # Each word stands in some 24 lines, two of them together in hardly any.
    lines = [[f"w{k}" for k in rng.sample(range(300), 12)] for _ in range(600)]
    lines += [line[:11] + ["other"] for line in lines[:20]]
    rows = [(d, " ".join(line)) for d, line in enumerate(lines)]
    got = linededup.removed_lines(documents(*rows)).collect()
    assert {(r["doc"], r["line"]) for r in got} == brute_force(rows) != set()
    assert max(table.count() for table in made) <= len(lines)


def test_all_candidates_of_a_line_are_asked(documents):
    """The line most alike is not always similar: all candidates of a line are asked."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(40)]
    pool = [" ".join(line) for n in (2, 3, 4, 5, 6) for line in variants(rng, base[: 8 * n], 12)]
    rows = list(enumerate(pool))
    got = linededup.removed_lines(documents(*rows)).collect()
    assert {(r["doc"], r["line"]) for r in got} == brute_force(rows)
