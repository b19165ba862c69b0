import random

from balance_spark.llm import linededup
from test_linededup import brute_force


def test_short_lines(documents):
    rng = random.Random(6)
    pool = ["Read more", "more Read", "All rights", "more", "more more", "a b", "b c", "a b a", ""]
    pool += ["Read more here now again", "Read more here now", " \t "]
    pool += [f"page {k}" for k in range(20)]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(3))) for d in range(40)]
    got = linededup.removed_lines(documents(*rows)).collect()
    assert {(r["doc"], r["line"]) for r in got} == brute_force(rows, least=1)


def test_texts_of_short_lines_go(documents, rows):
    docs = documents((1, "Read more\nAll rights"), (2, "All rights\n\nRead more"), (3, "Read more"))
    left = linededup.without_repeated_lines(docs)
    assert rows(left, "doc_id", "text") == [(1, "Read more\nAll rights"), (2, "")]
