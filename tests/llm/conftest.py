import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang)``."""

    def make(*rows, schema=SCHEMA):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def clashing():
    """A table with columns that operators may use themselves."""

    def add(table):
        names = ("row_id", "hash", "n", "words", "fp", "score", "kept", "_words", "_text", "at")
        return table.selectExpr("*", *[f"'x' AS {n}" for n in names])

    return add


def words(n, seed=0, size=5000):
    """Words that hardly repeat."""
    import random

    rng = random.Random(seed)
    return [f"w{rng.randrange(size)}" for _ in range(n)]
