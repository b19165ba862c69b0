import re

from balance_spark.llm import linededup


def test_copies_are_joined_by_place(documents, spark, capsys):
    """A very common line is not a key that all its copies meet at."""
    docs = documents(*[(d, f"one two three four\nown line {d}") for d in range(40)])
    gone = linededup.removed_lines(docs)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        gone.explain()
        plan = capsys.readouterr().out
        left = sorted((r["doc"], r["line"], r["copy"]) for r in gone.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert left == [(d, 0, True) for d in range(1, 40)]
    keys = re.findall(r"Join \[([^\]]*)\]", plan)
    assert [re.sub(r"#\d+L?", "", k) for k in keys] == ["row, line", "hash"]
