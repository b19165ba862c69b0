"""Run queries and their SQL twins side by side."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

from balance_spark.verify.oracles import ORACLES
from balance_spark.verify.queries import QUERIES


def connect(folder: str):
    connection = duckdb.connect()
    for file in sorted(Path(folder).glob("*.parquet")):
        source = file / "*.parquet" if file.is_dir() else file
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{source}'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    """Rows with columns in name order, sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(cells, key=repr)


def compare(spark, connection, name: str, folder: str):
    """``(seconds, number of rows, difference or None)``; no oracle gives no difference."""
    start = time.time()
    table = QUERIES[name](spark, folder)
    got = rows_of(table.columns, [tuple(row) for row in table.collect()])
    seconds = time.time() - start
    if name not in ORACLES:
        return seconds, len(got[1]), None
    answer = connection.execute(ORACLES[name])
    expected = rows_of([d[0] for d in answer.description], answer.fetchall())
    if got[0] != expected[0]:
        return seconds, len(got[1]), f"columns {got[0]} != {expected[0]}"
    if len(got[1]) != len(expected[1]):
        return seconds, len(got[1]), f"{len(got[1])} rows, expected {len(expected[1])}"
    for mine, theirs in zip(*(side[1] for side in (got, expected))):
        if mine != theirs or [type(m) for m in mine] != [type(t) for t in theirs]:
            return seconds, len(got[1]), f"{mine} != {theirs}"
    return seconds, len(got[1]), None
