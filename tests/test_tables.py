"""Revised observations in a written table."""

from datetime import date
from pathlib import Path

import pytest

from balance_spark.operators.lines import map_lines, stacked_area
from balance_spark.operators.shares import share_map
from balance_spark.sources.tables import read_tidy, revise_tidy, shared_folder, write_tidy
from balance_spark.specs import CONSUMPTION, PRODUCTION

SCHEMA = "siec string, state string, date date, energy_prod double, unique_id string, loaded date"


def cells(spark, *rows):
    return spark.createDataFrame(
        [(c, s, date(y, 1, 1), v, f"{s};{c}", loaded and date(2024, loaded, 1)) for c, s, y, v, loaded in rows],
        SCHEMA,
    )


def stamps(path):
    return {
        str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")
    }


def test_last_revision_wins(spark, rows, tmp_path):
    path = str(tmp_path / "tidy")
    write_tidy(
        cells(spark, ("CF", "DE", 2020, 1.0, 1), ("CF", "FR", 2020, 2.0, 1), ("RA", "DE", 2020, 3.0, 5),
              ("TOTAL", "DE", 2020, 4.0, 1)),
        path, "siec",
    )
    before = stamps(path)
    revise_tidy(
        path,
        cells(spark,
              ("CF", "DE", 2020, 10.0, 2), ("CF", "DE", 2020, 11.0, 3), ("CF", "DE", 2020, 12.0, None),
              ("CF", "DE", 2021, 5.0, None),  # a new cell
              ("RA", "DE", 2020, 99.0, 4), ("RA", "DE", 2020, 98.0, 5),  # stale, and no later
              ("NEW", "IT", 2020, 6.0, 1)),
        "siec", "loaded",
    )
    back = read_tidy(spark, path)
    assert rows(back, "siec", "state", "date", "energy_prod") == sorted(
        [
            ("CF", "DE", date(2020, 1, 1), 11.0), ("CF", "FR", date(2020, 1, 1), 2.0),
            ("CF", "DE", date(2021, 1, 1), 5.0), ("RA", "DE", date(2020, 1, 1), 3.0),
            ("TOTAL", "DE", date(2020, 1, 1), 4.0), ("NEW", "IT", date(2020, 1, 1), 6.0),
        ],
        key=repr,
    )
    after = stamps(path)
    untouched = {k: v for k, v in before.items() if "siec=CF" not in k}
    assert len(untouched) == 2 and untouched == {k: v for k, v in after.items() if k in untouched}
    assert not any(k in after for k in before if "siec=CF" in k)


def test_revision_without_news_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "tidy")
    table = cells(spark, ("CF", "DE", 2020, 1.0, 2), (None, "DE", 2020, 1.0, 2))
    write_tidy(table, path, "siec")
    before = stamps(path)
    revise_tidy(path, table, "siec", "loaded")
    revise_tidy(path, table.filter("false"), "siec", "loaded")
    assert stamps(path) == before
    revise_tidy(path, cells(spark, (None, "DE", 2020, 7.0, 3)), "siec", "loaded")
    assert sorted(r["energy_prod"] for r in read_tidy(spark, path).collect()) == [1.0, 7.0]


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark).startswith("file:") or "checkpoint" in shared_folder(spark)


def test_maps_hold_every_state(spark):
    """Whatever states the table has: one more than any list, and rows without a state."""
    states = [f"S{k}" for k in range(40)]
    table = cells(spark, *[("CF", s, 2020, float(k), 1) for k, s in enumerate([*states, "S3"])],
                  ("CF", None, 2020, 5.0, 1))
    (row,) = map_lines(table, PRODUCTION, "state").collect()
    assert row["values"] == {s: float(k) + (40.0 if s == "S3" else 0) for k, s in enumerate(states)}
    shared = table.selectExpr("date", "siec AS nrg_bal", "state", "'x' AS label", "1.5 AS percentage",
                              "energy_prod AS energy_cons")
    (row,) = share_map(shared, CONSUMPTION).collect()
    assert set(row["states"]) == set(states) and row["states"]["S3"]["energy_cons"] == 3.0


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_stacked_area_shuffles_once(spark, tmp_path, threshold):
    path = str(tmp_path / "table")
    table = cells(spark, ("CF", "DE", 2020, 1.0, 1)).selectExpr("*", "false AS predicted")
    table.write.parquet(path)
    plan = stacked_area(spark.read.parquet(path), PRODUCTION, ["CF"])._jdf.queryExecution()
    assert plan.executedPlan().toString().count("Exchange") == 1
