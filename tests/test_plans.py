"""Plans and skew: what the queries do when the tables, or one key, grow."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from balance_spark.operators.lines import lines
from balance_spark.operators.maps import map_values
from balance_spark.sources import dims, star
from balance_spark.sources.tables import read_tidy, write_tidy
from balance_spark.specs import PRODUCTION
from balance_spark.verify.compare import compare, connect
from balance_spark.verify.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Queries that write files and read them again, which takes jobs of its own.
WRITERS = {
    "tidy_text", "revised_table", "report_balance_forecast", "report_production_forecast",
    "report_consumption_forecast",
}


@contextmanager
def settings(spark, **values):
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def planned(table):
    return table._jdf.queryExecution().executedPlan().toString()


def executed(table):
    table.collect()
    return planned(table).split("Initial Plan")[0]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairing_of_all_rows(spark, name):
    """Without broadcasts every join is still an equi-join, and no fact is read unpruned."""
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = planned(QUERIES[name](spark, FOLDER))
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "BroadcastExchange" not in plan  # nothing is broadcast without a size check
    for columns in re.findall(r"FileScan parquet \[(l_[^\]]*)\]", plan):
        assert len(columns.split(",")) <= 4, columns


@pytest.mark.parametrize(
    "name", ["forecast_category", "forecast_consumption", "lines_production", "lines_balance"]
)
def test_facts_are_scanned_once(spark, name):
    plan = executed(QUERIES[name](spark, FOLDER))
    scans = re.findall(r"FileScan parquet \[l_[^\]]*\]", plan)
    assert len(scans) == len({tuple(re.findall(r"l_[a-z]+", s)) for s in scans}), plan
    assert "ReusedExchange" in plan


def test_filters_reach_a_written_table(spark, tmp_path):
    write_tidy(star.flagged_production(spark, FOLDER), str(tmp_path / "tidy"), "siec")
    tidy = read_tidy(spark, str(tmp_path / "tidy"))
    shown = planned(lines(tidy, PRODUCTION, ["NATION_3"], "TOTAL"))
    assert "In(state" in shown or "EqualTo(state,NATION_3)" in shown
    assert re.search(r"PartitionFilters: \[[^\]]*siec[^\]]*TOTAL", shown)
    mapped = map_values(tidy, PRODUCTION, "2000-01-01", "TOTAL", dims.countries(spark))
    assert "EqualTo(date,2000-01-01)" in planned(mapped)
    assert re.search(r"ReadSchema: struct<state:string,date:date,energy_prod:double>", planned(mapped))


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """The star schema with one part, supplier, order and customer holding a third of it."""
    folder = tmp_path_factory.mktemp("skewed")
    hot = F.rand(7) < 1 / 3

    def copy(name, *columns):
        table = star.read(spark, FOLDER, name)
        for column in columns:
            first = table.agg(F.min(column)).first()[0]
            table = table.withColumn(column, F.when(hot, first).otherwise(F.col(column)))
        table.repartition(6).write.parquet(str(folder / f"{name}.parquet"))

    copy("lineitem", "l_partkey", "l_suppkey", "l_orderkey")
    copy("orders", "o_custkey")
    for name in ("customer", "part", "supplier", "nation", "region"):
        copy(name)
    return str(folder)


@pytest.mark.parametrize(
    "name",
    ["balance", "annual_sum", "population", "per_capita_vs_average", "product_mix",
     "top5_rank_by_year", "forecast_seasonal", "report_production"],
)
def test_hot_keys_change_no_result(spark, skewed, name):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        _, count, difference = compare(spark, connect(skewed), name, skewed)
    assert difference is None and count > 0


def test_hot_keys_are_split(spark, skewed):
    with settings(
        spark,
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="2KB",
        spark__sql__files__maxPartitionBytes="16KB",
        spark__sql__files__openCostInBytes="1KB",
    ):
        plan = executed(star.supply(spark, skewed))
    assert "skew=true" in plan, plan


def test_small_dimensions_do_not_shuffle_a_table(spark, tmp_path):
    """With default settings fixed rows are measured, so the table stays where it is."""
    from balance_spark.operators.members import member_filter

    path = str(tmp_path / "tidy")
    spark.range(100).selectExpr("'DE' AS state", "id AS energy_prod").write.parquet(path)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = member_filter(spark.read.parquet(path), dims.countries(spark))
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    assert plan.count() == 100


def test_no_job_runs_while_queries_are_built(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        star.read(spark, folder, name)
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        for name in sorted(set(QUERIES) - WRITERS):
            QUERIES[name](spark, folder)
            assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building"), name
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("page", ["balance", "production", "consumption"])
def test_a_page_computes_its_forecast_and_its_years_once(spark, page, monkeypatch):
    """Each is written once; the sections read what was written, no fact and no forecast."""
    from balance_spark.verify import queries

    made, kept = [], queries.written
    monkeypatch.setattr(queries, "written", lambda *given: (made.append(1), kept(*given))[1])
    plan = planned(QUERIES[f"report_{page}_forecast"](spark, FOLDER))
    # Two forecasts and the yearly balance; a forecast and two yearly tables; one of each.
    assert len(made) == {"balance": 3, "production": 3, "consumption": 2}[page]
    assert "l_quantity" not in plan and "l_orderkey" not in plan and "add_months" not in plan
