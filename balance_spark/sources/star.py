"""Supply, demand and population derived from an orders star schema.

Supply is the quantity shipped by the supplier's nation per part type and month,
demand the quantity ordered by the customer's nation per market segment and year.

Every fact table is read once, pruned to the columns in use, and shuffled once per
lookup; the aggregation per nation then combines before its own, small shuffle.  No side
is forced into a broadcast: Spark broadcasts what it measures to be small and otherwise
sort-merges, splitting the tasks of a key that holds a large part of all rows (adaptive
skew join).  Where a key repeats before a join it is aggregated first.  Totals over
categories and over member states come from exploding the aggregated rows, not from a
second pass over the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from balance_spark.functions.numbers import year_start
from balance_spark.specs import AGGREGATE, CONSUMPTION, PRODUCTION, Measure

MEMBER_REGION = "EUROPE"
PRODUCT_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
MEMBERS = ("NATION_3", "NATION_8", "NATION_13", "NATION_18", "NATION_23")
SEGMENT_LABELS = {
    "AUTOMOBILE": "Cars",
    "BUILDING": "Construction",
    "FURNITURE": "Home",
    "HOUSEHOLD": "Families",
    "MACHINERY": "Industry",
    "FC": "All sectors",
}
TYPE_LABELS = {
    "ECONOMY": "Economy goods",
    "LARGE": "Large goods",
    "MEDIUM": "Medium goods",
    "PROMO": "Promoted goods",
    "SMALL": "Small goods",
    "STANDARD": "Standard goods",
}
#: Years that the wide tables have columns for.
WIDE_YEARS = range(1992, 2008)
#: From here on the derived observations count as forecasts.
PREDICTED_FROM_MONTH = "2001-06-01"
PREDICTED_YEAR = "2001-01-01"


_schemas: dict[tuple, StructType] = {}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; its schema is looked up once for each state of the path, not by a job for
    every reader."""
    path = f"{folder}/{name}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    status = files.getFileStatus(place)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def nations(spark: SparkSession, folder: str) -> DataFrame:
    """The country dimension: ``state, name, iso_numeric, member`` per nation."""
    return (
        read(spark, folder, "nation")
        .join(read(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("state"),
            F.replace("n_name", F.lit("_"), F.lit(" ")).alias("name"),
            F.col("n_nationkey").alias("iso_numeric"),
            (F.col("r_name") == MEMBER_REGION).alias("member"),
        )
    )


def _states(member: Column) -> Column:
    return F.explode(
        F.when(member, F.array("state", F.lit(AGGREGATE))).otherwise(F.array("state"))
    )


def _with_totals(table: DataFrame, measure: Measure) -> DataFrame:
    """Add the total category and the aggregate of the member states."""
    return (
        table.withColumn("state", _states(F.col("member")))
        .withColumn(measure.category, F.explode(F.array(measure.category, F.lit(measure.total))))
        .groupBy(measure.category, "state", "date")
        .agg(F.sum(measure.value).alias(measure.value))
        .withColumn("unique_id", F.concat("state", F.lit(";"), measure.category))
    )


def _named(table: DataFrame, nation_key: str, spark: SparkSession, folder: str) -> DataFrame:
    dimension = nations(spark, folder)
    return table.join(dimension, F.col(nation_key) == F.col("iso_numeric"))


def supply(spark: SparkSession, folder: str) -> DataFrame:
    """``state, member, siec, date, energy_prod`` per nation, part type and month."""
    shipped = read(spark, folder, "lineitem").select(
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        F.trunc("l_shipdate", "month").alias("date"),
    )
    part = read(spark, folder, "part").select("p_partkey", F.col("p_type").alias("siec"))
    supplier = read(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    per_nation = (
        shipped.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "siec", "date")
        .agg(F.sum("l_quantity").alias("energy_prod"))
    )
    return _named(per_nation, "s_nationkey", spark, folder).select(
        "state", "member", "siec", "date", "energy_prod"
    )


def demand(spark: SparkSession, folder: str) -> DataFrame:
    """``state, member, nrg_bal, date, energy_cons`` per nation, segment and year."""
    per_order = (
        read(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("energy_cons"))
    )
    orders = read(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", year_start(F.col("o_orderdate")).alias("date")
    )
    customer = read(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", F.col("c_mktsegment").alias("nrg_bal")
    )
    per_nation = (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "nrg_bal", "date")
        .agg(F.sum("energy_cons").alias("energy_cons"))
    )
    return _named(per_nation, "c_nationkey", spark, folder).select(
        "state", "member", "nrg_bal", "date", "energy_cons"
    )


def production(spark: SparkSession, folder: str) -> DataFrame:
    """Tidy monthly production with total and aggregate rows."""
    return _with_totals(supply(spark, folder), PRODUCTION)


def consumption(spark: SparkSession, folder: str) -> DataFrame:
    """Tidy yearly consumption with total and aggregate rows."""
    return _with_totals(demand(spark, folder), CONSUMPTION)


def observed_population(spark: SparkSession, folder: str) -> DataFrame:
    """Ordering customers per nation and year, with the aggregate of the members.

    A customer belongs to one nation, so the distinct years of each customer can be
    counted after the join; collecting them per customer leaves both on one partitioning.
    """
    ordering = (
        read(spark, folder, "orders")
        .groupBy("o_custkey")
        .agg(F.collect_set(year_start(F.col("o_orderdate"))).alias("years"))
    )
    customer = read(spark, folder, "customer").select("c_custkey", "c_nationkey")
    per_nation = (
        ordering.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("date", F.explode("years"))
        .groupBy("c_nationkey", "date")
        .agg(F.count("*").cast("double").alias("population"))
    )
    return _people(per_nation, spark, folder)


def projected_population(spark: SparkSession, folder: str) -> DataFrame:
    """Customers per nation, carried forward to the years 2000 to 2003."""
    per_nation = (
        read(spark, folder, "customer")
        .groupBy("c_nationkey")
        .agg(F.count("*").cast("double").alias("population"))
        .withColumn("year", F.explode(F.sequence(F.lit(2000), F.lit(2003))))
        .select("c_nationkey", F.make_date("year", F.lit(1), F.lit(1)).alias("date"), "population")
    )
    return _people(per_nation, spark, folder)


def _people(per_nation: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    return (
        _named(per_nation, "c_nationkey", spark, folder)
        .withColumn("state", _states(F.col("member")))
        .groupBy("state", "date")
        .agg(F.sum("population").alias("population"))
    )


def flagged_production(spark: SparkSession, folder: str) -> DataFrame:
    """Production whose last months count as forecasts (2001 holds both kinds)."""
    return production(spark, folder).withColumn(
        "predicted", F.col("date") >= F.lit(PREDICTED_FROM_MONTH).cast("date")
    )


def flagged_consumption(spark: SparkSession, folder: str) -> DataFrame:
    """Consumption whose last year counts as a forecast with a 10% band."""
    predicted = F.col("date") == F.lit(PREDICTED_YEAR).cast("date")
    return consumption(spark, folder).withColumns(
        {
            "predicted": predicted,
            "low": F.when(predicted, F.col("energy_cons") * 0.9),
            "high": F.when(predicted, F.col("energy_cons") * 1.1),
        }
    )


def _periods(fmt: str) -> list[str]:
    months = [f"-{m:02d}" for m in range(1, 13)] if fmt == "yyyy-MM" else [""]
    return [f"{year}{month}" for year in WIDE_YEARS for month in months]


def _cells(table: DataFrame, key: dict[str, Column], value: str, fmt: str) -> DataFrame:
    """``key, period, cell``: the composite key and the text of each cell.

    Each cell gets a flag in every third period.  A row outside ``WIDE_YEARS`` is an error,
    not a lost cell.
    """
    flag = F.when((F.year("date") + F.month("date")) % 3 == 0, " p").otherwise("")
    outside = F.concat(F.lit("no column for "), F.col("date").cast("string"))
    dated = F.when(
        F.year("date").between(WIDE_YEARS[0], WIDE_YEARS[-1]), F.date_format("date", fmt)
    ).otherwise(F.raise_error(outside))
    return table.select(
        F.concat_ws(",", *key.values()).alias("key"),
        dated.alias("period"),
        F.concat(F.col(value).cast("decimal(38,2)").cast("string"), flag).alias("cell"),
    )


def _listed(table: DataFrame, key: dict[str, Column], value: str, fmt: str, periods) -> DataFrame:
    """``key, cells``: one array per key with a cell for each period, ``: `` where none is."""
    found = (
        _cells(table, key, value, fmt)
        .groupBy("key")
        .agg(F.map_from_entries(F.collect_list(F.struct("period", "cell"))).alias("found"))
    )
    # One lookup for each period, as a function: as columns they are too much for a method.
    return found.select(
        "key",
        F.transform(
            F.array(*[F.lit(p) for p in periods]),
            lambda p: F.coalesce(F.col("found")[p], F.lit(": ")),
        ).alias("cells"),
    )


def _as_wide(table: DataFrame, key: dict[str, Column], value: str, fmt: str) -> DataFrame:
    """A tidy table in the wide text layout: composite key, one column per period.

    The header has every period of ``WIDE_YEARS``; periods without a row read ``:``.
    """
    periods = _periods(fmt)
    header = ",".join(key) + "\\TIME_PERIOD"
    return _listed(table, key, value, fmt, periods).select(
        F.col("key").alias(header),
        *[F.col("cells")[i].alias(f"{p} ") for i, p in enumerate(periods)],
    )


def write_production_files(spark: SparkSession, folder: str, path: str) -> None:
    """The supply table as wide text under ``path``: files with three different headers.

    States with odd numbers have all periods in ``a.tsv``, the others have theirs in
    ``b.tsv`` and (the early ones, gzipped) in ``c.tsv``; together they hold every cell.
    """
    countries = nations(spark, folder)
    for file, odd, first, end in (
        ("a.tsv", 1, "1992", "9999"), ("b.tsv", 0, "1998", "9999"), ("c.tsv", 0, "1992", "1998")
    ):
        periods = [p for p in _periods("yyyy-MM") if first <= p < end]
        chosen = countries.filter(F.col("iso_numeric") % 2 == odd).select("state")
        rows = supply(spark, folder).join(chosen, "state", "left_semi")
        listed = _listed(rows, _production_key(), "energy_prod", "yyyy-MM", periods)
        header = "\t".join([",".join(_production_key()) + "\\TIME_PERIOD", *periods])
        written = listed.select(F.concat_ws("\t", F.col("key"), "cells").alias("value"))
        headed = written.mapInArrow(_with_header(header), "value string")
        packed = "gzip" if file == "c.tsv" else "none"
        headed.write.option("compression", packed).text(f"{path}/{file}")


def _with_header(header: str):
    """Lines of a task below a header of their own: each task writes one file."""

    def add(batches):
        first = True
        for batch in batches:
            if first and len(batch):
                yield type(batch).from_pydict({"value": [header]}, schema=batch.schema)
                first = False
            yield batch

    return add


def _production_key() -> dict[str, Column]:
    return {"freq": F.lit("M"), "siec": F.col("siec"), "unit": F.lit("GWH"), "geo": F.col("state")}


def wide_production(spark: SparkSession, folder: str) -> DataFrame:
    return _as_wide(supply(spark, folder), _production_key(), "energy_prod", "yyyy-MM")


def wide_consumption(spark: SparkSession, folder: str) -> DataFrame:
    key = {
        "freq": F.lit("A"),
        "nrg_bal": F.col("nrg_bal"),
        "siec": F.lit("E7000"),
        "unit": F.lit("GWH"),
        "geo": F.col("state"),
    }
    return _as_wide(demand(spark, folder), key, "energy_cons", "yyyy")


def wide_population(spark: SparkSession, folder: str) -> DataFrame:
    key = {"freq": F.lit("A"), "indic_de": F.lit("AVG"), "geo": F.col("state")}
    return _as_wide(observed_population(spark, folder), key, "population", "yyyy")


def wide_projection(spark: SparkSession, folder: str) -> DataFrame:
    key = {
        "freq": F.lit("A"),
        "indic_de": F.lit("JAN"),
        "projection": F.lit("BSL"),
        "geo": F.col("state"),
    }
    return _as_wide(projected_population(spark, folder), key, "population", "yyyy")
