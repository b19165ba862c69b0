"""Wide statistical tables: read, melt to one row per cell, parse, filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from balance_spark.functions.cells import (
    cell_flag,
    cell_value,
    is_missing,
    period_start,
    state_code,
)
from balance_spark.sources.dims import PRODUCT_CODES, SECTOR_CODES
from balance_spark.specs import WideSource

POPULATION_SOURCE = WideSource("population", "yyyy", keep={"indic_de": ("AVG",)})
PROJECTION_SOURCE = WideSource(
    "population", "yyyy", keep={"indic_de": ("JAN",), "projection": ("BSL",)}
)
PRODUCTION_SOURCE = WideSource(
    "energy_prod",
    "yyyy-MM",
    keep={"unit": ("GWH",), "siec": PRODUCT_CODES},
    category="siec",
    positive=True,
    lenient_period=True,
)
CONSUMPTION_SOURCE = WideSource(
    "energy_cons",
    "yyyy",
    keep={"nrg_bal": SECTOR_CODES},
    category="nrg_bal",
    drop_states=("EA20",),
)


def read_wide(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Read tab-separated text, every column a string, nothing inferred.

    All files must have one header; another one is an error (``tidy_files`` takes any).
    A gzip file cannot be split, so its rows are spread over the cluster before the
    melt multiplies them; give ``partitions`` to choose how widely.
    """
    table = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="", enforceSchema=False)
    if partitions is None and path.endswith(".gz"):
        partitions = spark.sparkContext.defaultParallelism
    return table.repartition(partitions) if partitions else table


def key_parts(key_column: str) -> list[str]:
    """Names of the parts of a composite key, taken from its header."""
    parts = key_column.split("\\")[0].split(",")
    return ["state" if part == "geo" else part for part in parts]


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def melt(wide: DataFrame, source: WideSource) -> DataFrame:
    """One row per (key, period): the key parts, ``date`` and the ``raw`` cell.

    Codes are filtered on the wide rows, before the melt multiplies them, and the period
    headers become dates once per table: cells look theirs up by position.
    """
    key_column, *periods = wide.columns
    parts = key_parts(key_column)
    split_key = F.split(_quoted(key_column), ",")
    keyed = wide.select(
        *[split_key[i].alias(part) for i, part in enumerate(parts)],
        F.array(*[_quoted(period) for period in periods]).alias("cells"),
    )
    for part, codes in source.keep.items():
        keyed = keyed.filter(F.col(part).isin(*codes))
    if source.drop_states:
        keyed = keyed.filter(~F.col("state").isin(*source.drop_states))
    dates = F.array(
        *[period_start(F.lit(p), source.period, source.lenient_period) for p in periods]
    )
    return keyed.select(*parts, F.posexplode("cells").alias("position", "raw")).select(
        *parts, F.get(dates, F.col("position")).alias("date"), "raw"
    )


def files_by_header(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """Every distinct header of the files at ``path``, with the files that begin with it.

    A header is the line whose first field names the key's parts (it holds a backslash).
    One job looks for them; it brings one row per header to the driver, and the names of the
    files, which the driver lists to read them anyway.  A file without a header, or with
    two, is an error; blank lines and files without a line do not matter.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    is_header = F.instr(F.substring_index("value", "\t", 1), "\\") > 0
    headers = (
        lines.filter(F.trim("value") != "")
        .groupBy("file")
        .agg(
            F.count_if(is_header).alias("count"),
            F.max(F.when(is_header, F.col("value"))).alias("header"),
        )
        .groupBy("header", "count")
        .agg(F.array_sort(F.collect_list("file")).alias("files"))
        .orderBy("header")
        .collect()
    )
    for row in headers:
        if row["count"] != 1:
            raise ValueError(f"{row['count']} headers in {', '.join(row['files'])}")
    return [(row["header"], row["files"]) for row in headers]


def melt_text(lines: DataFrame, header: str, source: WideSource, partitions: int | None = None) -> DataFrame:
    """``melt`` of text lines (``value``) that all stand under one ``header``.

    A line with more cells than the header has periods is an error; one with fewer has no
    cells there.  With ``partitions`` the lines are spread after their codes are filtered.
    """
    key_column, *periods = header.split("\t")
    parts = key_parts(key_column)
    fields = F.split("value", "\t")
    excess = F.concat(F.lit("more cells than periods: "), F.substring("value", 1, 80))
    key = F.split(F.col("fields")[0], ",")
    keyed = (
        lines.filter((F.col("value") != header) & (F.trim("value") != ""))
        .select(
            F.when(F.size(fields) <= len(periods) + 1, fields)
            .otherwise(F.raise_error(excess))
            .alias("fields")
        )
        .select(
            *[key[i].alias(part) for i, part in enumerate(parts)],
            F.slice("fields", 2, F.size("fields")).alias("cells"),
        )
    )
    for part, codes in source.keep.items():
        keyed = keyed.filter(F.col(part).isin(*codes))
    if source.drop_states:
        keyed = keyed.filter(~F.col("state").isin(*source.drop_states))
    names = ["state", *source.keep]
    keyed = keyed.select(*names, "cells")
    if partitions:
        keyed = keyed.repartition(partitions)
    dates = F.array(
        *[period_start(F.lit(p), source.period, source.lenient_period) for p in periods]
    )
    return keyed.select(*names, F.posexplode("cells").alias("position", "raw")).select(
        *names, F.get(dates, F.col("position")).alias("date"), "raw"
    )


def tidy_files(
    spark: SparkSession, path: str, source: WideSource, with_flag: bool = False
) -> DataFrame:
    """Tab-separated files to a tidy table; every file is read under its own header.

    The headers are read first (``files_by_header``, the one job that runs here).  Then the
    files of each header are one scan whose cells look their period up by position, so no
    data line is joined or moved.  Only gzip files, which one task each has to read, have
    their kept lines spread over the cluster before the melt multiplies them.  The plan has
    a branch for each distinct header.
    """
    spread = spark.sparkContext.defaultParallelism
    melted = None
    for header, files in files_by_header(spark, path):
        packed = [name for name in files if name.endswith(".gz")]
        plain = [name for name in files if not name.endswith(".gz")]
        for chosen, partitions in ((plain, None), (packed, spread)):
            if chosen:
                part = melt_text(spark.read.text(chosen), header, source, partitions)
                melted = part if melted is None else melted.unionByName(part)
    if melted is None:
        names = ", ".join(f"{name} string" for name in ["state", *source.keep])
        melted = spark.createDataFrame([], f"{names}, date date, raw string")
    return _tidy(melted, source, with_flag)


def tidy(wide: DataFrame, source: WideSource, with_flag: bool = False) -> DataFrame:
    """Wide table to tidy table: ``[category,] state, date, <value> [, unique_id]``."""
    return _tidy(melt(wide, source), source, with_flag)


def _tidy(melted: DataFrame, source: WideSource, with_flag: bool) -> DataFrame:
    cells = melted.filter(F.col("raw").isNotNull() & ~is_missing(F.col("raw")))
    parsed = cells.select(
        *([F.col(source.category)] if source.category else []),
        state_code(F.col("state")).alias("state"),
        "date",
        cell_value(F.col("raw")).alias(source.value),
        *([cell_flag(F.col("raw")).alias("flag")] if with_flag else []),
    )
    value = F.col(source.value)
    kept = parsed.filter(value > 0 if source.positive else value.isNotNull())
    if source.lenient_period:
        kept = kept.filter(F.col("date").isNotNull())
    if source.category:
        kept = kept.withColumn(
            "unique_id", F.concat("state", F.lit(";"), source.category)
        )
    return kept


def cell_quality(wide: DataFrame, source: WideSource) -> DataFrame:
    """Per period: how many cells are missing, flagged, or hold no readable number."""
    raw = F.col("raw")
    value = cell_value(raw)
    return (
        melt(wide, source)
        .groupBy("date")
        .agg(
            F.count("*").alias("cells"),
            F.count_if(is_missing(raw)).alias("missing"),
            F.count_if(~is_missing(raw) & cell_flag(raw).isNotNull()).alias("flagged"),
            F.count_if(~is_missing(raw) & value.isNull()).alias("unreadable"),
        )
    )


def tidy_population(wide: DataFrame) -> DataFrame:
    return tidy(wide, POPULATION_SOURCE)


def tidy_projection(wide: DataFrame) -> DataFrame:
    return tidy(wide, PROJECTION_SOURCE)


def tidy_production(wide: DataFrame) -> DataFrame:
    return tidy(wide, PRODUCTION_SOURCE)


def tidy_consumption(wide: DataFrame) -> DataFrame:
    return tidy(wide, CONSUMPTION_SOURCE)
