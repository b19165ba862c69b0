"""Tidy tables on disk."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where none is named, a local session makes one of its own; a cluster has to name it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="balance-checkpoint-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_tidy(table: DataFrame, path: str, category: str) -> None:
    """Write a tidy table as parquet, one folder per category.

    Every report filters on the category, so it becomes a partition filter.  The rows
    are rebalanced by category first: few and even files, a hot category split over as
    many tasks as its size asks for.
    """
    balanced = table.hint("rebalance", category)
    balanced.write.mode("overwrite").partitionBy(category).parquet(path)


def read_tidy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def written(table: DataFrame, name: str = "table") -> DataFrame:
    """The table, computed once and read back from the shared folder."""
    path = new_folder(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def revise_tidy(
    path: str,
    revision: DataFrame,
    category: str,
    version: str,
    keys: Sequence[str] = ("unique_id", "date"),
) -> None:
    """Bring revised observations into a written tidy table: the last revision of a cell wins.

    A cell is a category and ``keys``; of its rows, written and new, the one with the highest
    ``version`` (such as the date it was loaded) stays, the written one if equal, of new ones
    the greatest row.  A NULL version is the lowest.  Only partitions (categories) in which a
    row changes are written again; the files of all others stay as they are.  Written rows of
    categories that the revision does not touch are not even read.
    """
    columns = revision.columns
    spark = revision.sparkSession
    current = spark.read.schema(revision.schema).parquet(path).select(*columns)
    touched = revision.select(category).distinct()
    known = current.join(touched, current[category].eqNullSafe(touched[category]), "left_semi")
    rows = known.withColumn("_new", F.lit(False)).unionByName(revision.withColumn("_new", F.lit(True)))
    others = [name for name in columns if name not in (category, *keys)]
    row = F.struct("_new", *others)
    cells = (
        rows.groupBy(category, *keys)
        .agg(F.max_by(row, F.struct(F.col(version), ~F.col("_new"), row)).alias("_row"))
        .select(category, *keys, "_row.*")
    )
    changed = cells.filter("_new").select(F.col(category).alias("_changed")).distinct()
    kept = cells.join(changed, F.col(category).eqNullSafe(F.col("_changed")), "left_semi")
    (
        kept.select(*columns)
        .hint("rebalance", category)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(category)
        .parquet(path)
    )
