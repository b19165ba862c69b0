"""The text files of ``tidy_text`` hold every cell of the supply table."""

from pyspark.sql import functions as F

from balance_spark.sources import star
from balance_spark.verify.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_no_cell_is_lost(spark):
    want = star.supply(spark, FOLDER).filter("energy_prod > 0")
    want = want.select("siec", "state", "date", F.col("energy_prod").cast("double"))
    got = QUERIES["tidy_text"](spark, FOLDER)
    got = got.select("siec", "state", "date", F.col("energy_prod").cast("double"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
