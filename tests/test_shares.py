from datetime import date

import pytest
from pyspark.sql import functions as F

from balance_spark.operators.per_capita import above_average, per_capita_vs_average
from balance_spark.operators.shares import (
    completeness,
    distinct_total,
    product_mix,
    sector_share,
    share_table,
    single_total,
)
from balance_spark.sources import dims
from balance_spark.specs import CONSUMPTION, PRODUCTION

DAY = date(2024, 1, 1)


def produced(spark, state="DE", day=DAY, **values):
    return spark.createDataFrame(
        [(state, day, siec, float(value), f"{state};{siec}") for siec, value in values.items()],
        "state string, date date, siec string, energy_prod double, unique_id string",
    )


def consumed(spark, state="DE", day=DAY, **values):
    return spark.createDataFrame(
        [(state, day, sector, float(value), f"{state};{sector}") for sector, value in values.items()],
        "state string, date date, nrg_bal string, energy_cons double, unique_id string",
    )


def test_labels_match_whole_codes(spark, rows):
    table = produced(spark, CF=1, CF_R=1, CF_NR=2, TOTAL=4)
    names = dims.labels(spark, dims.PRODUCT_LABELS)
    got = product_mix(table, PRODUCTION, names, ["CF", "CF_R", "CF_NR"])
    assert rows(got, "siec", "label", "percentage") == [
        ("CF", "Carburante Fossile", 25.0),
        ("CF_NR", "Fossile non Rinnovabile", 50.0),
        ("CF_R", "Fossile Rinnovabile", 25.0),
    ]


def test_repeated_categories_count_once(spark, rows):
    table = produced(spark, C0000=1, G3000=3)
    names = dims.labels(spark, dims.PRODUCT_LABELS)
    once = product_mix(table, PRODUCTION, names, dims.PRODUCT_PARTS)
    twice = product_mix(table.union(table), PRODUCTION, names, dims.PRODUCT_PARTS)
    assert rows(once) == rows(twice)


def test_sector_shares_add_up(spark, rows):
    names = dims.labels(spark, dims.SECTOR_LABELS)
    table = consumed(spark, FC=9, FC_IND_E=1, FC_TRA_E=1, FC_OTH_HH_E=1).union(
        consumed(spark, state="FR", FC=10, FC_IND_E=4, FC_OTH_AF_E=6)
    )
    got = sector_share(table, CONSUMPTION, names)
    sums = got.groupBy("state").agg(F.sum("percentage").alias("sum")).collect()
    assert all(abs(r["sum"] - 100) <= 0.03 for r in sums)
    wide = share_table(got, CONSUMPTION, ["DE", "FR"])
    assert rows(wide, "nrg_bal", "label_DE", "percentage_FR", "energy_cons_DE") == sorted(
        [
            ("FC_IND_E", "Industria", 40.0, 1.0),
            ("FC_TRA_E", "Trasporti", None, 1.0),
            ("FC_OTH_HH_E", "Familiare", None, 1.0),
            ("FC_OTH_AF_E", None, 60.0, None),
        ],
        key=repr,
    )


def test_zero_total_has_no_share(spark, rows):
    names = dims.labels(spark, dims.SECTOR_LABELS)
    got = sector_share(consumed(spark, FC_IND_E=0), CONSUMPTION, names)
    assert rows(got, "percentage") == [(None,)]


@pytest.mark.parametrize("part,missing", [(94, [("DE", DAY, 100.0, 94.0, 6.0)]), (96, []), (95, [])])
def test_missing_parts(spark, rows, part, missing):
    table = produced(spark, TOTAL=100, RA000=part, X9900=0, C0000=50)
    got = completeness(table, PRODUCTION, ["RA000", "X9900"])
    assert rows(got) == missing


def test_missing_parts_over_all_years(spark, rows):
    table = (
        produced(spark, TOTAL=100, RA000=100)
        .union(produced(spark, day=date(2023, 1, 1), TOTAL=100, RA000=60))
        .union(produced(spark, day=date(2010, 1, 1), TOTAL=500))
        .union(produced(spark, state="FR", TOTAL=10))
    )
    got = completeness(table, PRODUCTION, ["RA000"], by=("state",), since="2017-01-01")
    assert rows(got, "state", "missing_percentage") == [("DE", 20.0), ("FR", 100.0)]
    loose = completeness(
        table, PRODUCTION, ["RA000"], by=("state",), since="2017-01-01", tolerance=0.25
    )
    assert rows(loose, "state") == [("FR",)]


def test_totals(spark, rows):
    table = (
        produced(spark, TOTAL=10.9)
        .union(produced(spark, TOTAL=10.2))
        .union(produced(spark, day=date(2023, 1, 1), TOTAL=7, CF=3))
    )
    assert rows(distinct_total(table, PRODUCTION)) == [("DE", 17)]
    assert rows(single_total(table, PRODUCTION)) == [
        ("DE", date(2023, 1, 1), 7, True), ("DE", DAY, 10, True),
    ]
    doubtful = single_total(table.union(produced(spark, TOTAL=12)), PRODUCTION)
    assert rows(doubtful, "date", "unique") == [(date(2023, 1, 1), True), (DAY, False)]


def test_per_capita(spark, rows):
    table = (
        consumed(spark, FC=90, FC_IND_E=50.9, FC_TRA_E=10)
        .union(consumed(spark, state="EU27_2020", FC=900, FC_IND_E=300, FC_TRA_E=300))
        .union(consumed(spark, state="XX", FC_IND_E=300))
        .union(consumed(spark, day=date(2023, 1, 1), FC_IND_E=50))
    )
    people = spark.createDataFrame(
        [("DE", DAY, 30.0), ("EU27_2020", DAY, 300.0), ("DE", date(2023, 1, 1), 10.0)],
        "state string, date date, population double",
    )
    names = dims.labels(spark, dims.SECTOR_LABELS)
    got = per_capita_vs_average(table, people, CONSUMPTION, names)
    columns = ["state", "date", "label", "energy_cons_per_capita", "average"]
    assert rows(got, *columns) == [
        ("DE", DAY, "Industria", 1.66667, 1.0), ("DE", DAY, "Trasporti", 0.33333, 1.0),
    ]
    assert rows(above_average(got, CONSUMPTION), "label") == [("Industria",)]
    repeated = per_capita_vs_average(table.union(table), people, CONSUMPTION, names, date=DAY)
    assert rows(repeated, *columns) == rows(got, *columns)
    assert per_capita_vs_average(table, people, CONSUMPTION, names, states=["FR"]).count() == 0
