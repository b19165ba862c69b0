from datetime import date


from balance_spark.operators import catalogs
from balance_spark.operators.members import member_count, member_filter, only_states
from balance_spark.sources import dims
from balance_spark.specs import PRODUCTION


def tidy(spark, *states, siec="TOTAL"):
    return spark.createDataFrame(
        [(siec, s, date(2020, 1, 1), 1.0, f"{s};{siec}") for s in states],
        "siec string, state string, date date, energy_prod double, unique_id string",
    )


def test_member_states(spark, rows):
    countries = dims.countries(spark)
    assert countries.filter("member").count() == 27
    assert countries.select("state").distinct().count() == countries.count()
    assert spark.range(1).select(member_count(countries)).first()[0] == 27
    table = tidy(spark, "DE", "NO", "EU27_2020", "EA20", "GR", "UK")
    assert rows(member_filter(table, countries), "state") == [("DE",), ("EU27_2020",), ("GR",)]


def test_chosen_states(spark, rows):
    table = tidy(spark, "DE", "FR", "IT")
    assert rows(only_states(table, None), "state") == [("DE",), ("FR",), ("IT",)]
    assert rows(only_states(table, "FR"), "state") == [("FR",)]
    assert rows(only_states(table, ["FR", "IT"]), "state") == [("FR",), ("IT",)]
    repeated = spark.createDataFrame([("IT",), ("IT",)], "state string")
    assert rows(only_states(table, repeated), "state") == [("IT",)]


def test_state_lists(spark):
    table = tidy(spark, "FR", "DE", "EU27_2020", "DE", "XX")
    listed = catalogs.state_catalog(table, dims.countries(spark)).collect()
    assert [tuple(r) for r in listed] == [
        ("EU27_2020", "EU27_2020", "Unione Europea"),
        ("FR", "France", "France"),
        ("DE", "Germany", "Germany"),
        ("XX", "XX", "XX"),  # not in the dimension: goes by its code
    ]
    listed = catalogs.state_catalog_members(table, dims.countries(spark)).collect()
    assert [tuple(r) for r in listed] == [("FR", "France"), ("DE", "Germany"), ("XX", "XX")]
    names = spark.createDataFrame([("Greece",)], "name string")
    assert catalogs.state_code_of(names, dims.countries(spark)).first().state == "GR"


def test_category_lists(spark, rows):
    table = tidy(spark, "DE").union(tidy(spark, "DE", "FR", siec="CF"))
    assert [r[0] for r in catalogs.category_catalog(table, PRODUCTION).collect()] == ["CF", "TOTAL"]
    labelled = catalogs.category_labels(table, PRODUCTION, dims.labels(spark, dims.PRODUCT_LABELS))
    assert rows(labelled) == [("CF", "Carburante Fossile"), ("TOTAL", "Totale")]
    assert set(dims.PRODUCT_LABELS) == set(dims.PRODUCT_CODES) and len(dims.PRODUCT_CODES) == 15
    assert set(dims.SECTOR_TITLES) == set(dims.SECTOR_CODES)
    assert set(dims.PRODUCT_PARTS) < set(dims.PRODUCT_CODES)


def test_years(spark):
    def years(*dates):
        table = spark.createDataFrame([(d,) for d in dates], "date date")
        return [r.year for r in catalogs.year_domain(table).orderBy("year").collect()]

    assert years(date(2019, 5, 1), date(2022, 1, 1)) == [2019, 2020, 2021]
    assert years(date(2019, 5, 1), date(2019, 9, 1)) == []
    assert years() == []


def test_forecast_flag(spark):
    table = spark.createDataFrame(
        [(date(2020, 1, 1), False), (date(2021, 1, 1), True)], "date date, predicted boolean"
    )
    assert catalogs.has_forecast(table, "2021-01-01").first()[0] is True
    assert catalogs.has_forecast(table, date(2020, 1, 1)).first()[0] is False
    assert catalogs.has_forecast(table, "2022-01-01").first()[0] is False


def test_catalogs_need_no_self_join(spark):
    plan = member_filter(tidy(spark, "DE"), dims.countries(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in text and "Cartesian" not in text
