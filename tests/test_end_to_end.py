"""From wide text files to the balance report, with forecasts."""

from balance_spark.operators.forecast import with_forecast
from balance_spark.operators.members import member_filter
from balance_spark.plans.reports import balance_report
from balance_spark.sources import dims, wide
from balance_spark.sources.tables import read_tidy, write_tidy
from balance_spark.specs import (
    CONSUMPTION,
    CONSUMPTION_FORECAST,
    PRODUCTION,
    PRODUCTION_FORECAST,
)

STATES = {"DE": 10, "EL": 1, "FR": 8, "NO": 5, "EU27_2020": 19}


def write(path, header, periods, rows):
    lines = ["\t".join([header, *periods])]
    lines += ["\t".join([key, *cells]) for key, cells in rows]
    path.write_text("\n".join(lines) + "\n")


def test_files_to_report(spark, rows, tmp_path):
    months = [f"{year}-{month:02d} " for year in range(2018, 2024) for month in range(1, 13)]
    write(
        tmp_path / "production.tsv",
        "freq,siec,unit,geo\\TIME_PERIOD",
        months,
        [
            (f"M,TOTAL,GWH,{state}", [f"{size * (20 + i % 12)} p" for i in range(len(months))])
            for state, size in STATES.items()
        ],
    )
    write(
        tmp_path / "consumption.tsv",
        "freq,nrg_bal,siec,unit,geo\\TIME_PERIOD",
        [f"{year} " for year in range(2010, 2024)],
        [
            (f"A,FC,E7000,GWH,{state}", [f"{size * 300 - (state == 'FR') * 100}"] * 14)
            for state, size in STATES.items()
        ],
    )
    countries = dims.countries(spark)
    for name, tidy, category in (
        ("production", wide.tidy_production, "siec"),
        ("consumption", wide.tidy_consumption, "nrg_bal"),
    ):
        table = tidy(wide.read_wide(spark, str(tmp_path / f"{name}.tsv")))
        write_tidy(table, str(tmp_path / name), category)
    produced = member_filter(read_tidy(spark, str(tmp_path / "production")), countries)
    consumed = member_filter(read_tidy(spark, str(tmp_path / "consumption")), countries)
    report = balance_report(
        with_forecast(produced, PRODUCTION, PRODUCTION_FORECAST),
        with_forecast(consumed, CONSUMPTION, CONSUMPTION_FORECAST),
        countries,
        "2022-01-01",
    )
    # A year's production is size * 306; the aggregate is spread over 27 members.
    assert [tuple(r) for r in report["ranking"].collect()] == [
        ("FR", 148.0, "Maggiore"), ("DE", 60.0, "Maggiore"), ("GR", 6.0, "Maggiore"),
        ("EU", 4.0, "EU"),
    ]
    assert rows(report["map"]) == [("250", "FR", 148), ("276", "DE", 60), ("300", "GR", 6)]
    # Years after the last observation are the forecast's: four for the balance.
    assert rows(report["years"]) == [(year,) for year in range(2018, 2027)]
    assert report["has_forecast"].first()[0] is False
    span = report["forecast_span"].first()
    assert (span.start.year, span.end.year) == (2023, 2027)
    later = report["top"].filter("date = '2026-01-01'")
    assert rows(later, "rank", "state") == [(1, "FR"), (2, "DE"), (3, "GR")]
    # The season repeats and consumption is constant, so the balance does not move.
    assert all(
        abs(r.deficit - expected) <= 5
        for r, expected in zip(later.orderBy("rank").collect(), (148, 60, 6))
    )
