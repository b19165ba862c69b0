from datetime import date

from balance_spark.operators import lines, maps
from balance_spark.sources import dims
from balance_spark.specs import BALANCE, CONSUMPTION, PRODUCTION

D = [date(2024, m, 1) for m in range(1, 5)]
SCHEMA = "siec string, state string, date date, energy_prod double, unique_id string, predicted boolean"


def table(spark):
    data = []
    for state, factor in (("DE", 2.0), ("FR", 1.0), ("EU27_2020", 27.0)):
        for siec, part in (("TOTAL", 10), ("CF", 4), ("RA000", 6)):
            data += [
                (siec, state, d, factor * part + i, f"{state};{siec}", i >= 2)
                for i, d in enumerate(D)
            ]
    return spark.createDataFrame(data, SCHEMA)


def test_lines_and_last_points(spark, rows):
    shown = lines.lines(table(spark), PRODUCTION, ["DE", "EU27_2020"], "TOTAL")
    assert rows(shown, "state", "energy_prod") == [("DE", 20.0), ("DE", 21.0), ("DE", 22.0), ("DE", 23.0)]
    assert rows(lines.last_point(shown, "state"), "state", "date", "energy_prod") == [
        ("DE", D[3], 23.0)
    ]
    assert lines.last_point(shown.filter("NOT predicted"), "state").count() == 0


def test_span(spark):
    span = lines.forecast_span(table(spark)).first()
    assert (span.start, span.end) == (D[2], D[3])
    span = lines.forecast_span(table(spark), start="2023-01-01").first()
    assert (span.start, span.end) == (date(2023, 1, 1), D[3])


def test_pivot(spark, rows):
    one = table(spark).filter("siec = 'CF'")
    got = lines.pivot_lines(one, PRODUCTION, "state", ["DE", "FR", "IT"])
    assert got.columns == ["date", "DE", "FR", "IT"]
    assert rows(got)[0] == (D[0], 8.0, 4.0, None)


def test_member_average_and_domain(spark, rows):
    average = lines.member_average(table(spark), PRODUCTION, "TOTAL", 27)
    assert rows(average, "y2")[0] == (10.0,)
    low, high = lines.padded_domain(average, "y2").first()
    assert abs(low - 7.0) < 1e-9 and abs(high - 1.3 * 273 / 27) < 1e-9


def test_band(spark, rows):
    consumption = spark.createDataFrame(
        [
            ("FC", "DE", D[0], 9.0, "DE;FC", True, 8.0, 10.0),
            ("FC_IND_E", "DE", D[0], 5.9, "DE;FC_IND_E", True, 4.0, 6.0),
            ("FC_IND_E", "DE", D[1], 5.0, "DE;FC_IND_E", False, None, None),
            ("FC_IND_E", "FR", D[0], 5.0, "FR;FC_IND_E", True, 4.0, 6.0),
        ],
        "nrg_bal string, state string, date date, energy_cons double, unique_id string, "
        "predicted boolean, low double, high double",
    )
    assert rows(lines.interval_band(consumption, CONSUMPTION, "DE")) == [
        (D[0], "FC_IND_E", 4.0, 6.0)
    ]
    assert rows(lines.sector_lines(consumption, CONSUMPTION, "DE"), "energy_cons") == [(5,), (5,)]


def test_stacked_area(spark, rows):
    twice = table(spark).union(table(spark))
    got = lines.stacked_area(twice, PRODUCTION, ["RA000", "CF"], "DE", after="2024-01-01")
    assert rows(got, "date", "siec", "energy_prod", "stacked_to") == [
        (D[1], "CF", 9, 9), (D[1], "RA000", 13, 22),
        (D[2], "CF", 10, 10), (D[2], "RA000", 14, 24),
        (D[3], "CF", 11, 11), (D[3], "RA000", 15, 26),
    ]
    with_first = lines.stacked_area(
        twice, PRODUCTION, ["RA000"], "DE", after="2024-01-01", inclusive=True
    )
    assert with_first.count() == 4
    assert lines.stacked_area(twice, PRODUCTION, ["RA000"]).count() == 12


def test_map(spark, rows):
    balances = spark.createDataFrame(
        [("BE", D[0], "TOTAL;FC", 5.0), ("AT", D[0], "TOTAL;FC", -1.0), ("AT", D[0], "CF;FC", 0.0),
         ("EU27_2020", D[0], "TOTAL;FC", 99.0), ("BE", D[1], "TOTAL;FC", 6.0)],
        "state string, date date, def_id string, deficit double",
    )
    values = maps.map_values(balances, BALANCE, "2024-01-01", "TOTAL;FC", dims.countries(spark))
    assert rows(values) == [("040", "AT", -1.0), ("056", "BE", 5.0)]
    shapes = spark.createDataFrame([("040",), ("056",), ("840",)], "id string")
    assert rows(maps.map_table(shapes, values)) == sorted(
        [("040", "AT", -1.0), ("056", "BE", 5.0), ("840", None, None)], key=repr
    )
    assert tuple(maps.map_domain(values, BALANCE).first()) == (-1.0, 5.0)
