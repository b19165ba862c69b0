import gzip
from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from balance_spark.functions.cells import cell_flag, cell_value, is_missing
from balance_spark.sources import wide
from balance_spark.sources.tables import read_tidy, write_tidy

PRODUCTION_TEXT = (
    "freq,siec,unit,geo\\TIME_PERIOD\t2020-01 \t2020-02 \t2020-03 \n"
    "M,TOTAL,GWH,EL\t12.5 p\t: \t:\n"
    "M,TOTAL,GWH,FR\t1000 e\t:c\t: c\n"
    "M,CF,GWH,DE\t-3\t0\t7 ed\n"
    "M,CF,MWH,DE\t1\t2\t3\n"
    "M,OTHER,GWH,DE\t1\t2\t3\n"
)
EXPECTED = [
    ("CF", "DE", date(2020, 3, 1), 7.0, "DE;CF"),
    ("TOTAL", "FR", date(2020, 1, 1), 1000.0, "FR;TOTAL"),
    ("TOTAL", "GR", date(2020, 1, 1), 12.5, "GR;TOTAL"),
]


@pytest.mark.parametrize("zipped", [False, True])
def test_production_file(spark, rows, tmp_path, zipped):
    path = tmp_path / ("production.tsv.gz" if zipped else "production.tsv")
    path.write_bytes(gzip.compress(PRODUCTION_TEXT.encode()) if zipped else PRODUCTION_TEXT.encode())
    table = wide.read_wide(spark, str(path))
    assert set(dict(table.dtypes).values()) == {"string"}
    assert rows(wide.tidy_production(table)) == EXPECTED


def test_flag_is_kept_on_request(spark, rows, tmp_path):
    path = tmp_path / "production.tsv"
    path.write_text(PRODUCTION_TEXT)
    table = wide.tidy(wide.read_wide(spark, str(path)), wide.PRODUCTION_SOURCE, with_flag=True)
    assert rows(table, "state", "flag") == [("DE", "ed"), ("FR", "e"), ("GR", "p")]


def test_consumption_population_projection(spark, rows):
    consumption = spark.createDataFrame(
        [
            ("A,FC,E7000,GWH,EL", "5 d", ": "),
            ("A,FC_IND_E,E7000,GWH,DE", "0", "-4"),
            ("A,FC,E7000,GWH,EA20", "9", "9"),
            ("A,OTHER,E7000,GWH,DE", "9", "9"),
        ],
        ["freq,nrg_bal,siec,unit,geo\\TIME_PERIOD", "2020 ", "2021 "],
    )
    assert rows(wide.tidy_consumption(consumption)) == [
        ("FC", "GR", date(2020, 1, 1), 5.0, "GR;FC"),
        ("FC_IND_E", "DE", date(2020, 1, 1), 0.0, "DE;FC_IND_E"),
        ("FC_IND_E", "DE", date(2021, 1, 1), -4.0, "DE;FC_IND_E"),
    ]
    people = spark.createDataFrame(
        [("A,AVG,EL", "10 bep", None), ("A,JAN,EL", "11", "12")],
        ["freq,indic_de,geo\\TIME_PERIOD", "2020 ", "2021 "],
    )
    assert rows(wide.tidy_population(people)) == [("GR", date(2020, 1, 1), 10.0)]
    projected = spark.createDataFrame(
        [("A,JAN,BSL,DE", "10", ":"), ("A,JAN,LFRT,DE", "11", "12"), ("A,AVG,BSL,DE", "1", "1")],
        ["freq,indic_de,projection,geo\\TIME_PERIOD", "2030 ", "2031 "],
    )
    assert rows(wide.tidy_projection(projected)) == [("DE", date(2030, 1, 1), 10.0)]


def test_cells(spark, rows):
    cells = spark.createDataFrame(
        [
            ("123456789",), ("5 z",), ("5",), (" 1 234.5 p",), (":",), (": c",), ("",), (None,),
            ("abc",), ("1.2.3",), ("1.5E7",), ("2e",),
        ],
        "raw string",
    )
    raw = F.col("raw")
    assert rows(cells.select("raw", cell_value(raw), cell_flag(raw), is_missing(raw))) == sorted(
        [
            ("123456789", 123456789.0, None, False),
            ("5 z", 5.0, "z", False),
            ("5", 5.0, None, False),
            (" 1 234.5 p", 1234.5, "p", False),
            (":", None, None, True),
            (": c", None, "c", True),
            ("", None, None, True),
            (None, None, None, True),
            ("abc", None, "abc", False),
            ("1.2.3", None, None, False),
            ("1.5E7", 1.5e7, None, False),
            ("2e", 2.0, "e", False),
        ],
        key=repr,
    )


def test_quality_and_lenient_periods(spark, rows):
    table = spark.createDataFrame(
        [("M,TOTAL,GWH,DE", "1 p", "x", ":", "4"), ("M,TOTAL,GWH,FR", "2", "3", ":c", "4")],
        ["freq,siec,unit,geo\\TIME_PERIOD", "2020-01 ", "2020-02 ", "2020-03 ", "total "],
    )
    assert rows(wide.cell_quality(table, wide.PRODUCTION_SOURCE)) == sorted(
        [
            (date(2020, 1, 1), 2, 0, 1, 0),
            (date(2020, 2, 1), 2, 0, 1, 1),
            (date(2020, 3, 1), 2, 2, 0, 0),
            (None, 2, 0, 0, 0),
        ],
        key=repr,
    )
    assert wide.tidy_production(table).count() == 3
    strict = replace(wide.PRODUCTION_SOURCE, lenient_period=False)
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|DateTime"):
        wide.tidy(table, strict).collect()


def test_round_trip(spark, rows):
    tidy = [
        ("CF", state, date(2020, month, 1), float(month * 10), f"{state};CF")
        for state in ("DE", "FR")
        for month in range(1, 7)
    ]
    table = spark.createDataFrame(
        tidy, "siec string, state string, date date, energy_prod double, unique_id string"
    )
    periods = [f"2020-{m:02d}" for m in range(1, 7)]
    key = F.concat(F.lit("M,"), "siec", F.lit(",GWH,"), "state")
    cell = F.concat(F.col("energy_prod").cast("string"), F.lit(" e"))
    as_wide = (
        table.withColumn("period", F.date_format("date", "yyyy-MM"))
        .groupBy(key.alias("freq,siec,unit,geo\\TIME_PERIOD"))
        .pivot("period", periods)
        .agg(F.first(cell))
    )
    assert rows(wide.tidy_production(as_wide)) == sorted(tidy, key=repr)


def test_key_filter_runs_below_the_melt(spark, tmp_path):
    path = tmp_path / "production.tsv"
    path.write_text(PRODUCTION_TEXT)
    table = wide.tidy_production(wide.read_wide(spark, str(path)))
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("GWH"), plan


def test_written_table_is_pruned_by_category(spark, rows, tmp_path):
    table = spark.createDataFrame(EXPECTED, "siec string, state string, date date, "
                                            "energy_prod double, unique_id string")
    write_tidy(table, str(tmp_path / "tidy"), "siec")
    back = read_tidy(spark, str(tmp_path / "tidy"))
    assert rows(back, *table.columns) == EXPECTED
    chosen = back.filter(F.col("siec") == "CF")
    assert "PartitionFilters: [isnotnull(siec" in chosen._jdf.queryExecution().toString()
    assert rows(chosen, "state") == [("DE",)]


def test_files_with_different_periods(spark, rows, tmp_path):
    head = "freq,siec,unit,geo\\TIME_PERIOD"
    (tmp_path / "a.tsv").write_text(f"{head}\t2020-01\t2020-02\nM,CF,GWH,DE\t1.0\t2.0 p\n")
    (tmp_path / "b.tsv").write_text(
        "siec,freq,geo,unit\\TIME_PERIOD\t2020-02\t2020-03\t2020-04\n"
        "CF,M,EL,GWH\t3.0\t:\t4.0\n\nCF,M,FR,GWH\t5.0\n"
    )
    table = wide.tidy_files(spark, f"{tmp_path}/*.tsv", wide.PRODUCTION_SOURCE)
    got = [(s, str(d), v) for s, d, v in rows(table, "state", "date", "energy_prod")]
    assert sorted(got) == [
        ("DE", "2020-01-01", 1.0), ("DE", "2020-02-01", 2.0), ("FR", "2020-02-01", 5.0),
        ("GR", "2020-02-01", 3.0), ("GR", "2020-04-01", 4.0),
    ]
    (tmp_path / "c.tsv").write_text(f"{head}\t2020-01\nM,CF,GWH,IT\t1.0\t2.0\n")
    with pytest.raises(Exception, match="more cells than periods"):
        wide.tidy_files(spark, f"{tmp_path}/*.tsv", wide.PRODUCTION_SOURCE).collect()


def test_files_without_one_header_are_refused(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("siec,unit,geo\\TIME_PERIOD\t2020-01\nCF,GWH,DE\t1.0\n")
    (tmp_path / "empty.tsv").write_text("")
    (tmp_path / "blank.tsv").write_text("\n \n")
    read = wide.tidy_files(spark, f"{tmp_path}/*.tsv", wide.PRODUCTION_SOURCE)
    assert read.count() == 1
    assert wide.tidy_files(spark, f"{tmp_path}/[be]*.tsv", wide.PRODUCTION_SOURCE).count() == 0
    (tmp_path / "b.tsv").write_text("CF,GWH,DE\t1.0\n")
    with pytest.raises(ValueError, match="0 headers in .*b.tsv"):
        wide.tidy_files(spark, f"{tmp_path}/*.tsv", wide.PRODUCTION_SOURCE)
    (tmp_path / "b.tsv").write_text("unit,siec,geo\\TIME_PERIOD\t2020\n" * 2)
    with pytest.raises(ValueError, match="2 headers in .*b.tsv"):
        wide.tidy_files(spark, f"{tmp_path}/*.tsv", wide.PRODUCTION_SOURCE)


def test_data_lines_stay_where_they_are(spark, rows, tmp_path):
    """No join and no exchange over data lines; gzip files alone are spread, once filtered."""
    import gzip

    head = "siec,unit,geo\\TIME_PERIOD"
    for n in range(12):
        text = f"{head}\t2020-{n % 3 + 1:02d}\n" + "".join(f"CF,GWH,S{n}_{k}\t{k + 1}\n" for k in range(50))
        (tmp_path / f"f{n}.tsv").write_text(text)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = wide.tidy_files(spark, f"{tmp_path}/*.tsv", wide.PRODUCTION_SOURCE)
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan text") == 3
        assert table.count() == 600
        assert [r[0].month for r in rows(table.select("date").distinct())] == [1, 2, 3]
        with gzip.open(tmp_path / "g.tsv.gz", "wt") as file:
            file.write(f"{head}\t2020-01\n" + "".join(f"CF,GWH,G{k}\t1\n" for k in range(500)))
        table = wide.tidy_files(spark, f"{tmp_path}/*.tsv*", wide.PRODUCTION_SOURCE)
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("RoundRobinPartitioning") == 1 and "hashpartitioning" not in plan
        assert table.count() == 1100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_one_header_is_demanded(spark, tmp_path):
    for name, period in (("a", "2020-01"), ("b", "2020-02")):
        (tmp_path / f"{name}.tsv").write_text(f"siec,geo\\TIME_PERIOD\t{period}\nCF,DE\t1.0\n")
    with pytest.raises(Exception):
        wide.read_wide(spark, f"{tmp_path}/*.tsv").collect()
