"""Every operator as a query over the star schema tables.

Each query takes ``(spark, folder)`` and reads whole tables.  Measures with decimals
are rounded, so that two engines that add in another order agree on them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balance_spark.operators import catalogs, lines, maps, per_capita, ranking, resample, shares
from balance_spark.operators.annual import annual, cast_measure
from balance_spark.operators.balance import population
from balance_spark.operators.forecast import (
    clip_nonnegative,
    forecast_auto,
    forecast_category,
    forecast_seasonal,
    forecast_smoothed,
    forecast_state,
    with_forecast,
)
from balance_spark.operators.members import member_count, member_filter, only_states
from balance_spark.plans.reports import (
    balance_report,
    consumption_report,
    production_report,
    yearly_balance,
)
from balance_spark.sources import star, wide
from balance_spark.sources.dims import labels
from balance_spark.sources.tables import new_folder, revise_tidy, write_tidy, written
from balance_spark.specs import (
    AGGREGATE,
    BALANCE,
    CONSUMPTION,
    CONSUMPTION_FORECAST,
    PRODUCTION,
    PRODUCTION_FORECAST,
)

YEAR = "2000-01-01"
SINCE = "1997-01-01"
FORECAST_MONTH = "2001-07-01"
#: A year that no observation reaches.
FORECAST_YEAR = "2003-01-01"
DEFAULT_STATES = ("NATION 1", "NATION 7", "NATION 13", "NATION 20")
#: Category, day of loading and factor of each revision of 1996; the last one is stale.
REVISIONS = (("PROMO", "2024-03-01", 2), ("TOTAL", "2024-02-01", 3), ("SMALL", "2023-01-01", 9))
#: Parts that do not explain the whole total.
SOME_PARTS = star.PRODUCT_TYPES[:-1]

PRODUCTION_SOURCE = replace(
    wide.PRODUCTION_SOURCE, keep={"unit": ("GWH",), "siec": star.PRODUCT_TYPES}
)
CONSUMPTION_SOURCE = replace(wide.CONSUMPTION_SOURCE, keep={"nrg_bal": star.SEGMENTS})


def rounded(table: DataFrame, digits: int = 6) -> DataFrame:
    return table.select(
        *[
            F.round(name, digits).alias(name) if kind == "double" else F.col(name)
            for name, kind in table.dtypes
        ]
    )


def _balance(spark, folder):
    return yearly_balance(
        star.flagged_production(spark, folder), star.flagged_consumption(spark, folder)
    )


def _population(spark, folder):
    return population(
        star.observed_population(spark, folder), star.projected_population(spark, folder)
    )


def _annual_production(spark, folder):
    return annual(star.flagged_production(spark, folder), PRODUCTION, collapse=True)


def _annual_consumption(spark, folder):
    return annual(star.flagged_consumption(spark, folder), CONSUMPTION, collapse=True)


def _points(table, measure):
    return resample.one_per_date(table, measure)


def _holed(spark, folder):
    """Monthly totals with every third month unknown."""
    points = _points(
        star.production(spark, folder).filter(F.col("siec") == PRODUCTION.total), PRODUCTION
    )
    return points.withColumn("y", F.when(F.month("ds") % 3 != 0, F.col("y")))


def tidy_production(spark, folder):
    return wide.tidy(star.wide_production(spark, folder), PRODUCTION_SOURCE, with_flag=True)


def tidy_consumption(spark, folder):
    return wide.tidy(star.wide_consumption(spark, folder), CONSUMPTION_SOURCE)


def tidy_population(spark, folder):
    return wide.tidy_population(star.wide_population(spark, folder))


def tidy_projection(spark, folder):
    return wide.tidy_projection(star.wide_projection(spark, folder))


def cell_quality(spark, folder):
    return wide.cell_quality(star.wide_production(spark, folder), PRODUCTION_SOURCE)


def balance(spark, folder):
    return rounded(_balance(spark, folder))


def members_only(spark, folder):
    return member_filter(star.production(spark, folder), star.nations(spark, folder))


def annual_sum(spark, folder):
    return annual(star.flagged_production(spark, folder), PRODUCTION)


def annual_mean(spark, folder):
    """Years with several rows: the observed one and two forecasts."""
    table = star.flagged_consumption(spark, folder)
    later = [
        table.withColumns(
            {
                "date": F.add_months("date", months),
                "energy_cons": F.col("energy_cons") * times,
                "predicted": F.lit(True),
            }
        )
        for months, times in ((4, 3), (8, 5))
    ]
    return rounded(annual(_stack([table, *later]), CONSUMPTION), 3)


def annual_mean_mixed(spark, folder):
    """The mean rule on months, where one year has both kinds of rows."""
    measure = replace(PRODUCTION, annual="mean")
    return rounded(annual(star.flagged_production(spark, folder), measure))


def annual_sum_collapsed(spark, folder):
    return _annual_production(spark, folder)


def cast_whole(spark, folder):
    sevenths = _balance(spark, folder).select(
        "state", "date", (F.col("deficit") / 7).alias("deficit")
    )
    return cast_measure(sevenths, BALANCE)


def state_catalog(spark, folder):
    return catalogs.state_catalog(star.production(spark, folder), star.nations(spark, folder))


def state_catalog_members(spark, folder):
    return catalogs.state_catalog_members(
        star.consumption(spark, folder), star.nations(spark, folder)
    )


def category_catalog(spark, folder):
    return catalogs.category_catalog(star.production(spark, folder), PRODUCTION)


def sector_labels(spark, folder):
    return catalogs.category_labels(
        star.consumption(spark, folder), CONSUMPTION, labels(spark, star.SEGMENT_LABELS)
    )


def year_domain(spark, folder):
    return catalogs.year_domain(star.consumption(spark, folder))


def has_forecast(spark, folder):
    return catalogs.has_forecast(star.flagged_production(spark, folder), FORECAST_MONTH)


def top_states(spark, folder):
    return ranking.top_states(
        _annual_consumption(spark, folder), CONSUMPTION, CONSUMPTION.total
    )


def forecast_auto_all(spark, folder):
    points = _points(star.production(spark, folder), PRODUCTION)
    return rounded(forecast_auto(points, PRODUCTION_FORECAST), 3)


def forecast_smoothed_all(spark, folder):
    points = _points(star.production(spark, folder), PRODUCTION)
    return rounded(forecast_smoothed(points, PRODUCTION_FORECAST), 3)


def forecast_upsampled_smoothed(spark, folder):
    points = _points(star.consumption(spark, folder), CONSUMPTION)
    return rounded(forecast_smoothed(points, CONSUMPTION_FORECAST), 3)


def forecast_seasonal_all(spark, folder):
    points = _points(star.production(spark, folder), PRODUCTION)
    return rounded(forecast_seasonal(points, PRODUCTION_FORECAST), 3)


def forecast_one_category(spark, folder):
    return rounded(
        forecast_category(
            star.production(spark, folder), PRODUCTION, PRODUCTION_FORECAST, PRODUCTION.total
        ),
        3,
    )


def forecast_category_seasonal(spark, folder):
    plan = replace(PRODUCTION_FORECAST, method="seasonal")
    return rounded(
        forecast_category(star.production(spark, folder), PRODUCTION, plan, PRODUCTION.total), 3
    )


def forecast_one_state(spark, folder):
    return rounded(
        forecast_state(star.production(spark, folder), PRODUCTION, PRODUCTION_FORECAST, AGGREGATE),
        3,
    )


def forecast_state_seasonal(spark, folder):
    plan = replace(PRODUCTION_FORECAST, method="seasonal")
    return rounded(forecast_state(star.production(spark, folder), PRODUCTION, plan, AGGREGATE), 3)


def date_grid(spark, folder):
    points = _points(star.consumption(spark, folder), CONSUMPTION)
    return resample.date_grid(points, CONSUMPTION_FORECAST.step_months)


def interpolate(spark, folder):
    return rounded(resample.interpolate(_holed(spark, folder)))


def forward_fill(spark, folder):
    return resample.forward_fill(_holed(spark, folder))


def upsample_interpolate(spark, folder):
    points = _points(star.consumption(spark, folder), CONSUMPTION)
    return rounded(resample.upsample(points, CONSUMPTION_FORECAST.step_months))


def forecast_upsampled(spark, folder):
    points = _points(star.consumption(spark, folder), CONSUMPTION)
    return rounded(forecast_auto(points, CONSUMPTION_FORECAST), 3)


def forecast_upsampled_seasonal(spark, folder):
    points = _points(star.consumption(spark, folder), CONSUMPTION)
    return rounded(forecast_seasonal(points, CONSUMPTION_FORECAST), 3)


def forecast_consumption(spark, folder):
    table = with_forecast(star.consumption(spark, folder), CONSUMPTION, CONSUMPTION_FORECAST)
    return rounded(table, 3)


def forecast_consumption_next_year(spark, folder):
    """The seasonal method, starting after the last observed year."""
    plan = replace(CONSUMPTION_FORECAST, method="seasonal")
    table = with_forecast(star.consumption(spark, folder), CONSUMPTION, plan, from_next_year=True)
    return rounded(table, 3)


def clipped(spark, folder):
    table = _balance(spark, folder).select("state", "date", "deficit")
    return clip_nonnegative(table, "deficit")


def population_mean(spark, folder):
    return rounded(_population(spark, folder))


def forecast_span(spark, folder):
    return lines.forecast_span(star.flagged_production(spark, folder))


def forecast_span_from(spark, folder):
    return lines.forecast_span(star.flagged_production(spark, folder), YEAR)


def state_code(spark, folder):
    countries = star.nations(spark, folder)
    names = catalogs.state_catalog(star.production(spark, folder), countries).select("name")
    return catalogs.state_code_of(names, countries)


def default_states(spark, folder):
    """Rows of a fixed selection of states, given by their names."""
    chosen = ranking.default_states(star.nations(spark, folder), DEFAULT_STATES)
    return only_states(star.production(spark, folder), chosen)


def tidy_text(spark, folder):
    """Tab-separated files with different periods, written to the shared folder and read."""
    path = new_folder(spark, "tidy-text")
    star.write_production_files(spark, folder, path)
    return wide.tidy_files(spark, f"{path}/*.tsv", PRODUCTION_SOURCE, with_flag=True)


def revised_table(spark, folder):
    """A written table after two revisions: later values, stale ones, and repeated cells."""
    path = new_folder(spark, "revised")
    table = star.production(spark, folder).withColumn("loaded", F.lit("2024-01-01").cast("date"))
    write_tidy(table, path, "siec")
    for category, loaded, times in REVISIONS:
        chosen = table.filter((F.col("siec") == category) & (F.year("date") == 1996))
        revision = chosen.withColumns(
            {"loaded": F.lit(loaded).cast("date"), "energy_prod": F.col("energy_prod") * times}
        )
        revise_tidy(path, revision, "siec", "loaded")
    back = spark.read.schema(table.schema).parquet(path)
    return rounded(back.select(*table.columns))


def date_grid_monthly(spark, folder):
    """Monthly totals on a grid of two months."""
    points = _points(
        star.production(spark, folder).filter(F.col("siec") == PRODUCTION.total), PRODUCTION
    )
    return rounded(resample.date_grid(points, 2))


def upsample_monthly(spark, folder):
    return rounded(resample.upsample(_points(star.production(spark, folder), PRODUCTION), 3))


def _spelled(value):
    return value.cast("decimal(38,2)").cast("string")


def lines_map(spark, folder):
    """Totals of every state side by side, names and sums as text."""
    table = star.production(spark, folder).filter(F.col("siec") == PRODUCTION.total)
    found = lines.map_lines(table, PRODUCTION, "state")
    return found.select(
        "date",
        F.concat_ws(",", F.map_keys("values")).alias("states"),
        F.concat_ws(",", F.transform(F.map_values("values"), _spelled)).alias("sums"),
    )


def sector_share_map(spark, folder):
    """Shares of every state side by side, as text."""
    found = shares.share_map(_sector_share(spark, folder), CONSUMPTION)
    rows = F.map_values("states")
    return found.select(
        "date",
        "nrg_bal",
        F.concat_ws(",", F.map_keys("states")).alias("states"),
        F.concat_ws(",", F.transform(rows, lambda r: r["label"])).alias("labels"),
        F.concat_ws(",", F.transform(rows, lambda r: _spelled(r["percentage"]))).alias("percentages"),
        F.concat_ws(",", F.transform(rows, lambda r: _spelled(r["energy_cons"]))).alias("sums"),
    )


def upsample_daily(spark, folder):
    """Order values of every day, averaged per month and put on the monthly grid."""
    orders, customer = star.read(spark, folder, "orders"), star.read(spark, folder, "customer")
    nation = star.read(spark, folder, "nation")
    daily = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("unique_id"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("o_totalprice").cast("double").alias("price"),
        )
    )
    points = resample.one_per_date(daily, replace(PRODUCTION, value="price"))
    return rounded(resample.upsample(points, 1))


def _map_values(spark, folder):
    countries = star.nations(spark, folder)
    yearly = member_filter(_balance(spark, folder), countries)
    return maps.map_values(yearly, BALANCE, YEAR, BALANCE.total, countries)


def map_table(spark, folder):
    shapes = star.nations(spark, folder).select(
        F.lpad(F.col("iso_numeric").cast("string"), 3, "0").alias("id")
    )
    return maps.map_table(shapes, _map_values(spark, folder))


def map_domain(spark, folder):
    return maps.map_domain(_map_values(spark, folder), BALANCE)


def lines_production(spark, folder):
    table = star.flagged_production(spark, folder)
    chosen = ranking.top_states(table, PRODUCTION, PRODUCTION.total)
    return lines.lines(table, PRODUCTION, chosen, PRODUCTION.total)


def lines_pivot(spark, folder):
    table = star.production(spark, folder).filter(F.col("siec") == PRODUCTION.total)
    return lines.pivot_lines(table, PRODUCTION, "state", star.MEMBERS)


def lines_pivot_sectors(spark, folder):
    table = lines.sector_lines(
        star.flagged_consumption(spark, folder), CONSUMPTION, AGGREGATE
    )
    return lines.pivot_lines(table, CONSUMPTION, "nrg_bal", star.SEGMENTS)


def last_point(spark, folder):
    table = lines.lines(
        star.flagged_production(spark, folder), PRODUCTION, category=PRODUCTION.total
    )
    return lines.last_point(table, "state")


def _member_average(spark, folder):
    return lines.member_average(
        star.flagged_production(spark, folder),
        PRODUCTION,
        PRODUCTION.total,
        member_count(star.nations(spark, folder)),
    )


def member_average(spark, folder):
    return rounded(_member_average(spark, folder))


def padded_domain(spark, folder):
    return rounded(lines.padded_domain(_member_average(spark, folder), "y2"))


def interval_band(spark, folder):
    return rounded(
        lines.interval_band(star.flagged_consumption(spark, folder), CONSUMPTION, AGGREGATE)
    )


def lines_balance(spark, folder):
    yearly = cast_measure(_balance(spark, folder), BALANCE)
    return lines.lines(yearly, BALANCE, ranking.top_states(yearly, BALANCE, BALANCE.total))


def stacked_area(spark, folder):
    """With rows that are there twice, which count once."""
    table = star.flagged_production(spark, folder)
    table = table.unionByName(table.filter(F.month("date") == 3))
    return lines.stacked_area(table, PRODUCTION, star.PRODUCT_TYPES, after=SINCE)


def stacked_area_inclusive(spark, folder):
    return lines.stacked_area(
        star.flagged_production(spark, folder),
        PRODUCTION,
        star.PRODUCT_TYPES,
        states=AGGREGATE,
        after=SINCE,
        inclusive=True,
    )


def completeness_year(spark, folder):
    return rounded(shares.completeness(_annual_production(spark, folder), PRODUCTION, SOME_PARTS))


def completeness_all(spark, folder):
    return rounded(
        shares.completeness(
            _annual_production(spark, folder),
            PRODUCTION,
            SOME_PARTS,
            by=("state",),
            since=SINCE,
        )
    )


def distinct_total(spark, folder):
    return shares.distinct_total(star.production(spark, folder), PRODUCTION)


def single_total(spark, folder):
    """With a second total in every other year."""
    table = star.consumption(spark, folder)
    second = table.filter(F.year("date") % 2 == 0).withColumn(
        "energy_cons", F.col("energy_cons") + 7
    )
    return shares.single_total(table.unionByName(second), CONSUMPTION)


def top5_rank_by_year(spark, folder):
    return rounded(ranking.top_rank_by_year(cast_measure(_balance(spark, folder), BALANCE)))


def balance_ranking(spark, folder):
    members = member_count(star.nations(spark, folder))
    return ranking.balance_ranking(_balance(spark, folder), YEAR, members)


def _sector_share(spark, folder):
    return shares.sector_share(
        _annual_consumption(spark, folder), CONSUMPTION, labels(spark, star.SEGMENT_LABELS)
    )


def sector_share(spark, folder):
    return rounded(_sector_share(spark, folder))


def sector_share_wide(spark, folder):
    return shares.share_table(_sector_share(spark, folder), CONSUMPTION, star.MEMBERS)


def product_mix(spark, folder):
    return rounded(
        shares.product_mix(
            _annual_production(spark, folder),
            PRODUCTION,
            labels(spark, star.TYPE_LABELS),
            star.PRODUCT_TYPES,
        )
    )


def _per_capita(spark, folder):
    return per_capita.per_capita_vs_average(
        _annual_consumption(spark, folder),
        _population(spark, folder),
        CONSUMPTION,
        labels(spark, star.SEGMENT_LABELS),
    )


def per_capita_vs_average(spark, folder):
    return rounded(_per_capita(spark, folder))


def above_average(spark, folder):
    return rounded(per_capita.above_average(_per_capita(spark, folder), CONSUMPTION))


def _as_text(column: str | None):
    return F.col(column).cast("string") if column else F.lit(None).cast("string")


def sections(report: dict[str, DataFrame], layout: dict[str, tuple]) -> DataFrame:
    """The sections of a report under one another: what, where, which, when, two values."""

    def number(column):
        return F.round((F.col(column) if column else F.lit(None)).cast("double"), 3)

    parts = []
    for name, (state, item, date, value, *second) in layout.items():
        parts.append(
            report[name].select(
                F.lit(name).alias("section"),
                _as_text(state).alias("state"),
                _as_text(item).alias("item"),
                _as_text(date).alias("date"),
                number(value).alias("value"),
                number(second[0] if second else None).alias("second"),
            )
        )
    return _stack(parts)


def _stack(parts):
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


BALANCE_LAYOUT = {
    "years": (None, None, None, "year"),
    "has_forecast": (None, None, None, "has_forecast"),
    "map": ("state", "id", None, "deficit"),
    "map_domain": (None, None, None, "high", "low"),
    "lines": ("state", "def_id", "date", "deficit", "predicted"),
    "last_points": ("state", "def_id", "date", "deficit", "predicted"),
    "forecast_span": (None, "end", "start", None),
    "ranking": ("state", "deficit_status", None, "deficit"),
    "top": ("state", None, "date", "rank", "deficit"),
}
PRODUCTION_LAYOUT = {
    "years": (None, None, None, "year"),
    "has_forecast": (None, None, None, "has_forecast"),
    "map": ("state", "id", None, "energy_prod"),
    "map_domain": (None, None, None, "high", "low"),
    "lines": ("state", "siec", "date", "energy_prod", "predicted"),
    "last_points": ("state", "siec", "date", "energy_prod", "predicted"),
    "average": ("state", "siec", "date", "y2", "energy_prod"),
    "average_domain": (None, None, None, "high", "low"),
    "stacked": ("state", "siec", "date", "stacked_to", "energy_prod"),
    "mix": ("state", "label", "date", "percentage", "energy_prod"),
    "missing": ("state", None, "date", "missing_percentage", "total"),
    "missing_all_years": ("state", None, None, "missing_percentage", "total"),
}
CONSUMPTION_LAYOUT = {
    "sectors": (None, "label", None, "has_rows"),
    "years": (None, None, None, "year"),
    "has_forecast": (None, None, None, "has_forecast"),
    "map": ("state", "id", None, "energy_cons"),
    "map_domain": (None, None, None, "high", "low"),
    "per_capita": ("state", "label", "date", "energy_cons_per_capita", "average"),
    "above_average": ("state", "label", "date", "average", "energy_cons_per_capita"),
    "lines": ("state", "nrg_bal", "date", "energy_cons", "predicted"),
    "last_points": ("state", "nrg_bal", "date", "energy_cons", "predicted"),
    "band": (None, "nrg_bal", "date", "high", "low"),
    "shares": ("state", "label", "date", "percentage", "energy_cons"),
}


def _balance_page(spark, folder, produced, consumed, date, **options):
    report = balance_report(produced, consumed, star.nations(spark, folder), date, **options)
    return sections(report, BALANCE_LAYOUT)


def _production_page(spark, folder, produced, date, **options):
    report = production_report(
        produced,
        star.nations(spark, folder),
        labels(spark, star.TYPE_LABELS),
        category=PRODUCTION.total,
        state=AGGREGATE,
        date=date,
        macro_parts=star.PRODUCT_TYPES,
        parts=star.PRODUCT_TYPES,
        since=SINCE,
        **options,
    )
    return sections(report, PRODUCTION_LAYOUT)


def _consumption_page(spark, folder, consumed, date, **options):
    sector_names = labels(spark, star.SEGMENT_LABELS)
    report = consumption_report(
        consumed,
        _population(spark, folder),
        star.nations(spark, folder),
        sector_names,
        sector_names,
        category=CONSUMPTION.total,
        state=AGGREGATE,
        date=date,
        **options,
    )
    report["sectors"] = report["sectors"].withColumn("has_rows", F.lit(1))
    return sections(report, CONSUMPTION_LAYOUT)


def report_balance(spark, folder):
    produced, consumed = star.flagged_production(spark, folder), star.flagged_consumption(spark, folder)
    return _balance_page(spark, folder, produced, consumed, YEAR)


def report_production(spark, folder):
    return _production_page(spark, folder, star.flagged_production(spark, folder), YEAR)


def report_consumption(spark, folder):
    return _consumption_page(spark, folder, star.flagged_consumption(spark, folder), YEAR)


def _continued_production(spark, folder):
    plan = replace(PRODUCTION_FORECAST, method="seasonal")
    return written(with_forecast(star.production(spark, folder), PRODUCTION, plan), "production")


def _continued_consumption(spark, folder):
    plan = replace(CONSUMPTION_FORECAST, method="seasonal")
    return written(with_forecast(star.consumption(spark, folder), CONSUMPTION, plan), "consumption")


def report_balance_forecast(spark, folder):
    """The page of a year that only the forecast reaches; so are the next two."""
    produced, consumed = _continued_production(spark, folder), _continued_consumption(spark, folder)
    return _balance_page(spark, folder, produced, consumed, FORECAST_YEAR, keep=written)


def report_production_forecast(spark, folder):
    produced = _continued_production(spark, folder)
    return _production_page(spark, folder, produced, FORECAST_YEAR, keep=written)


def report_consumption_forecast(spark, folder):
    consumed = _continued_consumption(spark, folder)
    return _consumption_page(spark, folder, consumed, FORECAST_YEAR, keep=written)


QUERIES = {
    "tidy_population": tidy_population,
    "tidy_projection": tidy_projection,
    "tidy_production": tidy_production,
    "tidy_consumption": tidy_consumption,
    "cell_quality": cell_quality,
    "balance": balance,
    "member_filter": members_only,
    "annual_sum": annual_sum,
    "annual_sum_collapsed": annual_sum_collapsed,
    "annual_mean": annual_mean,
    "annual_mean_mixed": annual_mean_mixed,
    "cast_measure": cast_whole,
    "state_catalog": state_catalog,
    "state_catalog_members": state_catalog_members,
    "category_catalog": category_catalog,
    "sector_labels": sector_labels,
    "year_domain": year_domain,
    "has_forecast": has_forecast,
    "top_states": top_states,
    "forecast_auto": forecast_auto_all,
    "forecast_seasonal": forecast_seasonal_all,
    "forecast_smoothed": forecast_smoothed_all,
    "forecast_upsampled_smoothed": forecast_upsampled_smoothed,
    "forecast_category": forecast_one_category,
    "forecast_category_seasonal": forecast_category_seasonal,
    "forecast_state": forecast_one_state,
    "forecast_state_seasonal": forecast_state_seasonal,
    "date_grid": date_grid,
    "interpolate": interpolate,
    "forward_fill": forward_fill,
    "upsample_interpolate": upsample_interpolate,
    "forecast_upsampled": forecast_upsampled,
    "forecast_upsampled_seasonal": forecast_upsampled_seasonal,
    "forecast_consumption": forecast_consumption,
    "forecast_consumption_next_year": forecast_consumption_next_year,
    "clip_nonnegative": clipped,
    "population": population_mean,
    "forecast_span": forecast_span,
    "forecast_span_from": forecast_span_from,
    "state_code": state_code,
    "default_states": default_states,
    "tidy_text": tidy_text,
    "revised_table": revised_table,
    "date_grid_monthly": date_grid_monthly,
    "upsample_monthly": upsample_monthly,
    "lines_map": lines_map,
    "sector_share_map": sector_share_map,
    "upsample_daily": upsample_daily,
    "map_table": map_table,
    "map_domain": map_domain,
    "lines_production": lines_production,
    "lines_pivot": lines_pivot,
    "lines_pivot_sectors": lines_pivot_sectors,
    "last_point": last_point,
    "member_average": member_average,
    "padded_domain": padded_domain,
    "interval_band": interval_band,
    "lines_balance": lines_balance,
    "stacked_area": stacked_area,
    "stacked_area_inclusive": stacked_area_inclusive,
    "completeness_year": completeness_year,
    "completeness_all": completeness_all,
    "distinct_total": distinct_total,
    "single_total": single_total,
    "top5_rank_by_year": top5_rank_by_year,
    "balance_ranking": balance_ranking,
    "sector_share": sector_share,
    "sector_share_wide": sector_share_wide,
    "product_mix": product_mix,
    "per_capita_vs_average": per_capita_vs_average,
    "above_average": above_average,
    "report_balance": report_balance,
    "report_production": report_production,
    "report_consumption": report_consumption,
    "report_balance_forecast": report_balance_forecast,
    "report_production_forecast": report_production_forecast,
    "report_consumption_forecast": report_consumption_forecast,
}
