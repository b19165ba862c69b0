"""The three reports: which tables are combined, and in what order.

Each takes tables that already hold actual and forecast rows (``with_forecast``) and
returns named DataFrames; nothing runs until the caller asks for one.  Several sections share
the forecast and the yearly tables.  A caller that shows them all writes the forecast first and
gives ``keep``, which is put around every yearly table: with ``sources.tables.written`` each is
computed once, and the sections read it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balance_spark.functions.numbers import whole
from balance_spark.operators.annual import annual, cast_measure
from balance_spark.operators.balance import balance
from balance_spark.operators.catalogs import category_labels, has_forecast, year_domain
from balance_spark.operators.lines import (
    forecast_span,
    interval_band,
    last_point,
    lines,
    member_average,
    padded_domain,
    sector_lines,
    stacked_area,
)
from balance_spark.operators.maps import map_domain, map_values
from balance_spark.operators.members import member_count
from balance_spark.operators.per_capita import above_average, per_capita_vs_average
from balance_spark.operators.ranking import balance_ranking, top_rank_by_year, top_states
from balance_spark.operators.shares import completeness, product_mix, sector_share
from balance_spark.specs import BALANCE, CONSUMPTION, PRODUCTION, Measure


def yearly_balance(
    produced: DataFrame,
    consumed: DataFrame,
    production: Measure = PRODUCTION,
    consumption: Measure = CONSUMPTION,
) -> DataFrame:
    """Yearly balance of the totals from monthly production and yearly consumption."""
    supply = produced.filter(F.col(production.category) == production.total)
    demand = consumed.filter(F.col(consumption.category) == consumption.total)
    return balance(
        annual(supply, production, collapse=True),
        annual(demand, consumption, collapse=True),
        production,
        consumption,
    )


def _as_it_is(table: DataFrame) -> DataFrame:
    return table


def balance_report(
    produced: DataFrame, consumed: DataFrame, countries: DataFrame, date, keep=_as_it_is
) -> dict[str, DataFrame]:
    yearly = keep(cast_measure(yearly_balance(produced, consumed), BALANCE))
    chosen = top_states(yearly, BALANCE, BALANCE.total)
    shown = lines(yearly, BALANCE, chosen)
    on_map = map_values(yearly, BALANCE, date, BALANCE.total, countries)
    return {
        "years": year_domain(yearly),
        "has_forecast": has_forecast(yearly, date),
        "map": on_map,
        "map_domain": map_domain(on_map, BALANCE),
        "lines": shown,
        "last_points": last_point(shown, "state"),
        "forecast_span": forecast_span(shown),
        "ranking": balance_ranking(yearly, date, member_count(countries)),
        "top": top_rank_by_year(yearly),
    }


def production_report(
    produced: DataFrame,
    countries: DataFrame,
    labels: DataFrame,
    category: str,
    state: str,
    date,
    macro_parts: Sequence[str],
    parts: Sequence[str],
    since,
    measure: Measure = PRODUCTION,
    keep=_as_it_is,
) -> dict[str, DataFrame]:
    recent = produced.filter(F.col("date") >= F.lit(since).cast("date"))
    of_category = recent.filter(F.col(measure.category) == category)
    yearly_category = keep(annual(of_category, measure, collapse=True))
    on_map = map_values(yearly_category, measure, date, category, countries)
    chosen = top_states(yearly_category, measure, category)
    shown = lines(of_category, measure, chosen, category)
    average = member_average(of_category, measure, category, member_count(countries))
    of_state = recent.filter(F.col("state") == state)
    # Parts are shown, and added up to years, as whole numbers; the total is cut once.
    value, is_total = F.col(measure.value), F.col(measure.category) == measure.total
    shown_parts = of_state.withColumn(
        measure.value, F.when(is_total, value).otherwise(whole(value))
    )
    yearly_state = keep(cast_measure(annual(shown_parts, measure, collapse=True), measure))
    this_year = yearly_state.filter(F.col("date") == F.lit(date).cast("date"))
    return {
        "years": year_domain(yearly_category),
        "has_forecast": has_forecast(yearly_category, date),
        "map": on_map,
        "map_domain": map_domain(on_map, measure),
        "lines": shown,
        "last_points": last_point(shown, "state"),
        "average": average,
        "average_domain": padded_domain(average, "y2"),
        "stacked": stacked_area(of_state, measure, macro_parts, after=since),
        "mix": product_mix(this_year, measure, labels, parts),
        "missing": completeness(this_year, measure, parts),
        "missing_all_years": completeness(yearly_state, measure, macro_parts, by=("state",)),
    }


def consumption_report(
    consumed: DataFrame,
    people: DataFrame,
    countries: DataFrame,
    labels: DataFrame,
    titles: DataFrame,
    category: str,
    state: str,
    date,
    states=None,
    measure: Measure = CONSUMPTION,
    keep=_as_it_is,
) -> dict[str, DataFrame]:
    yearly = keep(annual(consumed, measure, collapse=True))
    of_category = yearly.filter(F.col(measure.category) == category)
    on_map = map_values(of_category, measure, date, category, countries)
    compared = per_capita_vs_average(yearly, people, measure, labels, states=states, date=date)
    this_state = yearly.filter(
        (F.col("state") == state) & (F.col("date") == F.lit(date).cast("date"))
    )
    shown = sector_lines(consumed, measure, state)
    return {
        "sectors": category_labels(consumed, measure, titles),
        "years": year_domain(of_category),
        "has_forecast": has_forecast(of_category, date),
        "map": on_map,
        "map_domain": map_domain(on_map, measure),
        "per_capita": compared,
        "above_average": above_average(compared, measure),
        "lines": shown,
        "last_points": last_point(shown, measure.category),
        "band": interval_band(consumed, measure, state),
        "shares": sector_share(cast_measure(this_state, measure), measure, labels),
    }
