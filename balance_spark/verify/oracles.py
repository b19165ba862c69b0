"""The same questions as ``queries.py`` in ANSI SQL, for a second engine to answer.

Written straight from the definitions, with joins and windows of its own, so that it
shares no shortcut with the Spark side.
"""

from __future__ import annotations

import re

from balance_spark.operators.smoothing import LEVEL_RATES, SEASON_RATES, TREND_RATES
from balance_spark.sources.star import (
    MEMBERS,
    PREDICTED_FROM_MONTH,
    PREDICTED_YEAR,
    PRODUCT_TYPES,
    SEGMENT_LABELS,
    SEGMENTS,
    TYPE_LABELS,
)
from balance_spark.verify.queries import (
    DEFAULT_STATES,
    FORECAST_MONTH,
    FORECAST_YEAR,
    REVISIONS,
    SINCE,
    SOME_PARTS,
    YEAR,
)

AGG = "EU27_2020"
WIDTH = 1.959964  # half width of a 95% interval in standard errors


def _in(codes) -> str:
    return "(" + ", ".join(f"'{code}'" for code in codes) + ")"


def _label_rows(mapping) -> str:
    return ", ".join(f"('{code}', '{label}')" for code, label in mapping.items())


CTES = {
    "country": """
        SELECT n_name AS state, replace(n_name, '_', ' ') AS name, n_nationkey AS iso_numeric,
               r_name = 'EUROPE' AS member
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "supply": """
        SELECT n_name AS state, p_type AS siec,
               CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
               SUM(l_quantity) AS energy_prod
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
             JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
        GROUP BY 1, 2, 3""",
    "supply_all": f"""
        SELECT state, siec, date, energy_prod FROM supply
        UNION ALL
        SELECT '{AGG}', siec, date, energy_prod
        FROM supply JOIN country USING (state) WHERE member""",
    "production": """
        SELECT siec, state, date, SUM(energy_prod) AS energy_prod,
               state || ';' || siec AS unique_id
        FROM (SELECT * FROM supply_all
              UNION ALL SELECT state, 'TOTAL', date, energy_prod FROM supply_all) AS t
        GROUP BY siec, state, date""",
    "demand": """
        SELECT n_name AS state, c_mktsegment AS nrg_bal,
               CAST(date_trunc('year', o_orderdate) AS DATE) AS date,
               SUM(l_quantity) AS energy_cons
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey
             JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY 1, 2, 3""",
    "demand_all": f"""
        SELECT state, nrg_bal, date, energy_cons FROM demand
        UNION ALL
        SELECT '{AGG}', nrg_bal, date, energy_cons
        FROM demand JOIN country USING (state) WHERE member""",
    "consumption": """
        SELECT nrg_bal, state, date, SUM(energy_cons) AS energy_cons,
               state || ';' || nrg_bal AS unique_id
        FROM (SELECT * FROM demand_all
              UNION ALL SELECT state, 'FC', date, energy_cons FROM demand_all) AS t
        GROUP BY nrg_bal, state, date""",
    "observed": f"""
        SELECT state, date, SUM(people) AS population FROM (
          SELECT n_name AS state, CAST(date_trunc('year', o_orderdate) AS DATE) AS date,
                 CAST(COUNT(DISTINCT o_custkey) AS DOUBLE) AS people
          FROM orders JOIN customer ON o_custkey = c_custkey
               JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
          UNION ALL
          SELECT '{AGG}', CAST(date_trunc('year', o_orderdate) AS DATE),
                 CAST(COUNT(DISTINCT o_custkey) AS DOUBLE)
          FROM orders JOIN customer ON o_custkey = c_custkey
               JOIN nation ON c_nationkey = n_nationkey
               JOIN region ON n_regionkey = r_regionkey
          WHERE r_name = 'EUROPE' GROUP BY 1, 2) AS t
        GROUP BY state, date""",
    "projected": f"""
        SELECT state, make_date(CAST(y AS INTEGER), 1, 1) AS date, population
        FROM (SELECT n_name AS state, CAST(COUNT(*) AS DOUBLE) AS population
              FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
              UNION ALL
              SELECT '{AGG}', CAST(COUNT(*) AS DOUBLE)
              FROM customer JOIN nation ON c_nationkey = n_nationkey
                   JOIN region ON n_regionkey = r_regionkey
              WHERE r_name = 'EUROPE') AS t, range(2000, 2004) AS years(y)""",
    "people": """
        SELECT state, date, AVG(population) AS population
        FROM (SELECT state, date, population FROM observed
              UNION ALL SELECT state, date, population FROM projected) AS t
        GROUP BY state, date""",
    "flagged_production": f"""
        SELECT *, date >= DATE '{PREDICTED_FROM_MONTH}' AS predicted FROM production""",
    "flagged_consumption": f"""
        SELECT *, date = DATE '{PREDICTED_YEAR}' AS predicted,
               CASE WHEN date = DATE '{PREDICTED_YEAR}' THEN energy_cons * 0.9 END AS low,
               CASE WHEN date = DATE '{PREDICTED_YEAR}' THEN energy_cons * 1.1 END AS high
        FROM consumption""",
    "annual_production": """
        SELECT state, unique_id, siec, CAST(date_trunc('year', date) AS DATE) AS date,
               SUM(energy_prod) AS energy_prod, BOOL_OR(predicted) AS predicted
        FROM flagged_production GROUP BY 1, 2, 3, 4""",
    "annual_consumption": """
        SELECT state, unique_id, nrg_bal, date, energy_cons, predicted
        FROM flagged_consumption""",
    "yearly_balance": """
        SELECT p.state, p.date, p.unique_id, p.siec, p.energy_prod,
               p.predicted OR c.predicted AS predicted, c.nrg_bal, c.energy_cons,
               c.unique_id AS unique_id_right, p.energy_prod - c.energy_cons AS deficit,
               p.siec || ';' || c.nrg_bal AS def_id
        FROM annual_production p JOIN annual_consumption c
             ON p.state = c.state AND p.date = c.date
        WHERE p.siec = 'TOTAL' AND c.nrg_bal = 'FC'""",
    "whole_balance": """
        SELECT * REPLACE (CAST(trunc(deficit) AS BIGINT) AS deficit) FROM yearly_balance""",
    "production_points": """
        SELECT unique_id, date AS ds, energy_prod AS y FROM production""",
    "consumption_points": """
        SELECT unique_id, date AS ds, energy_cons AS y FROM consumption""",
    "holed": """
        SELECT unique_id, date AS ds,
               CASE WHEN month(date) % 3 <> 0 THEN energy_prod END AS y
        FROM production WHERE siec = 'TOTAL'""",
    "segment_label": f"""
        SELECT * FROM (VALUES {_label_rows(SEGMENT_LABELS)}) AS t(code, label)""",
    "type_label": f"""
        SELECT * FROM (VALUES {_label_rows(TYPE_LABELS)}) AS t(code, label)""",
}


def sql(body: str, **extra: str) -> str:
    """The query with the common tables it needs; unused ones cost nothing."""
    tables = CTES | extra
    return (
        "WITH RECURSIVE "
        + ",\n".join(f"{name} AS ({text})" for name, text in tables.items())
        + "\n"
        + body
    )


def grid(points: str, step: int) -> dict[str, str]:
    """Tables that put points on a regular grid, interpolated."""
    return {
        "seg": f"""
            SELECT unique_id, ds, y,
                   LEAD(y) OVER (PARTITION BY unique_id ORDER BY ds) AS ny,
                   date_diff('month', ds, LEAD(ds) OVER (PARTITION BY unique_id ORDER BY ds))
                     // {step} AS steps
            FROM {points}""",
        "unrolled": f"""
            SELECT unique_id, ds AS start, y, ny, steps,
                   UNNEST(range(COALESCE(steps, 1))) AS k FROM seg""",
        "grid": f"""
            SELECT unique_id, CAST(start + to_months(CAST(k * {step} AS INTEGER)) AS DATE) AS ds,
                   CASE WHEN k = 0 THEN y ELSE y + (ny - y) * k / steps END AS y,
                   CASE WHEN k = 0 THEN y END AS known
            FROM unrolled""",
    }


def on_grid(points: str, step: int) -> dict[str, str]:
    """Points moved to the last grid date before them and averaged."""
    return {
        "moved": f"""
            SELECT unique_id, y, first, date_diff('month', first, ds) // {step} * {step} AS off
            FROM (SELECT *, MIN(ds) OVER (PARTITION BY unique_id) AS first FROM {points}) AS t""",
        "aligned": """
            SELECT unique_id, CAST(first + to_months(CAST(off AS INTEGER)) AS DATE) AS ds, AVG(y) AS y
            FROM moved GROUP BY ALL""",
    }


def fitted(prefix: str, season: int, horizon: int, step: int) -> dict[str, str]:
    """Tables of a line fitted to ``grid``, with a level per position of the season."""
    p = prefix
    return {
        f"{p}phased": f"""
            SELECT *, CASE WHEN n >= {2 * season} THEN t % {season} ELSE 0 END AS phase
            FROM placed""",
        f"{p}level": f"""
            SELECT unique_id, phase, AVG(y) AS my, AVG(t) AS mt, COUNT(*) AS np
            FROM {p}phased GROUP BY 1, 2""",
        f"{p}trend": f"""
            SELECT unique_id, MAX(ds) AS last, MAX(t) AS last_t, MAX(n) AS n,
                   SUM((t - mt) * (t - mt)) AS tt, AVG(y * y) AS power,
                   COUNT(DISTINCT phase) AS phases,
                   CASE WHEN SUM((t - mt) * (t - mt)) > 0
                        THEN SUM((t - mt) * (y - my)) / SUM((t - mt) * (t - mt)) ELSE 0 END AS b
            FROM {p}phased JOIN {p}level USING (unique_id, phase) GROUP BY unique_id""",
        f"{p}spread": f"""
            SELECT unique_id, SUM((y - my - b * (t - mt)) * (y - my - b * (t - mt))) AS squares
            FROM {p}phased JOIN {p}level USING (unique_id, phase) JOIN {p}trend USING (unique_id)
            GROUP BY 1""",
        f"{p}ahead": f"""
            SELECT unique_id, last, k, my + b * (last_t + k - mt) AS value,
                   CASE WHEN n - phases - 1 > 0 THEN {WIDTH} * sqrt(squares / (n - phases - 1) *
                     (1 + 1.0::DOUBLE / np + CASE WHEN tt > 0
                      THEN (last_t + k - mt) * (last_t + k - mt) / tt ELSE 0 END)) ELSE 0 END AS half
            FROM {p}trend JOIN {p}spread USING (unique_id), range(1, {horizon + 1}) AS h(k), {p}level
            WHERE {p}level.unique_id = {p}trend.unique_id
              AND {p}level.phase = CASE WHEN n >= {2 * season} THEN (last_t + k) % {season}
                                   ELSE 0 END""",
        f"{p}score": f"""
            SELECT unique_id, phases, {_aicc('n', 'phases + 2', 'squares / n', 'power')} AS score
            FROM {p}trend JOIN {p}spread USING (unique_id)""",
    }


def _aicc(n: str, p: str, error: str, power: str) -> str:
    return f"""CASE WHEN {n} > {p} + 1 THEN
        {n} * ln(greatest({error}, 1e-9::DOUBLE * {power} + 1e-12::DOUBLE)) + 2 * ({p})
        + 2 * ({p}) * ({p} + 1) / ({n} - ({p}) - 1)::DOUBLE END"""


def _placed(points: str, step: int) -> dict[str, str]:
    return grid(points, step) | {
        "placed": """
            SELECT *, ROW_NUMBER() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS t,
                   COUNT(*) OVER (PARTITION BY unique_id) AS n
            FROM grid"""
    }


def _forecast(ahead: str, step: int, method: str) -> str:
    return f"""
        SELECT unique_id, last, CAST(last + to_months(CAST(k * {step} AS INTEGER)) AS DATE) AS date,
               value, value - half AS low, value + half AS high, {method} AS method FROM {ahead}"""


def seasonal(points: str, step: int, season: int, horizon: int) -> dict[str, str]:
    """Tables that continue a grid by trend and seasonal means."""
    return (
        _placed(points, step)
        | fitted("", season, horizon, step)
        | {"forecast": _forecast("ahead", step, "'seasonal'")}
    )


def smoothing(season: int, horizon: int) -> dict[str, str]:
    """Tables that run level, trend and seasons over ``grid``, one value after the other."""
    rates = ", ".join(
        f"({a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE)"
        for a in LEVEL_RATES for b in TREND_RATES for g in SEASON_RATES
    )
    return {
        "listed": f"""
            SELECT *, CASE WHEN n >= {2 * season} THEN {season} ELSE 1 END AS m FROM (
              SELECT unique_id, MAX(ds) AS last, list(y ORDER BY ds) AS y, COUNT(*) AS n,
                     AVG(y * y) AS power FROM grid GROUP BY 1) AS t""",
        "begun": f"""
            SELECT *, list_sum(y[1:{season}]) / {season} AS one,
                   list_sum(y[{season + 1}:{2 * season}]) / {season} AS two FROM listed""",
        "rate": f"SELECT * FROM (VALUES {rates}) AS r(a, b, g)",
        "run": f"""
            SELECT unique_id, a, b, g, m AS t, 0.0::DOUBLE AS squares,
                   CASE WHEN m > 1 THEN one ELSE y[1] END AS level,
                   CASE WHEN m > 1 THEN (two - one) / {season} WHEN n > 2 THEN y[2] - y[1]
                        ELSE 0 END AS trend,
                   CASE WHEN m > 1 THEN list_transform(y[1:{season}], lambda v: v - one)
                        ELSE [0.0::DOUBLE] END AS seasons
            FROM begun, rate
            UNION ALL
            SELECT unique_id, a, b, g, t + 1, squares + e * e, level + trend + a * e,
                   trend + a * b * e, list_append(seasons[2:], seasons[1] + g * (1 - a) * e)
            FROM (SELECT r.*, y[t + 1] - (level + trend + seasons[1]) AS e
                  FROM run r JOIN listed USING (unique_id) WHERE t < n) AS s""",
        "best": """
            SELECT * FROM (
              SELECT r.*, l.last, l.n, l.m, l.power, ROW_NUMBER() OVER (
                       PARTITION BY unique_id ORDER BY squares, a, b, g) AS place
              FROM run r JOIN listed l USING (unique_id) WHERE t = n) AS s WHERE place = 1""",
        "weighed": f"""
            SELECT *, (k - 1)::DOUBLE AS j, ((k - 1) // m)::DOUBLE AS q,
                   CASE WHEN m > 1 THEN g * (1 - a) ELSE 0 END AS gg,
                   CASE WHEN n > m THEN squares / (n - m) ELSE 0 END AS error
            FROM best, range(1, {horizon + 1}) AS h(k)""",
        "smooth_ahead": f"""
            SELECT unique_id, last, k, level + k * trend + seasons[1 + (k - 1) % m] AS value,
                   {WIDTH} * sqrt(error * (1 + a * a * (j + b * j * (j + 1)
                       + b * b * j * (j + 1) * (2 * j + 1) / 6)
                     + 2 * gg * (a * q + a * b * m * q * (q + 1) / 2) + gg * gg * q)) AS half
            FROM weighed""",
        "smooth_score": f"""
            SELECT unique_id, {_aicc('n', f'(CASE WHEN m > 1 THEN {season + 6} ELSE 5 END)',
                                     '(CASE WHEN n > m THEN squares / (n - m) ELSE 0 END)', 'power')}
                   AS score FROM best""",
    }


def smooth(points: str, step: int, season: int, horizon: int) -> dict[str, str]:
    return (
        _placed(points, step)
        | smoothing(season, horizon)
        | {"forecast": _forecast("smooth_ahead", step, "'smoothed'")}
    )


def chosen_method(points: str, step: int, season: int, horizon: int) -> dict[str, str]:
    """Tables that continue every series by the method with the smallest AICc."""
    return (
        _placed(points, step)
        | fitted("line_", 1, horizon, step)
        | fitted("", season, horizon, step)
        | smoothing(season, horizon)
        | {
            "scores": """
                SELECT unique_id, 'trend' AS method, 0 AS rank,
                       COALESCE(score, 'inf'::DOUBLE) AS score FROM line_score
                UNION ALL SELECT unique_id, 'seasonal', 1, score FROM score WHERE phases > 1
                UNION ALL SELECT unique_id, 'smoothed', 2, score FROM smooth_score""",
            "chosen_method": """
                SELECT unique_id, method FROM (
                  SELECT *, ROW_NUMBER() OVER (PARTITION BY unique_id ORDER BY score, rank) AS place
                  FROM scores WHERE score IS NOT NULL) AS s WHERE place = 1""",
            "all_ahead": """
                SELECT *, 'trend' AS method FROM line_ahead
                UNION ALL SELECT *, 'seasonal' FROM ahead
                UNION ALL SELECT *, 'smoothed' FROM smooth_ahead""",
            "chosen_ahead": "SELECT * FROM all_ahead JOIN chosen_method USING (unique_id, method)",
            "forecast": _forecast("chosen_ahead", step, "method"),
        }
    )


ROUNDED_FORECAST = """
    SELECT unique_id, last, date, round(value, 3) AS value, round(low, 3) AS low,
           round(high, 3) AS high, method FROM forecast"""


def _clip(column: str) -> str:
    return f"round(CASE WHEN {column} < 0 THEN 0 ELSE {column} END, 3)"


def continued(
    where: str, tidy: str, value: str, category: str, extra: dict[str, str], next_year: bool = False
) -> str:
    """Actual rows and clipped forecast rows."""
    return sql(
        f"""
        SELECT {category}, state, date, round({value}, 3) AS {value}, unique_id,
               FALSE AS predicted, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high
        FROM chosen
        UNION ALL
        SELECT split_part(unique_id, ';', 2), split_part(unique_id, ';', 1), date,
               {_clip('value')}, unique_id, TRUE, {_clip('low')}, {_clip('high')}
        FROM forecast{' WHERE year(date) > year(last)' if next_year else ''}""",
        chosen=f"SELECT * FROM {tidy} WHERE {where}",
        chosen_points=f"SELECT unique_id, date AS ds, {value} AS y FROM chosen",
        **extra,
    )


TOP_STATES = """
    SELECT state, SUM({value}) AS total_energy FROM {table}
    WHERE {category} = '{total}' AND state <> 'EU27_2020'
    GROUP BY state ORDER BY total_energy DESC, state LIMIT 4"""


def top_states(table, value, category, total):
    return TOP_STATES.format(table=table, value=value, category=category, total=total)


def map_values(table: str, value: str, where: str) -> str:
    return f"""
        SELECT lpad(CAST(iso_numeric AS VARCHAR), 3, '0') AS id, t.state, t.{value}
        FROM {table} t JOIN country c ON t.state = c.state
        WHERE t.date = DATE '{YEAR}' AND t.state <> '{AGG}' AND {where}"""


MEMBER_BALANCE = map_values("yearly_balance", "deficit", "c.member")

LINES_PRODUCTION = f"""
    SELECT * FROM flagged_production WHERE siec = 'TOTAL' AND state IN (
      SELECT state FROM ({top_states('flagged_production', 'energy_prod', 'siec', 'TOTAL')}))"""
LINES_BALANCE = f"""
    SELECT * FROM whole_balance WHERE state IN (
      SELECT state FROM ({top_states('whole_balance', 'deficit', 'def_id', 'TOTAL;FC')}))"""


def last_points(table: str, key: str) -> str:
    return f"""
        SELECT t.* FROM {table} t
        JOIN (SELECT {key}, MAX(date) AS date FROM {table} WHERE predicted GROUP BY 1) m
             USING ({key}, date)
        WHERE t.predicted"""


MEMBER_AVERAGE = f"""
    SELECT *, energy_prod / (SELECT COUNT(*) FROM country WHERE member) AS y2
    FROM flagged_production WHERE state = '{AGG}' AND siec = 'TOTAL'"""


def stacked(where: str) -> str:
    return f"""
        SELECT siec, state, date, CAST(trunc(energy_prod) AS BIGINT) AS energy_prod, unique_id,
               predicted,
               CAST(SUM(trunc(energy_prod)) OVER (PARTITION BY state, date ORDER BY siec)
                    AS BIGINT) AS stacked_to
        FROM flagged_production WHERE siec IN {_in(PRODUCT_TYPES)} AND {where}"""


def completeness(keys: str, where: str, parts=SOME_PARTS) -> str:
    return f"""
        SELECT {keys}, total, parts, (total - parts) / total * 100 AS missing_percentage
        FROM (SELECT {keys}, SUM(CASE WHEN siec = 'TOTAL' THEN energy_prod END) AS total,
                     SUM(CASE WHEN siec IN {_in(parts)} THEN energy_prod ELSE 0 END) AS parts
              FROM annual_production WHERE {where} GROUP BY {keys}) AS t
        WHERE parts < total * 0.95"""


TOP_RANK = f"""
    SELECT state, date, deficit, rank FROM (
      SELECT state, date, CAST(deficit AS DOUBLE) AS deficit,
             ROW_NUMBER() OVER (PARTITION BY date ORDER BY deficit DESC, state) AS place,
             RANK() OVER (PARTITION BY date ORDER BY deficit DESC) AS rank
      FROM whole_balance WHERE state <> '{AGG}') AS t WHERE place <= 5"""


RANKING = f"""
    SELECT CASE WHEN state = '{AGG}' THEN 'EU' ELSE state END AS state,
           CASE WHEN state = '{AGG}'
                THEN floor(deficit / (SELECT COUNT(*) FROM country WHERE member))
                ELSE deficit END AS deficit,
           CASE WHEN state = '{AGG}' THEN 'EU' WHEN deficit > 0 THEN 'Maggiore'
                ELSE 'Minore' END AS deficit_status
    FROM yearly_balance WHERE date = DATE '{YEAR}'"""


def share(table: str, value: str, category: str, label: str, where: str, digits: int) -> str:
    return f"""
        SELECT t.state, t.date, t.{category}, t.{value},
               round(t.{value} / SUM(t.{value}) OVER (PARTITION BY t.state, t.date) * 100, {digits})
                 AS percentage,
               COALESCE(l.label, t.{category}) AS label
        FROM {table} t LEFT JOIN {label} l ON t.{category} = l.code
        WHERE {where}"""


SECTOR_SHARE = share(
    "annual_consumption", "energy_cons", "nrg_bal", "segment_label", "t.nrg_bal <> 'FC'", 2
)
PRODUCT_MIX = share(
    "annual_production", "energy_prod", "siec", "type_label", f"t.siec IN {_in(PRODUCT_TYPES)}", 3
)

HEADS = """
    SELECT a.*, round(CAST(trunc(a.energy_cons) AS BIGINT) / population, 5)
                  AS energy_cons_per_capita
    FROM annual_consumption a JOIN people USING (state, date)"""
PER_CAPITA = f"""
    SELECT h.date, h.nrg_bal, h.unique_id, h.state, h.energy_cons_per_capita,
           e.energy_cons_per_capita AS average, COALESCE(l.label, h.nrg_bal) AS label
    FROM ({HEADS}) AS h
    JOIN ({HEADS}) AS e ON h.date = e.date AND h.nrg_bal = e.nrg_bal AND e.state = '{AGG}'
    LEFT JOIN segment_label l ON h.nrg_bal = l.code
    WHERE h.state <> '{AGG}' AND h.nrg_bal <> 'FC'"""
ABOVE = f"SELECT * FROM ({PER_CAPITA}) AS c WHERE energy_cons_per_capita > average"

SECTOR_LINES = f"""
    SELECT nrg_bal, state, date, CAST(trunc(energy_cons) AS BIGINT) AS energy_cons, unique_id,
           predicted, low, high
    FROM flagged_consumption WHERE state = '{AGG}' AND nrg_bal <> 'FC'"""

YEARS = """
    SELECT y AS year FROM (SELECT MIN(year(date)) AS a, MAX(year(date)) AS b FROM {}) AS t,
    LATERAL (SELECT UNNEST(range(a, b)) AS y) AS r"""


def section(
    name: str, body: str, state="NULL", item="NULL", date="NULL", value="NULL", second="NULL"
) -> str:
    return f"""
        SELECT '{name}' AS section, CAST({state} AS VARCHAR) AS state,
               CAST({item} AS VARCHAR) AS item, CAST({date} AS VARCHAR) AS date,
               round(CAST({value} AS DOUBLE), 3) AS value,
               round(CAST({second} AS DOUBLE), 3) AS second
        FROM ({body}) AS t"""


def domain(name: str, body: str, value: str) -> str:
    ends = f"SELECT MAX({value}) AS high, MIN({value}) AS low FROM ({body}) AS m"
    return section(name, ends, value="high", second="low")


def any_forecast(table: str) -> str:
    found = f"SELECT COUNT(*) > 0 AS found FROM {table} WHERE predicted AND date = DATE '{YEAR}'"
    return section("has_forecast", found, value="found")


ALL_MAP_BALANCE = map_values("whole_balance", "deficit", "TRUE")
#: The pages: their sections, and the tables that only they use.
BALANCE_PAGE = (
    [
        section("years", YEARS.format("yearly_balance"), value="year"),
        any_forecast("whole_balance"),
        section("map", ALL_MAP_BALANCE, "state", "id", value="deficit"),
        domain("map_domain", ALL_MAP_BALANCE, "deficit"),
        section("lines", "SELECT * FROM shown", "state", "def_id", "date", "deficit", "predicted"),
        section("last_points", last_points("shown", "state"),
                "state", "def_id", "date", "deficit", "predicted"),
        section("forecast_span", """SELECT MIN(date) AS a, MAX(date) AS b FROM shown
                                    WHERE predicted""", item="b", date="a"),
        section("ranking", RANKING.replace("yearly_balance", "whole_balance"),
                "state", "deficit_status", value="deficit"),
        section("top", TOP_RANK, "state", date="date", value="rank", second="deficit"),
    ],
    {"shown": LINES_BALANCE},
)

RECENT = f"date >= DATE '{SINCE}'"
RECENT_TOTALS = f"SELECT * FROM flagged_production WHERE siec = 'TOTAL' AND {RECENT}"
RECENT_MAP = map_values("recent_annual", "energy_prod", "t.siec = 'TOTAL'")
RECENT_AVERAGE = f"SELECT * FROM average WHERE {RECENT}"
PRODUCTION_PAGE = (
    [
        section("years", YEARS.format("recent_total"), value="year"),
        any_forecast("recent_annual"),
        section("map", RECENT_MAP, "state", "id", value="energy_prod"),
        domain("map_domain", RECENT_MAP, "energy_prod"),
        section("lines", "SELECT * FROM shown", "state", "siec", "date", "energy_prod", "predicted"),
        section("last_points", last_points("shown", "state"),
                "state", "siec", "date", "energy_prod", "predicted"),
        section("average", RECENT_AVERAGE, "state", "siec", "date", "y2", "energy_prod"),
        section("average_domain",
                f"""SELECT MAX(y2) + 0.3 * MAX(y2) AS high, MIN(y2) - 0.3 * MIN(y2) AS low
                    FROM ({RECENT_AVERAGE}) AS a""", value="high", second="low"),
        section("stacked", stacked(f"state = '{AGG}' AND date > DATE '{SINCE}'"),
                "state", "siec", "date", "stacked_to", "energy_prod"),
        section("mix", share("state_annual", "energy_prod", "siec", "type_label",
                             f"t.siec IN {_in(PRODUCT_TYPES)} AND t.date = DATE '{YEAR}'", 3),
                "state", "label", "date", "percentage", "energy_prod"),
        section("missing", completeness("state, date", f"date = DATE '{YEAR}'", PRODUCT_TYPES)
                .replace("annual_production", "state_annual"),
                "state", date="date", value="missing_percentage", second="total"),
        section("missing_all_years", completeness("state", "TRUE", PRODUCT_TYPES)
                .replace("annual_production", "state_annual"),
                "state", value="missing_percentage", second="total"),
    ],
    {
        "recent_total": RECENT_TOTALS,
        "recent_annual": f"""
            SELECT state, unique_id, siec, CAST(date_trunc('year', date) AS DATE) AS date,
                   SUM(energy_prod) AS energy_prod, BOOL_OR(predicted) AS predicted
            FROM flagged_production WHERE {RECENT} GROUP BY 1, 2, 3, 4""",
        "state_annual": f"""
            SELECT state, siec, CAST(date_trunc('year', date) AS DATE) AS date,
                   CAST(trunc(SUM(CASE WHEN siec = 'TOTAL' THEN energy_prod
                                  ELSE trunc(energy_prod) END)) AS BIGINT) AS energy_prod
            FROM flagged_production WHERE {RECENT} AND state = '{AGG}' GROUP BY 1, 2, 3""",
        "shown": f"""SELECT * FROM recent_total WHERE state IN (
            SELECT state FROM ({top_states('recent_annual', 'energy_prod', 'siec', 'TOTAL')}))""",
        "average": MEMBER_AVERAGE,
    },
)

CONSUMPTION_MAP = map_values("annual_consumption", "energy_cons", "t.nrg_bal = 'FC'")
CONSUMPTION_PAGE = (
    [
        section("sectors", """SELECT DISTINCT label FROM consumption
                              JOIN segment_label ON nrg_bal = code""",
                item="label", value="1"),
        section("years", YEARS.format("annual_consumption"), value="year"),
        any_forecast("(SELECT * FROM annual_consumption WHERE nrg_bal = 'FC')"),
        section("map", CONSUMPTION_MAP, "state", "id", value="energy_cons"),
        domain("map_domain", CONSUMPTION_MAP, "energy_cons"),
        section("per_capita", f"SELECT * FROM ({PER_CAPITA}) AS c WHERE date = DATE '{YEAR}'",
                "state", "label", "date", "energy_cons_per_capita", "average"),
        section("above_average", f"SELECT * FROM ({ABOVE}) AS c WHERE date = DATE '{YEAR}'",
                "state", "label", "date", "average", "energy_cons_per_capita"),
        section("lines", "SELECT * FROM shown", "state", "nrg_bal", "date", "energy_cons", "predicted"),
        section("last_points", last_points("shown", "nrg_bal"),
                "state", "nrg_bal", "date", "energy_cons", "predicted"),
        section("band", "SELECT * FROM shown WHERE predicted",
                "NULL", "nrg_bal", "date", "high", "low"),
        section("shares", share("whole_consumption", "energy_cons", "nrg_bal", "segment_label",
                                f"""t.nrg_bal <> 'FC' AND t.state = '{AGG}'
                                    AND t.date = DATE '{YEAR}'""", 2),
                "state", "label", "date", "percentage", "energy_cons"),
    ],
    {
        "shown": SECTOR_LINES,
        "whole_consumption": """
            SELECT * REPLACE (CAST(trunc(energy_cons) AS BIGINT) AS energy_cons)
            FROM annual_consumption""",
    },
)


def page(parts: tuple) -> str:
    body, tables = parts
    return sql(" UNION ALL ".join(body), **tables)


def prefixed(prefix: str, tables: dict[str, str]) -> dict[str, str]:
    """The tables under other names, wherever they are named."""
    names = re.compile(r"\b(" + "|".join(sorted(tables, key=len, reverse=True)) + r")\b")
    return {
        prefix + name: names.sub(lambda found: prefix + found[1], text)
        for name, text in tables.items()
    }


def with_ahead(tidy: str, value: str, category: str, forecast: str) -> str:
    """Actual and forecast rows, none of the latter below zero."""
    clipped = [f"CASE WHEN {c} < 0 THEN 0 ELSE {c} END" for c in ("value", "low", "high")]
    return f"""
        SELECT {category}, state, date, {value}, unique_id, FALSE AS predicted,
               CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM {tidy}
        UNION ALL
        SELECT split_part(unique_id, ';', 2), split_part(unique_id, ';', 1), date, {clipped[0]},
               unique_id, TRUE, {clipped[1]}, {clipped[2]} FROM {forecast}"""


def forecast_page(parts: tuple) -> str:
    """A page over tables with forecasts, of ``FORECAST_YEAR``."""
    body, own = parts
    tables = dict(CTES)
    later = {name: tables.pop(name) for name in list(tables)[list(tables).index("flagged_production"):]}
    points = {name: later.pop(name) for name in ("production_points", "consumption_points")}
    later["flagged_production"] = with_ahead("production", "energy_prod", "siec", "p_forecast")
    later["flagged_consumption"] = with_ahead("consumption", "energy_cons", "nrg_bal", "c_forecast")
    later["annual_consumption"] = """
        SELECT state, unique_id, nrg_bal, date, AVG(v) AS energy_cons,
               BOOL_OR(predicted) AS predicted
        FROM (SELECT state, unique_id, nrg_bal, predicted, AVG(energy_cons) AS v,
                     CAST(date_trunc('year', date) AS DATE) AS date
              FROM flagged_consumption GROUP BY ALL) AS t
        GROUP BY state, unique_id, nrg_bal, date"""
    tables |= points
    tables |= prefixed("p_", seasonal("production_points", 1, 12, 48))
    tables |= prefixed("c_", seasonal("consumption_points", 2, 6, 24))
    tables |= later
    tables |= own
    listed = ",\n".join(f"{name} AS ({text})" for name, text in tables.items())
    text = "WITH " + listed + "\n" + " UNION ALL ".join(body)
    return text.replace(f"DATE '{YEAR}'", f"DATE '{FORECAST_YEAR}'")


REPORT_BALANCE = page(BALANCE_PAGE)
REPORT_PRODUCTION = page(PRODUCTION_PAGE)
REPORT_CONSUMPTION = page(CONSUMPTION_PAGE)

SHARE_WIDE = ", ".join(
    f"MAX(CASE WHEN state = '{state}' THEN {column} END) AS \"{column}_{state}\""
    for column in ("label", "percentage", "energy_cons")
    for state in MEMBERS
)
PIVOT_STATES = ", ".join(
    f"SUM(CASE WHEN state = '{state}' THEN energy_prod END) AS \"{state}\"" for state in MEMBERS
)
PIVOT_SECTORS = ", ".join(
    f"CAST(SUM(CASE WHEN nrg_bal = '{code}' THEN energy_cons END) AS BIGINT) AS \"{code}\""
    for code in SEGMENTS
)

ORACLES = {
    "tidy_population": sql("SELECT state, date, population FROM observed"),
    "tidy_projection": sql("SELECT state, date, population FROM projected"),
    "tidy_production": sql(
        """SELECT siec, state, date, energy_prod,
                  CASE WHEN (year(date) + month(date)) % 3 = 0 THEN 'p' END AS flag,
                  state || ';' || siec AS unique_id
           FROM supply WHERE energy_prod > 0"""
    ),
    "tidy_consumption": sql(
        """SELECT nrg_bal, state, date, energy_cons, state || ';' || nrg_bal AS unique_id
           FROM demand"""
    ),
    "cell_quality": sql(
        """SELECT m.date, ANY_VALUE(k.n) AS cells, ANY_VALUE(k.n) - COUNT(s.state) AS missing,
                  CASE WHEN (year(m.date) + month(m.date)) % 3 = 0 THEN COUNT(s.state)
                       ELSE 0 END AS flagged,
                  CAST(0 AS BIGINT) AS unreadable
           FROM months m CROSS JOIN keys k LEFT JOIN supply s ON s.date = m.date
           GROUP BY m.date""",
        months="""SELECT CAST(UNNEST(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '2007-12-01',
                         INTERVAL 1 MONTH)) AS DATE) AS date""",
        keys="SELECT COUNT(*) AS n FROM (SELECT DISTINCT state, siec FROM supply) AS t",
    ),
    "balance": sql("SELECT * FROM yearly_balance"),
    "member_filter": sql(
        f"""SELECT * FROM production WHERE state = '{AGG}'
            OR state IN (SELECT state FROM country WHERE member)"""
    ),
    "annual_sum": sql(
        """SELECT state, unique_id, siec, date, predicted,
                  SUM(v) OVER (PARTITION BY unique_id, date) AS energy_prod
           FROM (SELECT state, unique_id, siec, predicted,
                        CAST(date_trunc('year', date) AS DATE) AS date, SUM(energy_prod) AS v
                 FROM flagged_production GROUP BY 1, 2, 3, 4, 5) AS t"""
    ),
    "annual_sum_collapsed": sql("SELECT * FROM annual_production"),
    "annual_mean": sql(
        """SELECT state, unique_id, nrg_bal, date, predicted,
                  round(AVG(v) OVER (PARTITION BY unique_id, date), 3) AS energy_cons
           FROM (SELECT state, unique_id, nrg_bal, predicted,
                        CAST(date_trunc('year', date) AS DATE) AS date, AVG(energy_cons) AS v
                 FROM several GROUP BY 1, 2, 3, 4, 5) AS t""",
        several="""
            SELECT state, unique_id, nrg_bal, date, energy_cons, predicted FROM flagged_consumption
            UNION ALL SELECT state, unique_id, nrg_bal, date + INTERVAL 4 MONTH, energy_cons * 3,
                             TRUE FROM flagged_consumption
            UNION ALL SELECT state, unique_id, nrg_bal, date + INTERVAL 8 MONTH, energy_cons * 5,
                             TRUE FROM flagged_consumption""",
    ),
    "annual_mean_mixed": sql(
        """SELECT state, unique_id, siec, date, predicted,
                  round(AVG(v) OVER (PARTITION BY unique_id, date), 6) AS energy_prod
           FROM (SELECT state, unique_id, siec, predicted,
                        CAST(date_trunc('year', date) AS DATE) AS date, AVG(energy_prod) AS v
                 FROM flagged_production GROUP BY 1, 2, 3, 4, 5) AS t"""
    ),
    "cast_measure": sql(
        "SELECT state, date, CAST(trunc(deficit / 7) AS BIGINT) AS deficit FROM yearly_balance"
    ),
    "state_catalog": sql(
        f"""SELECT DISTINCT p.state, COALESCE(c.name, p.state) AS name,
                   CASE WHEN p.state = '{AGG}' THEN 'Unione Europea' ELSE c.name END AS title
            FROM production p LEFT JOIN country c ON p.state = c.state ORDER BY name"""
    ),
    "state_catalog_members": sql(
        """SELECT DISTINCT p.state, c.name FROM consumption p JOIN country c ON p.state = c.state
           ORDER BY name"""
    ),
    "category_catalog": sql("SELECT DISTINCT siec FROM production ORDER BY siec"),
    "sector_labels": sql(
        """SELECT DISTINCT nrg_bal AS code, label
           FROM consumption JOIN segment_label ON nrg_bal = code ORDER BY code"""
    ),
    "year_domain": sql(
        """SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM consumption
           WHERE year(date) < (SELECT MAX(year(date)) FROM consumption)"""
    ),
    "has_forecast": sql(
        f"""SELECT COUNT(*) > 0 AS has_forecast FROM flagged_production
            WHERE predicted AND date = DATE '{FORECAST_MONTH}'"""
    ),
    "top_states": sql(top_states("annual_consumption", "energy_cons", "nrg_bal", "FC")),
    "forecast_seasonal": sql(
        ROUNDED_FORECAST, **seasonal("production_points", 1, 12, 48)
    ),
    "forecast_smoothed": sql(
        ROUNDED_FORECAST, **smooth("production_points", 1, 12, 48)
    ),
    "forecast_auto": sql(
        ROUNDED_FORECAST, **chosen_method("production_points", 1, 12, 48)
    ),
    "forecast_category_seasonal": continued(
        "siec = 'TOTAL'", "production", "energy_prod", "siec", seasonal("chosen_points", 1, 12, 48)
    ),
    "forecast_category": continued(
        "siec = 'TOTAL'", "production", "energy_prod", "siec",
        chosen_method("chosen_points", 1, 12, 48),
    ),
    "forecast_state": continued(
        f"state = '{AGG}'", "production", "energy_prod", "siec",
        chosen_method("chosen_points", 1, 12, 48),
    ),
    "forecast_state_seasonal": continued(
        f"state = '{AGG}'", "production", "energy_prod", "siec",
        seasonal("chosen_points", 1, 12, 48),
    ),
    "date_grid": sql(
        "SELECT unique_id, ds, known AS y FROM grid", **grid("consumption_points", 2)
    ),
    "interpolate": sql(
        """SELECT unique_id, ds,
                  round(COALESCE(y, y0 + (y1 - y0) * (i - i0) / (i1 - i0)), 6) AS y
           FROM (SELECT *, LAST_VALUE(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS)
                             OVER before AS i0,
                        LAST_VALUE(y IGNORE NULLS) OVER before AS y0,
                        FIRST_VALUE(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS)
                             OVER after AS i1,
                        FIRST_VALUE(y IGNORE NULLS) OVER after AS y1
                 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY unique_id ORDER BY ds) AS i
                       FROM holed) AS n
                 WINDOW before AS (PARTITION BY unique_id ORDER BY ds
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                        after AS (PARTITION BY unique_id ORDER BY ds
                                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t"""
    ),
    "forward_fill": sql(
        """SELECT unique_id, ds, LAST_VALUE(y IGNORE NULLS) OVER (
                    PARTITION BY unique_id ORDER BY ds
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
           FROM holed"""
    ),
    "upsample_interpolate": sql(
        "SELECT unique_id, ds, round(y, 6) AS y FROM grid", **grid("consumption_points", 2)
    ),
    "forecast_upsampled_seasonal": sql(
        ROUNDED_FORECAST, **seasonal("consumption_points", 2, 6, 24)
    ),
    "forecast_upsampled_smoothed": sql(
        ROUNDED_FORECAST, **smooth("consumption_points", 2, 6, 24)
    ),
    "forecast_upsampled": sql(
        ROUNDED_FORECAST, **chosen_method("consumption_points", 2, 6, 24)
    ),
    "forecast_consumption_next_year": continued(
        "TRUE", "consumption", "energy_cons", "nrg_bal", seasonal("chosen_points", 2, 6, 24),
        next_year=True,
    ),
    "forecast_consumption": continued(
        "TRUE", "consumption", "energy_cons", "nrg_bal", chosen_method("chosen_points", 2, 6, 24)
    ),
    "clip_nonnegative": sql(
        """SELECT state, date, CASE WHEN deficit < 0 THEN 0 ELSE deficit END AS deficit
           FROM yearly_balance"""
    ),
    "population": sql("SELECT state, date, round(population, 6) AS population FROM people"),
    "forecast_span": sql(
        """SELECT MIN(date) AS start, MAX(date) AS "end" FROM flagged_production WHERE predicted"""
    ),
    "forecast_span_from": sql(
        f"""SELECT DATE '{YEAR}' AS start, MAX(date) AS "end" FROM flagged_production"""
    ),
    "state_code": sql(
        f"""SELECT DISTINCT COALESCE(c.name, p.state) AS name, p.state
            FROM production p LEFT JOIN country c ON p.state = c.state"""
    ),
    "default_states": sql(
        f"""SELECT p.* FROM production p JOIN country c ON p.state = c.state
            WHERE c.name IN {_in(DEFAULT_STATES)}"""
    ),
    "tidy_text": sql(
        """SELECT siec, state, date, energy_prod,
                  CASE WHEN (year(date) + month(date)) % 3 = 0 THEN 'p' END AS flag,
                  state || ';' || siec AS unique_id
           FROM supply WHERE energy_prod > 0"""
    ),
    "revised_table": sql(
        f"""SELECT siec, state, date, unique_id,
                   energy_prod * COALESCE(times, 1) AS energy_prod,
                   COALESCE(loaded, DATE '2024-01-01') AS loaded
            FROM production LEFT JOIN revision
                 ON siec = category AND year(date) = 1996 AND loaded > DATE '2024-01-01'""",
        revision=f"""SELECT category, CAST(loaded AS DATE) AS loaded, times
                     FROM (VALUES {', '.join(map(str, REVISIONS))}) AS r(category, loaded, times)""",
    ),
    "date_grid_monthly": sql(
        "SELECT unique_id, ds, round(known, 6) AS y FROM grid",
        totals="SELECT unique_id, date AS ds, energy_prod AS y FROM production WHERE siec = 'TOTAL'",
        **on_grid("totals", 2), **grid("aligned", 2),
    ),
    "upsample_monthly": sql(
        "SELECT unique_id, ds, round(y, 6) AS y FROM grid",
        **on_grid("production_points", 3), **grid("aligned", 3),
    ),
    "lines_map": sql(
        """SELECT date, string_agg(state, ',' ORDER BY state) AS states,
                  string_agg(CAST(CAST(energy_prod AS DECIMAL(38,2)) AS VARCHAR), ',' ORDER BY state)
                    AS sums
           FROM production WHERE siec = 'TOTAL' GROUP BY date"""
    ),
    "sector_share_map": sql(
        f"""SELECT date, nrg_bal, string_agg(state, ',' ORDER BY state) AS states,
                   string_agg(label, ',' ORDER BY state) AS labels,
                   string_agg(CAST(CAST(percentage AS DECIMAL(38,2)) AS VARCHAR), ',' ORDER BY state)
                     AS percentages,
                   string_agg(CAST(CAST(energy_cons AS DECIMAL(38,2)) AS VARCHAR), ',' ORDER BY state)
                     AS sums
            FROM ({SECTOR_SHARE}) AS t GROUP BY date, nrg_bal"""
    ),
    "upsample_daily": sql(
        "SELECT unique_id, ds, round(y, 6) AS y FROM grid",
        daily="""SELECT n_name AS unique_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
                        AVG(CAST(o_totalprice AS DOUBLE)) AS y
                 FROM orders JOIN customer ON o_custkey = c_custkey
                      JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
        **grid("daily", 1),
    ),
    "map_table": sql(
        f"""SELECT s.id, v.state, v.deficit
            FROM (SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS id FROM nation) AS s
            LEFT JOIN ({MEMBER_BALANCE}) AS v ON s.id = v.id"""
    ),
    "map_domain": sql(
        f"SELECT MIN(deficit) AS low, MAX(deficit) AS high FROM ({MEMBER_BALANCE}) AS v"
    ),
    "lines_production": sql(LINES_PRODUCTION),
    "lines_pivot": sql(
        f"SELECT date, {PIVOT_STATES} FROM production WHERE siec = 'TOTAL' GROUP BY date"
    ),
    "lines_pivot_sectors": sql(
        f"SELECT date, {PIVOT_SECTORS} FROM ({SECTOR_LINES}) AS t GROUP BY date"
    ),
    "last_point": sql(
        last_points("shown", "state"),
        shown=f"SELECT * FROM flagged_production WHERE siec = 'TOTAL' AND state <> '{AGG}'",
    ),
    "member_average": sql(
        f"SELECT * REPLACE (round(y2, 6) AS y2) FROM ({MEMBER_AVERAGE}) AS t"
    ),
    "padded_domain": sql(
        f"""SELECT round(MIN(y2) - 0.3 * MIN(y2), 6) AS low,
                   round(MAX(y2) + 0.3 * MAX(y2), 6) AS high FROM ({MEMBER_AVERAGE}) AS t"""
    ),
    "interval_band": sql(
        f"""SELECT date, nrg_bal, round(low, 6) AS low, round(high, 6) AS high
            FROM ({SECTOR_LINES}) AS t WHERE predicted"""
    ),
    "lines_balance": sql(LINES_BALANCE),
    "stacked_area": sql(stacked(f"date > DATE '{SINCE}'")),
    "stacked_area_inclusive": sql(stacked(f"state = '{AGG}' AND date >= DATE '{SINCE}'")),
    "completeness_year": sql(
        f"""SELECT * REPLACE (round(missing_percentage, 6) AS missing_percentage)
            FROM ({completeness('state, date', 'TRUE')}) AS t"""
    ),
    "completeness_all": sql(
        f"""SELECT * REPLACE (round(missing_percentage, 6) AS missing_percentage)
            FROM ({completeness('state', f"date >= DATE '{SINCE}'")}) AS t"""
    ),
    "distinct_total": sql(
        """SELECT state, CAST(SUM(DISTINCT trunc(energy_prod)) AS BIGINT) AS total
           FROM production WHERE siec = 'TOTAL' GROUP BY state"""
    ),
    "single_total": sql(
        """SELECT state, date, CAST(MIN(trunc(energy_cons)) AS BIGINT) AS total,
                  COUNT(DISTINCT trunc(energy_cons)) = 1 AS "unique"
           FROM (SELECT * FROM consumption UNION ALL
                 SELECT nrg_bal, state, date, energy_cons + 7, unique_id FROM consumption
                 WHERE year(date) % 2 = 0) AS t
           WHERE nrg_bal = 'FC' GROUP BY state, date"""
    ),
    "top5_rank_by_year": sql(TOP_RANK),
    "balance_ranking": sql(RANKING),
    "sector_share": sql(SECTOR_SHARE),
    "sector_share_wide": sql(
        f"SELECT date, nrg_bal, {SHARE_WIDE} FROM ({SECTOR_SHARE}) AS t GROUP BY date, nrg_bal"
    ),
    "product_mix": sql(PRODUCT_MIX),
    "per_capita_vs_average": sql(PER_CAPITA),
    "above_average": sql(ABOVE),
    "report_balance": REPORT_BALANCE,
    "report_production": REPORT_PRODUCTION,
    "report_consumption": REPORT_CONSUMPTION,
    "report_balance_forecast": forecast_page(BALANCE_PAGE),
    "report_production_forecast": forecast_page(PRODUCTION_PAGE),
    "report_consumption_forecast": forecast_page(CONSUMPTION_PAGE),
}

