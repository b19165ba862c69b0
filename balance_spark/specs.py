"""Descriptions of the tables the operators work on.

A tidy table holds one row per (series, date).  Which column is the measure, which
one is the category and how months become years is said here, so that no operator
has to guess it from a column list.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

#: State code of the row set that sums all member states.
AGGREGATE = "EU27_2020"


@dataclass(frozen=True)
class Measure:
    """One measure of a tidy table: ``state, date, <category>, <value>, unique_id``."""

    value: str
    category: str
    total: str
    annual: str  # "sum" or "mean"

    def __post_init__(self):
        if self.annual not in ("sum", "mean"):
            raise ValueError(f"annual must be 'sum' or 'mean', not {self.annual!r}")


@dataclass(frozen=True)
class WideSource:
    """A wide statistical table: composite key column, then one column per period.

    ``keep`` maps a key part to the codes that survive; ``positive`` drops zero and
    negative cells; ``lenient_period`` turns unreadable period headers into dropped
    rows instead of an error.
    """

    value: str
    period: str  # "yyyy" or "yyyy-MM"
    keep: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    category: str | None = None
    positive: bool = False
    lenient_period: bool = False
    drop_states: tuple[str, ...] = ()


@dataclass(frozen=True)
class ForecastPlan:
    """How far, how densely and with which season a series is continued."""

    season: int
    step_months: int
    horizon: int
    method: str = "auto"  # "auto", "trend", "seasonal", "smoothed" or "arma"
    level: float = 0.95


PRODUCTION = Measure("energy_prod", "siec", "TOTAL", "sum")
CONSUMPTION = Measure("energy_cons", "nrg_bal", "FC", "mean")
BALANCE = Measure("deficit", "def_id", "TOTAL;FC", "mean")

#: Four years ahead, monthly and every second month.
PRODUCTION_FORECAST = ForecastPlan(season=12, step_months=1, horizon=48)
CONSUMPTION_FORECAST = ForecastPlan(season=6, step_months=2, horizon=24)
