"""Column expressions that read the cells and headers of wide statistical tables."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell texts that stand for "no observation".
NULL_MARKERS = ("", ":", ": ")

_LETTERS = string.ascii_letters


def _packed(raw: Column) -> Column:
    return F.replace(raw, F.lit(" "), F.lit(""))


def _without_flag(raw: Column) -> Column:
    return F.rtrim(_packed(raw), F.lit(_LETTERS))


def cell_value(raw: Column) -> Column:
    """The number in front of the flag letters; NULL for missing or unreadable cells."""
    return _without_flag(raw).try_cast("double")


def cell_flag(raw: Column) -> Column:
    """The flag letters at the end of a cell, NULL when there are none."""
    packed = _packed(raw)
    flag = F.substring(packed, F.length(_without_flag(raw)) + 1, F.length(packed))
    return F.nullif(flag, F.lit(""))


def is_missing(raw: Column) -> Column:
    """True for the null markers, with or without a flag (``:``, ``: ``, ``:c``)."""
    return raw.isNull() | (_packed(raw) == "") | F.startswith(_packed(raw), F.lit(":"))


def period_start(header: Column, fmt: str, lenient: bool = False) -> Column:
    """First day of the period a column header names."""
    text = F.trim(header)
    return F.try_to_date(text, fmt) if lenient else F.to_date(text, fmt)


def state_code(geo: Column) -> Column:
    """State code with the one non-ISO code of the sources (``EL``) put right."""
    return F.when(geo == "EL", "GR").otherwise(geo)
