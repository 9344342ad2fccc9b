"""Calendar, flag and cyclic features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadflow import schema as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def parse_ts(col, fmt: str | None = None) -> Column:
    """Text → naive timestamp; unparseable text → null (F1)."""
    c = _c(col)
    if fmt is None:
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def quarter_of_month(m) -> Column:
    """(m - 1) div 3 + 1."""
    return (F.floor((_c(m) - 1) / 3) + 1).cast("int")


def minute_label(ts) -> Column:
    """Timestamp → 'yyyy-MM-dd HH:mm' (F4)."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm")


def is_weekend(dow) -> Column:
    """1.0 when dow >= 5 (Saturday, Sunday)."""
    return (_c(dow) >= S.WEEKEND_FROM_DOW).cast("double")


def is_holiday(name) -> Column:
    """1.0 for a named holiday; null and 'None' are not holidays."""
    c = _c(name)
    return F.when(c.isNotNull() & (c != F.lit("None")), 1.0).otherwise(0.0)


def rush_hour(hour) -> Column:
    """1.0 in the morning and evening rush hours."""
    return _c(hour).isin(*S.RUSH_HOURS).cast("double")


def night(hour) -> Column:
    """1.0 for hours 0-5 (feature) (F8)."""
    lo, hi = S.NIGHT_HOURS
    return _c(hour).between(lo, hi).cast("double")


def late_night(hour) -> Column:
    """True for hours 0-4 (message window, differs from ``night``) (F8)."""
    lo, hi = S.LATE_NIGHT_HOURS
    return _c(hour).between(lo, hi)


def kelvin_to_c(temp) -> Column:
    """Kelvin → Celsius."""
    return _c(temp) - S.KELVIN_OFFSET


def cyclic(col, period: int) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*x/period."""
    angle = F.lit(2 * math.pi) * _c(col) / period
    return F.sin(angle), F.cos(angle)
