"""Congestion level, colour, risk, bins, tags and explanation factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.functions.calendar import _c, late_night


def _missing(v: Column) -> Column:
    return v.isNull() | F.isnan(v.cast("double"))


def _by_level(v, values) -> Column:
    c = _c(v)
    a, b, d = S.LEVEL_CUTS
    return (F.when(_missing(c), F.lit(None))
            .when(c < a, F.lit(values[0]))
            .when(c < b, F.lit(values[1]))
            .when(c < d, F.lit(values[2]))
            .otherwise(F.lit(values[3])))


def level(v) -> Column:
    """LOW / MEDIUM / HIGH / SEVERE; null in → null out."""
    return _by_level(v, S.LEVEL_NAMES)


def level_color(v) -> Column:
    """Hex colour of the level."""
    return _by_level(v, S.LEVEL_COLORS)


def level_emoji(v, short: bool = False) -> Column:
    """Emoji label of the level, short (MED/SEV) or long style."""
    return _by_level(v, S.LEVEL_EMOJI_SHORT if short else S.LEVEL_EMOJI_LONG)


def risk(v) -> Column:
    """0-100 risk, piecewise linear within each level, half-even, capped."""
    c = _c(v).cast("double")
    a, b, d = S.LEVEL_CUTS
    return (F.when(_missing(c), F.lit(None))
            .when(c < a, F.bround(c / a * 25))
            .when(c < b, F.bround(25 + (c - a) / (b - a) * 25))
            .when(c < d, F.bround(50 + (c - b) / (d - b) * 25))
            .otherwise(F.least(F.lit(float(S.RISK_CAP)),
                               F.bround(75 + (c - d) / (d - b) * 25)))
            ).cast("int")


def clamp(x, lo=None, hi=None) -> Column:
    """Clip into [lo, hi]; either bound may be omitted; null in, null out (F16).

    ``least`` and ``greatest`` skip nulls, so a null is guarded here.
    """
    x = c = _c(x)
    if hi is not None:
        c = F.least(c, F.lit(hi))
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    return F.when(x.isNotNull(), c)


def cut(col, edges, labels) -> Column:
    """Right-closed bins (a, b]; values outside every bin → null."""
    c = _c(col)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def temp_bin(temp_c) -> Column:
    """Temperature band in Celsius."""
    return cut(temp_c, S.TEMP_BIN_EDGES, S.TEMP_BIN_LABELS)


def fixed_bins(v, width: int = S.HISTOGRAM_WIDTH, top: int = S.HISTOGRAM_TOP_BIN) -> Column:
    """Fixed-width bin index, last bin open-ended."""
    return F.least(F.floor(_c(v) / width), F.lit(top)).cast("int")


def float_text(x) -> Column:
    """A double as the shortest text that names it, with an exponent below 1e-4 and from 1e16.

    Spark turns to exponents below 1e-3 and from 1e7, and writes them as ``1.0E-5``.
    """
    plain = _c(x).cast("double").cast("string")
    mantissa = F.substring_index(plain, "E", 1)
    power = F.substring_index(plain, "E", -1).try_cast("int")
    sign = F.when(mantissa.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), "[-.]", "")
    places = F.length(digits) - 1
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.concat(sign, F.rpad(digits, F.greatest(power + 1, places + 1), F.lit("0")))
    large = F.when(places <= power, F.concat(large, F.lit(".0"))).otherwise(
        F.concat(sign, F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, places)))
    short = F.regexp_replace(mantissa, r"\.0$", "")
    two = F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0"))
    far = F.concat(short, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), two)
    return (F.when(~plain.contains("E"), plain).when((power < 0) & (power >= -4), small)
            .when((power >= 0) & (power < 16), large).otherwise(far))


def factors(hour, dow, rain, snow) -> Column:
    """Ordered explanation strings; the default when none applies."""
    h, d, r, s = _c(hour), _c(dow), _c(rain), _c(snow)
    items = F.array(
        F.when(h.isin(*S.MORNING_RUSH), F.lit(S.FACTOR_MORNING)),
        F.when(h.isin(*S.EVENING_RUSH), F.lit(S.FACTOR_EVENING)),
        F.when(late_night(h), F.lit(S.FACTOR_LATE_NIGHT)),
        F.when(d >= S.WEEKEND_FROM_DOW, F.lit(S.FACTOR_WEEKEND)),
        F.when(r > 0, F.replace(F.lit(S.FACTOR_RAIN), F.lit("{}"), float_text(r))),
        F.when(s > 0, F.replace(F.lit(S.FACTOR_SNOW), F.lit("{}"), float_text(s))),
    )
    present = F.filter(items, lambda x: x.isNotNull())
    return F.when(F.size(present) == 0, F.array(F.lit(S.FACTOR_DEFAULT))).otherwise(present)


def period(hour) -> Column:
    """Named time-of-day period (non-overlapping windows)."""
    h = _c(hour)
    out = None
    for name, lo, hi in S.PERIODS:
        cond = h.between(lo, hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def window_name(hour) -> Column:
    """Named window of the hourly profile, null outside all windows."""
    h = _c(hour)
    out = None
    for name, lo, hi in S.WINDOWS:
        cond = h.between(lo, hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def corr_tag(r) -> Column:
    """Correlation strength tag."""
    c = _c(r)
    return (F.when(c.isNull(), F.lit(None))
            .when(c <= -0.3, F.lit("Negative"))
            .when(F.abs(c) >= 0.3, F.lit("Strong"))
            .when(F.abs(c) >= 0.15, F.lit("Moderate"))
            .otherwise(F.lit("Weak")))


def fit_status(train_r2, test_r2, is_best=None) -> Column:
    """Fit-gap status tag."""
    tr, te = _c(train_r2), _c(test_r2)
    out = F.when(tr < 0.8, F.lit("Underfit")).when(tr - te > 0.06, F.lit("Slight Overfit"))
    if is_best is not None:
        out = out.when(_c(is_best), F.lit("Best Balance"))
    return out.otherwise(F.lit("Good"))
