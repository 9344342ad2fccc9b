"""Fitted scaling state as one-row DataFrames.

Statistics are computed on the train split only (one aggregate job, partial +
final).  Applying them is a map-only projection: the fitted row (a few
scalars - model parameters, not data) is read once and the values enter the
plan as literals, as MLlib's own scalers do.  Training and serving use the
same fitted state, and no join or subquery is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow import schema as S


def fit_scaler(train: DataFrame, cols) -> DataFrame:
    """Mean and *population* std per column; zero std → 1."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(F.col(c).cast("double")).alias(f"{c}__mean"))
        sd = F.stddev_pop(F.col(c).cast("double"))
        aggs.append(F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd).alias(f"{c}__std"))
    return train.agg(*aggs)


def fitted_values(stats: DataFrame) -> dict:
    """The fitted one-row state as plain numbers (one small job)."""
    row = stats.first()
    return row.asDict() if row is not None else {}


def apply_scaler(df: DataFrame, stats, cols, suffix: str = "") -> DataFrame:
    """Standardise ``cols`` with fitted ``stats`` (one-row frame or its dict)."""
    v = stats if isinstance(stats, dict) else fitted_values(stats)
    scaled = {f"{c}{suffix}": (F.col(c).cast("double") - F.lit(v[f"{c}__mean"])) / F.lit(v[f"{c}__std"])
              for c in cols}
    return df.withColumns(scaled)


def _target_scale(y: str, kind: str):
    v = F.col(y).cast("double")
    if kind == "minmax_eps":
        return F.min(v), F.max(v) - F.min(v) + S.TARGET_SCALE_EPS
    if kind == "minmax":
        return F.min(v), F.max(v) - F.min(v)
    if kind == "zscore":
        return F.avg(v), F.stddev_pop(v)
    raise ValueError(kind)


def fit_target_scale(train: DataFrame, y: str = S.TARGET, kind: str = "minmax_eps") -> DataFrame:
    """F17 state: ``minmax_eps`` (max-min+1e-8), ``minmax`` (no eps) or ``zscore``
    (population std) → one row (``t_shift``, ``t_scale``)."""
    shift, scale = _target_scale(y, kind)
    return train.agg(shift.alias("t_shift"), scale.alias("t_scale"))


def fit_target_scales(train: DataFrame, kinds, y: str = S.TARGET) -> dict[str, dict]:
    """The state of several kinds from one aggregate."""
    row = train.agg(*(c.alias(f"{k}_{n}") for k in kinds
                      for n, c in zip(("t_shift", "t_scale"), _target_scale(y, k)))).first()
    return {k: {n: row[f"{k}_{n}"] for n in ("t_shift", "t_scale")} for k in kinds}


def scale_target(df: DataFrame, stats, y: str = S.TARGET, out: str = "y_scaled") -> DataFrame:
    v = stats if isinstance(stats, dict) else fitted_values(stats)
    return df.withColumn(out, (F.col(y).cast("double") - F.lit(v["t_shift"])) / F.lit(v["t_scale"]))


def unscale_target(df: DataFrame, stats, col: str = "y_scaled", out: str = "y_unscaled") -> DataFrame:
    v = stats if isinstance(stats, dict) else fitted_values(stats)
    return df.withColumn(out, F.col(col) * F.lit(v["t_scale"]) + F.lit(v["t_shift"]))
