"""Baseline predictors: train-split means by a key, as Spark joins.

They give every evaluation operator a prediction column that plain SQL can
reproduce.  Group means are fitted on the train split only (no leak); a key
absent from train falls back to the overall train mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadflow.operators.broadcast import bounded_broadcast

# key columns → (model name, structural bound on the number of groups or None)
BASELINES = {
    "Global Mean": ((), 1),
    "Hourly Mean": (("hour",), 24),
    "Weather Mean": (("weather_main",), None),
    "Day-Hour Mean": (("dow", "hour"), 168),
}


def mean_predictions(split_df: DataFrame, name: str, keys=(), bound: int | None = None,
                     y: str = "traffic_volume", ts: str = "date_time") -> DataFrame:
    """Predictions of one baseline for every row (train and test)."""
    train = split_df.where(F.col("split") == "train")
    overall = train.agg(F.avg(F.col(y).cast("double"))).scalar()
    base = split_df.select("split", *_index(split_df), F.col(ts).alias("ts"),
                           F.col(y).cast("double").alias("actual"), *keys)
    if keys:
        gm = train.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("_gm"))
        gm = bounded_broadcast(gm, known_rows=bound) if bound else bounded_broadcast(gm)
        base = base.join(gm, list(keys), "left")
        pred = F.coalesce(F.col("_gm"), overall)
    else:
        pred = overall
    return base.select(F.lit(name).alias("model"), "split", *_index(split_df), "ts", "actual",
                       pred.alias("predicted"))


def _index(split_df: DataFrame) -> list[str]:
    """The row index, where the split carries one."""
    return [c for c in ("row_idx",) if c in split_df.columns]


def baseline_predictions(split_df: DataFrame, y: str = "traffic_volume", ts: str = "date_time") -> DataFrame:
    """All four baselines for every row in one pass over the data.

    1. one aggregate over (dow, hour, weather) carries train sums and counts
       (test-only cells get zero counts) - a table of at most 168 x labels rows;
    2. the four predictors are window means over that tiny table (no join
       between small tables);
    3. one broadcast lookup (size-checked) attaches them to every row, and an
       ``explode`` emits the four model rows.
    """
    keys = ["dow", "hour", "weather_main"]
    yv = F.col(y).cast("double")
    is_train = F.col("split") == "train"
    cells = split_df.groupBy(*keys).agg(F.sum(F.when(is_train, yv)).alias("_s"),
                                        F.count(F.when(is_train, yv)).alias("_c"))

    def wmean(*part):
        w = Window.partitionBy(*part)
        return F.try_divide(F.sum("_s").over(w), F.sum("_c").over(w))

    g = wmean()
    lookup = cells.select(
        *keys,
        g.alias("p_global"),
        F.coalesce(wmean("hour"), g).alias("p_hour"),
        F.coalesce(F.when(F.col("weather_main").isNotNull(), wmean("weather_main")), g).alias("p_weather"),
        F.coalesce(wmean("dow", "hour"), g).alias("p_dow_hour"))
    lk = bounded_broadcast(lookup.withColumnsRenamed({k: f"_{k}" for k in keys}))
    cond = [split_df[k].eqNullSafe(lk[f"_{k}"]) for k in keys]
    joined = split_df.join(lk, cond, "left")
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("predicted")) for n, c in (
        ("Global Mean", "p_global"), ("Hourly Mean", "p_hour"), ("Weather Mean", "p_weather"),
        ("Day-Hour Mean", "p_dow_hour"))])
    index = _index(split_df)
    return joined.select("split", *index, F.col(ts).alias("ts"), yv.alias("actual"),
                         F.inline(models)).select("model", "split", *index, "ts", "actual", "predicted")
