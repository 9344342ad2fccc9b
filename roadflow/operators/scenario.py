"""Predict, 24-hour forecast and what-if scenarios over tables of requests
(C1-C4).

Requests are rows, so thousands of them are scored in one job: a forecast
explodes each request into its 24 hours on the executors and the predictor
runs as a projection (or an MLlib transform) over all of them at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.functions import levels as L
from roadflow.operators.broadcast import bounded_broadcast


def explode_hours(requests: DataFrame) -> DataFrame:
    """C2 step: one row per (request, hour 0..23)."""
    return requests.drop("hour").select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))


def decorate(df: DataFrame, vol: str = "volume_raw") -> DataFrame:
    """C1 tail: clip at 0, round half-even, level / colour / risk of the
    unrounded volume (as the service computes them before rounding).  A null
    prediction stays null in every column."""
    return df.withColumn("_v", L.clamp(F.col(vol), lo=0.0)).select(
        "*", F.bround("_v").cast("bigint").alias("volume"), L.level("_v").alias("level"),
        L.level_color("_v").alias("color"), L.risk("_v").alias("risk")).drop("_v")


def predict_requests(requests: DataFrame, predictor) -> DataFrame:
    """Volume, level, colour, risk and explanation factors per request.

    ``predictor(df)`` adds ``volume_raw`` (an MLlib model wrapper or a table
    lookup); it runs on executors over every request at once.
    """
    scored = decorate(predictor(requests))
    return scored.withColumn("factors", L.factors("hour", "dow", "rain", "snow"))


def forecast24(requests: DataFrame, predictor) -> DataFrame:
    """The 24-hour curve per request."""
    return decorate(predictor(explode_hours(requests)))


def apply_scenario(df: DataFrame, base: str = "volume_raw") -> DataFrame:
    """What-if multipliers (severity, event, incident, remote work; all in
    percent) on the unrounded base, clipped at 0, rounded half-even; a null base
    stays null."""
    v = L.clamp(F.col(base), lo=0.0)
    mod = (v * (1 - F.col("weather_severity") / 100 * S.SCENARIO_WEATHER)
           * (1 + F.col("special_event") / 100 * S.SCENARIO_EVENT)
           * (1 + F.col("incident") / 100 * S.SCENARIO_INCIDENT)
           * (1 - F.col("remote_work") / 100 * S.SCENARIO_REMOTE))
    return df.withColumns({"base": F.bround(v).cast("bigint"),
                           "modified": F.bround(L.clamp(mod, lo=0.0)).cast("bigint")})


def scenario_summary(scen: DataFrame, key: str = "request_id") -> DataFrame:
    """C4: daily means of the rounded values (rounded half-even) and the
    hour-ordered 24-element base / modified arrays per request."""
    return scen.groupBy(key).agg(
        F.bround(F.avg("base")).cast("bigint").alias("base_avg"),
        F.bround(F.avg("modified")).cast("bigint").alias("mod_avg"),
        F.transform(F.sort_array(F.collect_list(F.struct("hour", "base"))), lambda s: s["base"]).alias("base_curve"),
        F.transform(F.sort_array(F.collect_list(F.struct("hour", "modified"))), lambda s: s["modified"])
        .alias("modified_curve"))


def table_predictor(means: DataFrame, keys=("dow", "hour"), fallback=None):
    """A predictor from a fitted mean table (e.g. mean volume by dow x hour):
    lookup with a fallback value for unseen keys.  Day-of-week and hour keys give
    at most 168 rows; any other table is counted before it may be broadcast."""
    bound = 168 if set(keys) <= {"dow", "hour"} else None

    def predict(df: DataFrame) -> DataFrame:
        m = bounded_broadcast(means, known_rows=bound) if bound else bounded_broadcast(means)
        out = df.join(m, list(keys), "left")
        pred = F.col("_mean") if fallback is None else F.coalesce(F.col("_mean"), fallback)
        return out.withColumn("volume_raw", pred).drop("_mean")
    return predict


def fit_mean_table(obs: DataFrame, keys=("dow", "hour"), y: str = "traffic_volume") -> DataFrame:
    return obs.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("_mean"))
