"""Scenario queries (C1-C4) on the day x hour mean predictor."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow.functions import levels as L
from roadflow.operators import scenario as Sc
from roadflow.plans import sql as Q
from roadflow.plans.catalog import register
from roadflow.plans.common import events_feat
from roadflow.plans.q_features import REQUESTS_SQL, requests

_BASE_SQL = Q.with_events(REQUESTS_SQL, """
dm AS (SELECT dow, hour, avg(CAST(traffic_volume AS DOUBLE)) AS m FROM feat GROUP BY dow, hour),
g AS (SELECT avg(CAST(traffic_volume AS DOUBLE)) AS gm FROM feat),
rh AS (SELECT r.*, CAST(h.hour AS INTEGER) AS fh FROM req r, (SELECT range AS hour FROM range(24)) h),
bv AS (SELECT rh.*, greatest(coalesce(dm.m, g.gm), 0.0) AS v FROM rh LEFT JOIN dm ON rh.dow = dm.dow AND rh.fh = dm.hour, g),
sc AS (SELECT request_id, fh AS hour, CAST(round_even(v, 0) AS BIGINT) AS base,
              CAST(round_even(greatest(v * (1 - weather_severity / 100 * 0.3) * (1 + special_event / 100 * 0.4)
                                       * (1 + incident / 100 * 0.2) * (1 - remote_work / 100 * 0.25), 0.0), 0) AS BIGINT) AS modified,
              v FROM bv)""")


def _scenario(spark, sf):
    obs = events_feat(spark, sf)
    overall = obs.agg(F.avg(F.col("traffic_volume").cast("double"))).scalar()
    predictor = Sc.table_predictor(Sc.fit_mean_table(obs), fallback=overall)
    hours = predictor(Sc.explode_hours(requests(spark, sf)))
    return Sc.apply_scenario(hours)


@register("apply_scenario", _BASE_SQL + f"""
SELECT request_id, hour, base, modified, {Q.level('v')} AS level, {Q.risk('v')} AS risk FROM sc""")
def q_apply_scenario(spark, sf):
    """C2 + C3: 24-hour base curve per request and its what-if modification."""
    s = _scenario(spark, sf)
    v = L.clamp(F.col("volume_raw"), lo=0.0)
    return s.select("request_id", "hour", "base", "modified", L.level(v).alias("level"), L.risk(v).alias("risk"))


@register("scenario_summary", _BASE_SQL + """
SELECT request_id, CAST(round_even(avg(base), 0) AS BIGINT) AS base_avg,
       CAST(round_even(avg(modified), 0) AS BIGINT) AS mod_avg,
       array_to_string(list(base ORDER BY hour), ',') AS base_curve,
       array_to_string(list(modified ORDER BY hour), ',') AS modified_curve FROM sc GROUP BY request_id""")
def q_scenario_summary(spark, sf):
    """C4: daily base / modified means and curves per request."""
    s = Sc.scenario_summary(_scenario(spark, sf))
    return s.select("request_id", "base_avg", "mod_avg",
                    F.array_join(F.col("base_curve").cast("array<string>"), ",").alias("base_curve"),
                    F.array_join(F.col("modified_curve").cast("array<string>"), ",").alias("modified_curve"))
