"""Adapter, request and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.functions import calendar as C
from roadflow.functions import levels as L
from roadflow.operators import features as Fe
from roadflow.operators import profiles as P
from roadflow.plans import sql as Q
from roadflow.plans.catalog import register
from roadflow.plans.common import events_feat, events_obs
from roadflow.sources.observations import obs_orders
from roadflow.sources.requests import decode_requests, requests_from_events
from roadflow.sources.sinks import to_json_records

_OBS_COLS = ", ".join(S.OBS_COLUMNS)


@register("obs_events", Q.with_events() + f"\nSELECT {_OBS_COLS} FROM obs")
def q_obs_events(spark, sf):
    """``events`` projected onto the observation schema."""
    return events_obs(spark, sf)


@register("obs_orders", Q.with_orders() + f"\nSELECT {_OBS_COLS} FROM obs")
def q_obs_orders(spark, sf):
    """``orders`` projected onto the observation schema."""
    return obs_orders(spark, sf)


def _r9(c):
    return F.bround(c, 9)


_FEATURE_OUT = ["obs_id", "date_time", "hour", "dow", "month", "quarter", "year", "is_weekend",
                "is_holiday", "rush_hour", "night", "weather_enc"]
_ROUNDED = ["temp_c", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]


@register("add_features", Q.with_events() + "\nSELECT " + ", ".join(
    _FEATURE_OUT + [f"round_even({c}, 9) AS {c}" for c in _ROUNDED]) + " FROM feat")
def q_add_features(spark, sf):
    """Calendar, flags, Celsius, cyclic encodings and weather code."""
    df = events_feat(spark, sf, encode=True)
    return df.select(*_FEATURE_OUT, *[_r9(F.col(c)).alias(c) for c in _ROUNDED])


@register("canonical_features", Q.with_orders() + "\nSELECT obs_id, traffic_volume, " + ", ".join(
    f"round_even({c}, 9) AS {c}" if c in _ROUNDED else c for c in S.FS18)
    + " FROM feat WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in
                                          [x for x in S.OBS_COLUMNS if x != "holiday"] + S.FS18))
def q_canonical_features(spark, sf):
    """P1 + P2 + P4: drop ``holiday``, derive, drop incomplete rows, select FS18."""
    df = Fe.canonical_features(obs_orders(spark, sf))
    sel = Fe.select_features(df, "FS18", keep=("obs_id", "traffic_volume"))
    return sel.select(*[_r9(F.col(c)).alias(c) if c in _ROUNDED else F.col(c) for c in sel.columns])


@register("row_levels", Q.with_events() + f"""
SELECT obs_id, traffic_volume, {Q.level('traffic_volume')} AS level, {Q.color('traffic_volume')} AS color,
       {Q.risk('traffic_volume')} AS risk, {Q.emoji('traffic_volume')} AS level_emoji,
       {Q.emoji('traffic_volume', True)} AS level_emoji_short,
       CASE WHEN traffic_volume IS NOT NULL THEN least(greatest(CAST(traffic_volume AS DOUBLE), 0.0), 10000.0) END AS clipped,
       strftime(date_time, '%Y-%m-%d %H:%M') AS minute FROM feat""")
def q_row_levels(spark, sf):
    """Per-row level, colour, risk, emoji labels, clip, minute label."""
    df = events_feat(spark, sf)
    v = "traffic_volume"
    return df.select("obs_id", v, L.level(v).alias("level"), L.level_color(v).alias("color"),
                     L.risk(v).alias("risk"), L.level_emoji(v).alias("level_emoji"),
                     L.level_emoji(v, short=True).alias("level_emoji_short"),
                     L.clamp(F.col(v).cast("double"), *S.PREDICTION_CLIP).alias("clipped"),
                     C.minute_label("date_time").alias("minute"))


@register("filter_valid", Q.with_events() + f"""
SELECT {_OBS_COLS} FROM obs WHERE coalesce(temp > 0, true) AND coalesce(rain_1h <= 500, true) AND coalesce(snow_1h <= 5, true)""")
def q_filter_valid(spark, sf):
    """Reject impossible readings."""
    return Fe.filter_valid(events_obs(spark, sf))


@register("only_weekend", Q.with_events() + """
SELECT obs_id, date_time, dow, traffic_volume FROM feat WHERE is_weekend = 1""")
def q_only_weekend(spark, sf):
    """Weekend rows."""
    return Fe.only_weekend(events_feat(spark, sf)).select("obs_id", "date_time", "dow", "traffic_volume")


@register("heatmap_json", Q.with_events(f"""
h AS (SELECT dow, hour, {Q.mean_int()} AS volume FROM feat
      WHERE dow IS NOT NULL AND hour IS NOT NULL GROUP BY dow, hour)""") + f"""
SELECT CAST(to_json({{'dow': dow, 'hour': hour, 'volume': volume, 'level': {Q.level('volume')},
                'color': {Q.color('volume')}, 'risk': {Q.risk('volume')}}}) AS VARCHAR) AS json FROM h""")
def q_heatmap_json(spark, sf):
    """Heatmap answer encoded as one JSON record per cell."""
    return to_json_records(P.heatmap(events_feat(spark, sf)))


_K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER)"
REQUESTS_SQL = f"""
req AS (
  SELECT event_id AS request_id,
    CAST(CASE WHEN event_type <> 'signup' THEN hour(ts) ELSE 8 END AS INTEGER) AS hour,
    CAST(CASE WHEN event_type <> 'view' THEN isodow(ts) - 1 ELSE 0 END AS INTEGER) AS dow,
    CAST(CASE WHEN event_type <> 'click' THEN {_K} % 12 + 1 ELSE 6 END AS INTEGER) AS month,
    CASE WHEN event_type <> 'error' THEN CAST({_K} AS DOUBLE) * 0.5 - 10.0 ELSE 15.0 END::DOUBLE AS temp_c,
    CASE WHEN event_type = 'purchase' THEN CAST({_K} AS DOUBLE) / 10 ELSE 0.0 END::DOUBLE AS rain,
    CASE WHEN event_type = 'error' THEN CAST({_K} AS DOUBLE) / 100 ELSE 0.0 END::DOUBLE AS snow,
    CASE WHEN event_type <> 'purchase' THEN CAST({_K} AS DOUBLE) ELSE 40.0 END::DOUBLE AS clouds,
    CASE WHEN user_id % 7 = 0 THEN 'Haze' WHEN event_type = 'view' THEN 'Clear'
         WHEN event_type = 'click' THEN 'Clouds' WHEN event_type = 'purchase' THEN 'Rain'
         WHEN event_type = 'error' THEN 'Snow' ELSE 'Clear' END AS weather,
    CASE WHEN user_id % 3 <> 0 THEN CAST((user_id % 5) * 25 AS DOUBLE) ELSE 0.0 END::DOUBLE AS weather_severity,
    CASE WHEN user_id % 4 <> 0 THEN CAST(({_K} % 3) * 50 AS DOUBLE) ELSE 0.0 END::DOUBLE AS special_event,
    CASE WHEN event_type <> 'view' THEN CAST((user_id % 2) * 100 AS DOUBLE) ELSE 0.0 END::DOUBLE AS incident,
    CASE WHEN event_type <> 'click' THEN CAST(({_K} % 5) * 25 AS DOUBLE) ELSE 0.0 END::DOUBLE AS remote_work
  FROM events
)"""
REQ_COLS = ("request_id, hour, dow, month, temp_c, rain, snow, clouds, weather, weather_severity, "
            "special_event, incident, remote_work")


def requests(spark, sf):
    return decode_requests(requests_from_events(spark, sf))


@register("decode_requests", "WITH " + REQUESTS_SQL + f"\nSELECT {REQ_COLS} FROM req")
def q_decode_requests(spark, sf):
    """S3: request JSON → typed fields with defaults."""
    return requests(spark, sf)


FACTORS_SQL = """
CASE WHEN len(list_filter([
    CASE WHEN hour IN (7,8,9) THEN 'Morning rush hour — high commuter traffic' END,
    CASE WHEN hour IN (16,17,18) THEN 'Evening rush hour — peak congestion window' END,
    CASE WHEN hour BETWEEN 0 AND 4 THEN 'Late night — minimal traffic expected' END,
    CASE WHEN dow >= 5 THEN 'Weekend — lower commuter volume' END,
    CASE WHEN rain > 0 THEN 'Rain ' || CAST(rain AS VARCHAR) || 'mm/h — speeds reduced' END,
    CASE WHEN snow > 0 THEN 'Snow ' || CAST(snow AS VARCHAR) || 'mm/h — road capacity reduced' END],
    lambda x: x IS NOT NULL)) = 0 THEN ['Normal weekday conditions']
ELSE list_filter([
    CASE WHEN hour IN (7,8,9) THEN 'Morning rush hour — high commuter traffic' END,
    CASE WHEN hour IN (16,17,18) THEN 'Evening rush hour — peak congestion window' END,
    CASE WHEN hour BETWEEN 0 AND 4 THEN 'Late night — minimal traffic expected' END,
    CASE WHEN dow >= 5 THEN 'Weekend — lower commuter volume' END,
    CASE WHEN rain > 0 THEN 'Rain ' || CAST(rain AS VARCHAR) || 'mm/h — speeds reduced' END,
    CASE WHEN snow > 0 THEN 'Snow ' || CAST(snow AS VARCHAR) || 'mm/h — road capacity reduced' END],
    lambda x: x IS NOT NULL) END"""


@register("request_factors", "WITH " + REQUESTS_SQL + f"""
SELECT request_id, array_to_string({FACTORS_SQL}, ' | ') AS factors, CAST(len({FACTORS_SQL}) AS INTEGER) AS n_factors FROM req""")
def q_request_factors(spark, sf):
    """explanation factors per request (joined for comparison)."""
    f = L.factors("hour", "dow", "rain", "snow")
    return requests(spark, sf).select("request_id", F.array_join(f, " | ").alias("factors"),
                                      F.size(f).alias("n_factors"))


@register("scenario_features", "WITH " + ",\n".join([REQUESTS_SQL, Q.OBS_EVENTS, """
vocab AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS DOUBLE) AS code
          FROM (SELECT DISTINCT weather_main AS label FROM obs WHERE weather_main IS NOT NULL))"""]) + """
SELECT request_id, hour, dow, month, CAST(floor((month - 1) / 3) + 1 AS INTEGER) AS quarter,
       CASE WHEN dow >= 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend, temp_c, rain AS rain_1h, snow AS snow_1h,
       clouds AS clouds_all, coalesce(v.code, 0.0)::DOUBLE AS weather_enc, v.code IS NOT NULL AS weather_known,
       CASE WHEN hour IN (7,8,9,16,17,18) THEN 1.0 ELSE 0.0 END::DOUBLE AS rush_hour,
       CASE WHEN hour BETWEEN 0 AND 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS night,
       round_even(sin(2 * pi() * hour / 24), 9) AS hour_sin, round_even(cos(2 * pi() * hour / 24), 9) AS hour_cos,
       round_even(sin(2 * pi() * dow / 7), 9) AS dow_sin, round_even(cos(2 * pi() * dow / 7), 9) AS dow_cos,
       round_even(sin(2 * pi() * month / 12), 9) AS month_sin, round_even(cos(2 * pi() * month / 12), 9) AS month_cos
FROM req r LEFT JOIN vocab v ON r.weather = v.label""")
def q_scenario_features(spark, sf):
    """feature rows assembled from request fields (unseen weather → 0, flagged)."""
    vocab = Fe.fit_labels(events_obs(spark, sf))
    df = Fe.scenario_features(requests(spark, sf), vocab)
    cols = ["request_id", "hour", "dow", "month", "quarter", "is_weekend", "temp_c", "rain_1h", "snow_1h",
            "clouds_all", "weather_enc", "weather_known", "rush_hour", "night"]
    return df.select(*cols, *[_r9(F.col(c)).alias(c) for c in _ROUNDED if c != "temp_c"])


@register("stream_requests", "WITH " + REQUESTS_SQL + f"\nSELECT {REQ_COLS} FROM req")
def q_stream_requests(spark, sf):
    """S3 on a stream: requests decoded micro-batch by micro-batch from the
    ``events`` file stream (availableNow), sink read back as a table."""
    from roadflow.streaming.scoring import request_stream, run_available
    return run_available(request_stream(spark, sf), "requests").select(*REQ_COLS.split(", "))


@register("feature_matrix", Q.with_orders() + "\nSELECT obs_id, " + ", ".join(
    f"CAST(round_even({c}, 9) AS FLOAT) AS {c}" if c in _ROUNDED else f"CAST({c} AS FLOAT) AS {c}" for c in S.FS18) + ", CAST(traffic_volume AS FLOAT) AS label FROM feat WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in S.FS18))
def q_feature_matrix(spark, sf):
    """P5 + P8: rows complete in FS18 (subset null drop), cast to float32 as the
    reference's feature matrix."""
    df = Fe.drop_incomplete(orders_feat_encoded(spark, sf), subset=S.FS18)
    df = df.withColumns({c: F.bround(c, 9) for c in _ROUNDED})   # engine-independent before float32
    return Fe.cast_columns(df.withColumnRenamed("traffic_volume", "label"),
                           {c: "float" for c in S.FS18 + ["label"]}).select("obs_id", *S.FS18, "label")


@register("rename_columns", Q.with_events() + """
SELECT obs_id, date_time AS ts, weather_main AS weather, traffic_volume AS volume FROM obs""")
def q_rename_columns(spark, sf):
    """Rename columns by mapping."""
    df = Fe.rename(events_obs(spark, sf), {"date_time": "ts", "weather_main": "weather", "traffic_volume": "volume"})
    return df.select("obs_id", "ts", "weather", "volume")


def orders_feat_encoded(spark, sf):
    from roadflow.plans.common import orders_feat
    return orders_feat(spark, sf, encode=True)
