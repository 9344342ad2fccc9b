"""Shared DuckDB SQL fragments for the oracle queries.

They restate the Spark adapters and features in plain SQL.  DuckDB notes:
integer-literal division is float division, ``1.0`` is DECIMAL (so we cast to
DOUBLE), ``round_even`` is half-even and ``CAST(x AS BIGINT)`` rounds (so we
truncate first).
"""

OBS_EVENTS = """
obs AS (
  SELECT event_id AS obs_id,
         CASE WHEN user_id % 50 = 0 THEN 'Labor Day' ELSE 'None' END AS holiday,
         CAST(250.0 AS DOUBLE) + CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS DOUBLE) * CAST(0.6 AS DOUBLE) AS temp,
         CASE WHEN event_type = 'purchase' THEN CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS DOUBLE) / 10 ELSE CAST(0 AS DOUBLE) END AS rain_1h,
         CASE WHEN event_type = 'error' THEN CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS snow_1h,
         CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS clouds_all,
         CASE event_type WHEN 'view' THEN 'Clear' WHEN 'click' THEN 'Clouds' WHEN 'purchase' THEN 'Rain'
                         WHEN 'error' THEN 'Snow' WHEN 'signup' THEN 'Mist' END AS weather_main,
         lower(CASE event_type WHEN 'view' THEN 'Clear' WHEN 'click' THEN 'Clouds' WHEN 'purchase' THEN 'Rain'
                         WHEN 'error' THEN 'Snow' WHEN 'signup' THEN 'Mist' END) AS weather_description,
         CAST(ts AS TIMESTAMP) AS date_time,
         CAST(trunc(value * 30) AS BIGINT) AS traffic_volume
  FROM events
)"""

OBS_ORDERS = """
obs AS (
  SELECT o_orderkey AS obs_id,
         CASE WHEN starts_with(o_orderpriority, '1') THEN 'Holiday' ELSE 'None' END AS holiday,
         CAST(250.0 AS DOUBLE) + CAST(o_custkey % 100 AS DOUBLE) * CAST(0.6 AS DOUBLE) AS temp,
         CAST(0 AS DOUBLE) AS rain_1h,
         CAST(0 AS DOUBLE) AS snow_1h,
         CAST(o_custkey % 101 AS INTEGER) AS clouds_all,
         (['Clear','Clouds','Drizzle','Fog','Mist','Rain','Snow','Thunderstorm'])[CAST(o_orderkey % 8 AS INTEGER) + 1] AS weather_main,
         lower((['Clear','Clouds','Drizzle','Fog','Mist','Rain','Snow','Thunderstorm'])[CAST(o_orderkey % 8 AS INTEGER) + 1]) AS weather_description,
         CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS date_time,
         CAST(trunc(o_totalprice) AS BIGINT) % 7281 AS traffic_volume
  FROM orders
)"""

FEATURES = """
vocab AS (
  SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS DOUBLE) AS code
  FROM (SELECT DISTINCT weather_main AS label FROM obs WHERE weather_main IS NOT NULL)
),
feat AS (
  SELECT o.*,
         CAST(hour(date_time) AS INTEGER) AS hour,
         CAST(isodow(date_time) - 1 AS INTEGER) AS dow,
         CAST(month(date_time) AS INTEGER) AS month,
         CAST(quarter(date_time) AS INTEGER) AS quarter,
         CAST(year(date_time) AS INTEGER) AS year,
         CASE WHEN isodow(date_time) - 1 >= 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_weekend,
         CASE WHEN holiday IS NOT NULL AND holiday <> 'None' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_holiday,
         temp - CAST(273.15 AS DOUBLE) AS temp_c,
         CASE WHEN hour(date_time) IN (7,8,9,16,17,18) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS rush_hour,
         CASE WHEN hour(date_time) BETWEEN 0 AND 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS night,
         sin(2 * pi() * hour(date_time) / 24) AS hour_sin,
         cos(2 * pi() * hour(date_time) / 24) AS hour_cos,
         sin(2 * pi() * (isodow(date_time) - 1) / 7) AS dow_sin,
         cos(2 * pi() * (isodow(date_time) - 1) / 7) AS dow_cos,
         sin(2 * pi() * month(date_time) / 12) AS month_sin,
         cos(2 * pi() * month(date_time) / 12) AS month_cos,
         coalesce(v.code, CAST(0 AS DOUBLE)) AS weather_enc
  FROM obs o LEFT JOIN vocab v ON o.weather_main = v.label
)"""


def level(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR isnan(CAST({v} AS DOUBLE)) THEN NULL WHEN {v} < 1000 THEN 'LOW' "
            f"WHEN {v} < 3000 THEN 'MEDIUM' WHEN {v} < 5000 THEN 'HIGH' ELSE 'SEVERE' END")


def color(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR isnan(CAST({v} AS DOUBLE)) THEN NULL WHEN {v} < 1000 THEN '#22c55e' "
            f"WHEN {v} < 3000 THEN '#eab308' WHEN {v} < 5000 THEN '#f97316' ELSE '#ef4444' END")


def emoji(v: str, short: bool = False) -> str:
    m, s = ("MED", "SEV") if short else ("MEDIUM", "SEVERE")
    return (f"CASE WHEN {v} IS NULL OR isnan(CAST({v} AS DOUBLE)) THEN NULL WHEN {v} < 1000 THEN '🟢 LOW' "
            f"WHEN {v} < 3000 THEN '🟡 {m}' WHEN {v} < 5000 THEN '🟠 HIGH' ELSE '🔴 {s}' END")


def risk(v: str) -> str:
    d = f"CAST({v} AS DOUBLE)"
    return (f"CAST(CASE WHEN {v} IS NULL OR isnan({d}) THEN NULL "
            f"WHEN {d} < 1000 THEN round_even({d} / 1000 * 25, 0) "
            f"WHEN {d} < 3000 THEN round_even(25 + ({d} - 1000) / 2000 * 25, 0) "
            f"WHEN {d} < 5000 THEN round_even(50 + ({d} - 3000) / 2000 * 25, 0) "
            f"ELSE least(CAST(100 AS DOUBLE), round_even(75 + ({d} - 5000) / 2000 * 25, 0)) END AS INTEGER)")


def mean_int(col: str = "traffic_volume") -> str:
    return f"CAST(round_even(avg({col}), 0) AS BIGINT)"


def pct_1dp(c: str, n: str) -> str:
    q = f"((CAST({c} AS BIGINT) * 1000) // CAST({n} AS BIGINT))"
    r = f"((CAST({c} AS BIGINT) * 1000) - {q} * CAST({n} AS BIGINT))"
    return (f"(({q} + CASE WHEN 2 * {r} > {n} OR (2 * {r} = {n} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
            f" / CAST(10 AS DOUBLE))")


def with_events(*ctes: str) -> str:
    return "WITH " + ",\n".join((OBS_EVENTS, FEATURES) + ctes)


def with_orders(*ctes: str) -> str:
    return "WITH " + ",\n".join((OBS_ORDERS, FEATURES) + ctes)
