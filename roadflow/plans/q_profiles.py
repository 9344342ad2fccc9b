"""Profile queries (A1-A13, A20-A22, A24, T2) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow.operators import profiles as P
from roadflow.plans import sql as Q
from roadflow.plans.catalog import register
from roadflow.plans.common import events_feat, orders_feat


@register("heatmap", Q.with_events(f"""
h AS (SELECT dow, hour, {Q.mean_int()} AS volume FROM feat
      WHERE dow IS NOT NULL AND hour IS NOT NULL GROUP BY dow, hour)""") + f"""
SELECT dow, hour, volume, {Q.level('volume')} AS level, {Q.color('volume')} AS color,
       {Q.risk('volume')} AS risk FROM h""")
def q_heatmap(spark, sf):
    return P.heatmap(events_feat(spark, sf))


@register("totals", Q.with_events() + """
SELECT CAST(trunc(avg(traffic_volume)) AS BIGINT) AS avg_volume, count(*) AS total_records FROM feat""")
def q_totals(spark, sf):
    return P.totals(events_feat(spark, sf))


@register("hourly_profile", Q.with_events() + f"""
SELECT hour, {Q.mean_int()} AS avg_volume FROM feat WHERE hour IS NOT NULL GROUP BY hour""")
def q_hourly_profile(spark, sf):
    return P.hourly_profile(events_feat(spark, sf))


@register("peak_hour", Q.with_events("""
hm AS (SELECT hour, avg(traffic_volume) AS m FROM feat WHERE hour IS NOT NULL GROUP BY hour)""") + """
SELECT hour AS peak_hour, CAST(trunc(m) AS BIGINT) AS peak_volume FROM hm ORDER BY m DESC, hour ASC LIMIT 1""")
def q_peak_hour(spark, sf):
    return P.peak_hour(events_feat(spark, sf))


@register("congestion_distribution", Q.with_events(f"""
c AS (SELECT {Q.level('traffic_volume')} AS level, count(*) AS cnt FROM feat GROUP BY 1),
t AS (SELECT count(*) AS total FROM feat)""") + f"""
SELECT level, cnt AS count, {Q.pct_1dp('cnt', 'total')} AS pct FROM c, t""")
def q_congestion_distribution(spark, sf):
    return P.congestion_distribution(events_feat(spark, sf))


@register("heatmap_grid", Q.with_events() + "\nSELECT dow, " + ", ".join(
    f'CAST(round_even(avg(CASE WHEN hour = {h} THEN traffic_volume END), 0) AS BIGINT) AS "{h}"'
    for h in range(24)) + "\nFROM feat WHERE dow IS NOT NULL GROUP BY dow")
def q_heatmap_grid(spark, sf):
    return P.heatmap_grid(events_feat(spark, sf))


@register("week_profiles", Q.with_events() + f"""
SELECT is_weekend, hour, {Q.mean_int()} AS avg_volume FROM feat WHERE hour IS NOT NULL GROUP BY is_weekend, hour""")
def q_week_profiles(spark, sf):
    return P.week_profiles(events_feat(spark, sf))


@register("monthly_profile", Q.with_orders() + f"""
SELECT month, {Q.mean_int()} AS avg_volume FROM feat WHERE month IS NOT NULL GROUP BY month""")
def q_monthly_profile(spark, sf):
    return P.monthly_profile(orders_feat(spark, sf))


@register("daily_profile", Q.with_events() + f"""
SELECT dow, {Q.mean_int()} AS avg_volume FROM feat WHERE dow IS NOT NULL GROUP BY dow""")
def q_daily_profile(spark, sf):
    return P.daily_profile(events_feat(spark, sf))


@register("patterns", Q.with_orders() + f"""
SELECT 'weekday' AS profile, hour AS key, {Q.mean_int()} AS avg_volume FROM feat WHERE is_weekend = 0 AND hour IS NOT NULL GROUP BY hour
UNION ALL SELECT 'weekend', hour, {Q.mean_int()} FROM feat WHERE is_weekend = 1 AND hour IS NOT NULL GROUP BY hour
UNION ALL SELECT 'monthly', month, {Q.mean_int()} FROM feat WHERE month IS NOT NULL GROUP BY month
UNION ALL SELECT 'daily', dow, {Q.mean_int()} FROM feat WHERE dow IS NOT NULL GROUP BY dow""")
def q_patterns(spark, sf):
    return P.patterns(orders_feat(spark, sf))


@register("by_weather", Q.with_events() + f"""
SELECT weather_main AS weather, {Q.mean_int()} AS avg_volume, count(*) AS count
FROM feat WHERE weather_main IS NOT NULL GROUP BY weather_main""")
def q_by_weather(spark, sf):
    return P.by_weather(events_feat(spark, sf))


TEMP_BIN_SQL = ("CASE WHEN temp_c > -40 AND temp_c <= -10 THEN '-40to-10' "
                "WHEN temp_c > -10 AND temp_c <= 0 THEN '-10to0' "
                "WHEN temp_c > 0 AND temp_c <= 10 THEN '0to10' "
                "WHEN temp_c > 10 AND temp_c <= 20 THEN '10to20' "
                "WHEN temp_c > 20 AND temp_c <= 30 THEN '20to30' "
                "WHEN temp_c > 30 AND temp_c <= 50 THEN '30+' END")


@register("by_temp_bin", Q.with_events(f"""
b AS (SELECT {TEMP_BIN_SQL} AS temp_bin, traffic_volume FROM feat)""") + f"""
SELECT temp_bin, {Q.mean_int()} AS avg_volume FROM b WHERE temp_bin IS NOT NULL GROUP BY temp_bin""")
def q_by_temp_bin(spark, sf):
    return P.by_temp_bin(events_feat(spark, sf))


@register("congestion_risk", Q.with_events("""
hm AS (SELECT hour, avg(traffic_volume) AS m FROM feat WHERE hour IS NOT NULL GROUP BY hour)""") + f"""
SELECT hour, {Q.risk('m')} AS risk FROM hm""")
def q_congestion_risk(spark, sf):
    return P.congestion_risk(events_feat(spark, sf))


@register("rush_impact", Q.with_events() + """
SELECT rush_hour, round_even(avg(traffic_volume), 4) AS avg_volume, count(*) AS count FROM feat GROUP BY rush_hour""")
def q_rush_impact(spark, sf):
    return P.rush_impact(events_feat(spark, sf))


@register("temp_curve", Q.with_events() + """
SELECT CAST(floor(temp_c / 5) * 5 AS INTEGER) AS temp_from, round_even(avg(traffic_volume), 4) AS avg_volume,
       count(*) AS count FROM feat WHERE temp_c IS NOT NULL GROUP BY 1""")
def q_temp_curve(spark, sf):
    return P.temp_curve(events_feat(spark, sf))


@register("ratios", Q.with_events("""
w AS (SELECT avg(CASE WHEN is_weekend = 0 THEN traffic_volume END) AS wd,
             avg(CASE WHEN is_weekend = 1 THEN traffic_volume END) AS we FROM feat),
hm AS (SELECT hour, avg(traffic_volume) AS m FROM feat WHERE hour IS NOT NULL GROUP BY hour),
h AS (SELECT max(m) AS hmax, min(m) AS hmin FROM hm)""") + """
SELECT round_even(CASE WHEN we = 0 THEN NULL ELSE wd / we END, 6) AS weekday_weekend_ratio,
       round_even(CASE WHEN hmin = 0 THEN NULL ELSE hmax / hmin END, 6) AS peak_valley_ratio FROM w, h""")
def q_ratios(spark, sf):
    return P.ratios(events_feat(spark, sf))


@register("window_means", Q.with_events("""
b AS (SELECT CASE WHEN hour BETWEEN 6 AND 9 THEN 'morning_rush' WHEN hour BETWEEN 15 AND 18 THEN 'evening_rush'
                  WHEN hour BETWEEN 0 AND 4 THEN 'night_valley' END AS window_name, traffic_volume FROM feat)""") + """
SELECT window_name, round_even(avg(traffic_volume), 4) AS avg_volume, count(*) AS count
FROM b WHERE window_name IS NOT NULL GROUP BY window_name""")
def q_window_means(spark, sf):
    return P.window_means(events_feat(spark, sf))


@register("peak_windows", Q.with_events("""
hm AS (SELECT hour, avg(traffic_volume) AS m FROM feat WHERE hour IS NOT NULL GROUP BY hour),
top AS (SELECT * FROM hm ORDER BY m DESC, hour ASC LIMIT 6)""") + f"""
SELECT hour, CAST(trunc(m) AS BIGINT) AS volume, {Q.level('m')} AS level, {Q.color('m')} AS color,
       {Q.risk('m')} AS risk FROM top""")
def q_peak_windows(spark, sf):
    return P.peak_windows(events_feat(spark, sf))


@register("overview", Q.with_events(f"""
hm AS (SELECT hour, avg(traffic_volume) AS m FROM feat WHERE hour IS NOT NULL GROUP BY hour),
hl AS (SELECT string_agg(CAST(CAST(round_even(m, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY hour) AS hourly_avg,
              (SELECT hour FROM hm ORDER BY m DESC, hour LIMIT 1) AS peak_hour,
              CAST(trunc(max(m)) AS BIGINT) AS peak_volume FROM hm),
c AS (SELECT {Q.level('traffic_volume')} AS level, count(*) AS cnt FROM feat GROUP BY 1),
t AS (SELECT count(*) AS total, CAST(trunc(avg(traffic_volume)) AS BIGINT) AS avg_volume FROM feat),
d AS (SELECT string_agg(level || ':' || CAST({Q.pct_1dp('cnt', 'total')} AS VARCHAR), ',' ORDER BY level)
             AS congestion_dist FROM c, t)""") + """
SELECT hourly_avg, peak_hour, peak_volume, avg_volume, total AS total_records, congestion_dist FROM hl, t, d""")
def q_overview(spark, sf):
    o = P.overview(events_feat(spark, sf))
    return o.select(
        F.array_join(F.col("hourly_avg").cast("array<string>"), ",").alias("hourly_avg"),
        "peak_hour", "peak_volume", "avg_volume", "total_records",
        F.array_join(F.transform(F.map_entries("congestion_dist"),
                                 lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))),
                     ",").alias("congestion_dist"))


@register("hour_circle", Q.with_events("""
hm AS (SELECT hour, avg(traffic_volume) AS m FROM feat WHERE hour IS NOT NULL GROUP BY hour)""") + """
SELECT hour, round_even(sin(2 * pi() * hour / 24), 9) AS x, round_even(cos(2 * pi() * hour / 24), 9) AS y,
       CAST(round_even(m, 0) AS BIGINT) AS avg_volume FROM hm""")
def q_hour_circle(spark, sf):
    """hourly means on the 24-hour circle (cyclic encoding table)."""
    return P.hour_circle(events_feat(spark, sf))
