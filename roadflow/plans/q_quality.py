"""Data-quality queries (A14-A19) and their oracles."""

from __future__ import annotations

from roadflow import schema as S
from roadflow.operators import quality as Qy
from roadflow.plans import sql as Q
from roadflow.plans.catalog import register
from roadflow.plans.common import events_feat, events_obs, orders_feat

_OBS_TYPES = [("obs_id", "bigint"), ("holiday", "string"), ("temp", "double"), ("rain_1h", "double"),
              ("snow_1h", "double"), ("clouds_all", "int"), ("weather_main", "string"),
              ("weather_description", "string"), ("date_time", "timestamp_ntz"),
              ("traffic_volume", "bigint")]

_PROFILE_SQL = Q.with_events("t AS (SELECT count(*) AS n FROM obs)") + "\n" + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS dtype, m AS missing, {Q.pct_1dp('m', 'n')} AS missing_pct,
       d AS n_distinct FROM (SELECT count(*) FILTER (WHERE {c} IS NULL) AS m, count(DISTINCT {c}) AS d FROM obs), t"""
    for c, t in _OBS_TYPES)


@register("profile_columns", _PROFILE_SQL)
def q_profile_columns(spark, sf):
    return Qy.profile_columns(events_obs(spark, sf))


_SKETCHED = ["holiday", "temp", "clouds_all", "weather_main", "traffic_volume"]
_DAYS = ("2024-01-05", "2024-01-20")


@register("sketch_profile", Q.with_events(
    f"d AS (SELECT * FROM obs WHERE CAST(date_time AS DATE) BETWEEN DATE '{_DAYS[0]}' AND DATE '{_DAYS[1]}')") +
    "\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS missing,
       TRUE AS distinct_in_bound, {'TRUE' if t in ('double', 'int', 'bigint') else 'CAST(NULL AS BOOLEAN)'} AS median_in_bound
FROM d""" for c, t in _OBS_TYPES if c in _SKETCHED))
def q_sketch_profile(spark, sf):
    """A14 / A15 from written daily sketches, merged over a range of days and held against the rows:
    distinct counts within three standard errors, the median's rank within two percent."""
    import uuid

    from pyspark.sql import functions as F

    from roadflow.operators import sketches as Sk
    from roadflow.session import ensure_checkpoint_dir
    obs = events_obs(spark, sf)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sketches/{uuid.uuid4().hex}"
    Sk.daily_sketches(obs, _SKETCHED).write.parquet(path)
    got = {r["column_name"]: r for r in Sk.merged_profile(spark.read.parquet(path), _SKETCHED, *_DAYS).collect()}
    days = obs.where(F.to_date("date_time").between(*_DAYS))
    exact = None
    for c in _SKETCHED:  # one row a column
        est = got[c]
        held = F.greatest(F.count(c), F.lit(1))
        rank = F.lit(None).cast("boolean")
        if est["median"] is not None:
            rank = ((F.count_if(F.col(c) < est["median"]) / held <= 0.52)
                    & (F.count_if(F.col(c) <= est["median"]) / held >= 0.48))
        bound = 3 * 1.04 / 2 ** (Sk.LG_K / 2)
        one = days.agg(F.lit(c).alias("column_name"),
                       (F.abs(F.countDistinct(c) - est["n_distinct"]) <= bound * F.countDistinct(c) + 0.5)
                       .alias("distinct_in_bound"), rank.alias("median_in_bound")).select(
            "column_name", F.lit(est["n"]).alias("n"), F.lit(est["missing"]).alias("missing"),
            "distinct_in_bound", "median_in_bound")
        exact = one if exact is None else exact.unionByName(one)
    return exact


@register("summary", Q.with_events() + """
SELECT count(traffic_volume) AS count, round_even(CAST(min(traffic_volume) AS DOUBLE), 6) AS min,
       round_even(quantile_cont(CAST(traffic_volume AS DOUBLE), 0.25), 6) AS q1,
       round_even(quantile_cont(CAST(traffic_volume AS DOUBLE), 0.5), 6) AS median,
       round_even(avg(CAST(traffic_volume AS DOUBLE)), 6) AS mean,
       round_even(quantile_cont(CAST(traffic_volume AS DOUBLE), 0.75), 6) AS q3,
       round_even(CAST(max(traffic_volume) AS DOUBLE), 6) AS max,
       round_even(stddev_samp(CAST(traffic_volume AS DOUBLE)), 6) AS std FROM feat""")
def q_summary(spark, sf):
    return Qy.summary(events_feat(spark, sf))


@register("iqr_outliers", Q.with_events("""
q AS (SELECT quantile_cont(CAST(traffic_volume AS DOUBLE), 0.25) AS q1,
             quantile_cont(CAST(traffic_volume AS DOUBLE), 0.75) AS q3 FROM feat)""") + """
SELECT round_even(q1, 6) AS q1, round_even(q3, 6) AS q3, round_even(q3 - q1, 6) AS iqr,
       round_even(q1 - 1.5 * (q3 - q1), 6) AS lower, round_even(q3 + 1.5 * (q3 - q1), 6) AS upper,
       count(*) FILTER (WHERE traffic_volume < q1 - 1.5 * (q3 - q1) OR traffic_volume > q3 + 1.5 * (q3 - q1)) AS n_outliers,
       count(traffic_volume) AS n
FROM feat, q GROUP BY q1, q3""")
def q_iqr_outliers(spark, sf):
    return Qy.iqr_outliers(events_feat(spark, sf))


_CORR_COLS = S.FS18
_DISPLAY_CASE = "CASE feature " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in S.DISPLAY_NAMES.items()) + " ELSE feature END"
_CORR_SQL = Q.with_orders(
    "c AS (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(traffic_volume AS DOUBLE)) AS r FROM feat"
        for c in _CORR_COLS) + "),\n"
    "c2 AS (SELECT feature, round_even(CASE WHEN isnan(r) THEN NULL ELSE r END, 6) AS corr FROM c)") + f"""
SELECT feature, {_DISPLAY_CASE} AS display_name, corr, abs(corr) AS abs_corr,
       CASE WHEN corr IS NULL THEN NULL WHEN corr <= -0.3 THEN 'Negative' WHEN abs(corr) >= 0.3 THEN 'Strong'
            WHEN abs(corr) >= 0.15 THEN 'Moderate' ELSE 'Weak' END AS strength,
       CAST(row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM c2"""


@register("correlations", _CORR_SQL)
def q_correlations(spark, sf):
    return Qy.correlations(orders_feat(spark, sf, encode=True), _CORR_COLS)


@register("volume_histogram", Q.with_events() + """
SELECT CAST(least(floor(traffic_volume / 500), 11) AS INTEGER) AS bin,
       CAST(least(floor(traffic_volume / 500), 11) AS INTEGER) * 500 AS bin_from,
       CASE WHEN least(floor(traffic_volume / 500), 11) = 11 THEN NULL
            ELSE (CAST(least(floor(traffic_volume / 500), 11) AS INTEGER) + 1) * 500 END AS bin_to,
       count(*) AS count
FROM feat WHERE traffic_volume IS NOT NULL GROUP BY 1, 2, 3""")
def q_volume_histogram(spark, sf):
    return Qy.volume_histogram(events_feat(spark, sf))


@register("weather_share", Q.with_orders("""
c AS (SELECT weather_main AS weather, count(*) AS cnt FROM feat WHERE weather_main IS NOT NULL GROUP BY 1),
t AS (SELECT sum(cnt) AS total FROM c)""") + f"""
SELECT weather, cnt AS count, {Q.pct_1dp('cnt', 'total')} AS pct FROM c, t""")
def q_weather_share(spark, sf):
    return Qy.weather_share(orders_feat(spark, sf))
