"""Ordering, split, sampling, sequence and scaling queries (W1-W4, T1, P9-P10,
D1s-D4s, A23, F17, F18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.functions import calendar as C
from roadflow.operators import ordering as O
from roadflow.operators import scaling as Sc
from roadflow.operators import sequences as Sq
from roadflow.plans import sql as Q
from roadflow.plans.catalog import register
from roadflow.plans.common import events_feat, orders_feat

IDX = "row_number() OVER (ORDER BY date_time, obs_id) - 1"
_ROUND9 = {"temp_c", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"}


@register("row_index", Q.with_events() + f"\nSELECT obs_id, date_time, {IDX} AS row_idx FROM feat")
def q_row_index(spark, sf):
    """Global 0-based index by (date_time, obs_id)."""
    return O.time_index(events_feat(spark, sf)).select("obs_id", "date_time", "row_idx")


@register("order_by_time", Q.with_orders() + """
SELECT obs_id, date_time, traffic_volume FROM feat ORDER BY date_time, obs_id""")
def q_order_by_time(spark, sf):
    """Total order by time (range-partitioned sort)."""
    return O.order_by_time(orders_feat(spark, sf)).select("obs_id", "date_time", "traffic_volume")


_SPLIT80 = f"""
ix AS (SELECT *, {IDX} AS row_idx, count(*) OVER () AS n FROM feat),
sp AS (SELECT *, CASE WHEN row_idx < CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ix)"""


@register("chrono_split", Q.with_orders(_SPLIT80) + "\nSELECT obs_id, row_idx, split FROM sp")
def q_chrono_split(spark, sf):
    """D1s: chronological 80/20 split."""
    return O.chrono_split(orders_feat(spark, sf)).select("obs_id", "row_idx", "split")


_REPORT = """
SELECT split, count(*) AS rows, min(date_time) AS first_ts, max(date_time) AS last_ts,
       min(traffic_volume) AS min_volume, max(traffic_volume) AS max_volume FROM sp GROUP BY split"""


@register("split_report", Q.with_orders(_SPLIT80) + _REPORT)
def q_split_report(spark, sf):
    """A23 over D1s."""
    return O.split_report(O.chrono_split(orders_feat(spark, sf), with_index=False))


_SPLIT3 = f"""
ix AS (SELECT *, {IDX} AS row_idx, count(*) OVER () AS n FROM feat),
sp AS (SELECT *, CASE WHEN row_idx < CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'train'
                      WHEN row_idx < CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT) THEN 'val'
                      ELSE 'test' END AS split FROM ix)"""


@register("split_report_3way", Q.with_orders(_SPLIT3) + _REPORT)
def q_split_report_3way(spark, sf):
    """D2s: chronological 70/15/15 split, reported per split."""
    sp = O.chrono_split(orders_feat(spark, sf), cuts=(0.7, 0.85), labels=("train", "val", "test"), with_index=False)
    return O.split_report(sp)


@register("random_split", Q.with_orders("""
h AS (SELECT obs_id, row_number() OVER (ORDER BY md5('42' || CAST(obs_id AS VARCHAR)), obs_id) - 1 AS pos,
             count(*) OVER () AS n FROM feat)""") + """
SELECT obs_id, CASE WHEN pos < ceil(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM h""")
def q_random_split(spark, sf):
    """D3s: seeded random 80/20 split with exact sizes."""
    return O.random_split(orders_feat(spark, sf), 0.2, 42).select("obs_id", "split")


@register("systematic_sample", Q.with_orders(_SPLIT80, """
te AS (SELECT *, row_idx - min(row_idx) OVER () AS t_idx, count(*) OVER () AS n_test FROM sp WHERE split = 'test')""") + """
SELECT obs_id, t_idx, strftime(date_time, '%Y-%m-%d %H:%M') AS minute, traffic_volume FROM te
WHERE t_idx % greatest(n_test // 20, 1) = 0 AND t_idx < greatest(n_test // 20, 1) * 20""")
def q_systematic_sample(spark, sf):
    """20 evenly spaced rows of the test split."""
    sp = O.chrono_split(orders_feat(spark, sf))
    te = sp.where(F.col("split") == "test")
    first = te.agg(F.min("row_idx")).scalar()
    te = te.withColumn("t_idx", F.col("row_idx") - first)
    out = O.systematic_sample(te, 20, idx="t_idx")
    return out.select("obs_id", "t_idx", C.minute_label("date_time").alias("minute"), "traffic_volume")


@register("head_rows", Q.with_orders(f"ix AS (SELECT obs_id, {IDX} AS row_idx FROM feat)") + """
SELECT obs_id, row_idx FROM ix WHERE row_idx < 8000""")
def q_head_rows(spark, sf):
    """P10: the first 8,000 rows in time order."""
    return O.head_rows(O.time_index(orders_feat(spark, sf)), 8000).select("obs_id", "row_idx")


_SEQ_COLS = S.FS18


def _seq_sql(source_cte: str, within: bool) -> str:
    sel = ", ".join(f"round_even(b.{c}, 9) AS {c}" if c in _ROUND9 else f"CAST(b.{c} AS DOUBLE) AS {c}"
                    for c in _SEQ_COLS)
    return source_cte + f"""
SELECT a.row_idx, CAST(a.traffic_volume AS DOUBLE) AS label, a.date_time AS label_ts,
       CAST(b.row_idx - (a.row_idx - 24) AS INTEGER) AS step, {sel}
FROM ix a JOIN ix b ON b.row_idx BETWEEN a.row_idx - 24 AND a.row_idx - 1 {"AND a.split = b.split" if within else ""}
WHERE a.pos >= 24"""


@register("sequence_steps", _seq_sql(Q.with_events(
    f"ix AS (SELECT *, {IDX} AS row_idx, {IDX} AS pos FROM feat)"), within=False))
def q_sequence_steps(spark, sf):
    """24-step sequences of FS18 features with the next row's target,
    in long form (one row per sequence step)."""
    ix = O.time_index(events_feat(spark, sf, encode=True))
    seqs = Sq.make_sequences(ix, _SEQ_COLS, s=24, chunk=512)
    long = Sq.sequence_steps(seqs, _SEQ_COLS)
    return long.select("row_idx", "label", "label_ts", F.col("step").cast("int").alias("step"),
                       *[F.bround(c, 9).alias(c) if c in _ROUND9 else F.col(c) for c in _SEQ_COLS])


@register("sequence_counts", Q.with_orders(_SPLIT3, """
px AS (SELECT *, row_idx - min(row_idx) OVER (PARTITION BY split) AS pos FROM sp)""") + """
SELECT split, count(*) AS n_sequences, min(row_idx) AS first_label_idx, max(row_idx) AS last_label_idx,
       CAST(sum(traffic_volume) AS BIGINT) AS label_sum FROM px WHERE pos >= 24 GROUP BY split""")
def q_sequence_counts(spark, sf):
    """Sequences kept inside each 70/15/15 split (none crosses a boundary)."""
    sp = O.chrono_split(orders_feat(spark, sf, encode=True), cuts=(0.7, 0.85),
                        labels=("train", "val", "test"))
    seqs = Sq.make_sequences(sp, _SEQ_COLS, s=24, within="split", chunk=1024)
    return seqs.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_sequences"), F.min("row_idx").alias("first_label_idx"),
        F.max("row_idx").alias("last_label_idx"), F.sum(F.col("label").cast("bigint")).alias("label_sum"))


@register("sequence_split", Q.with_orders(f"""
ix AS (SELECT obs_id, {IDX} AS row_idx, count(*) OVER () AS n FROM feat)""") + """
SELECT row_idx, CASE WHEN row_idx - 24 < CAST(floor((n - 24) * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'train'
                     ELSE 'test' END AS seq_split FROM ix WHERE row_idx >= 24""")
def q_sequence_split(spark, sf):
    """D4s: chronological 80/20 split over the N-24 sequences."""
    ix = O.time_index(orders_feat(spark, sf, encode=True))
    seqs = Sq.make_sequences(ix, _SEQ_COLS, s=24, chunk=1024)
    return Sq.split_sequences(seqs, 0.8, 24).select("row_idx", "seq_split")


def _scaler_sql():
    stats = ", ".join(
        f"avg(CAST({c} AS DOUBLE)) AS m_{c}, CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 "
        f"OR stddev_pop(CAST({c} AS DOUBLE)) IS NULL THEN 1.0 ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS s_{c}"
        for c in S.FS18)
    cols = ", ".join(f"round_even((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, 6) AS {c}" for c in S.FS18)
    return Q.with_orders(_SPLIT80, f"st AS (SELECT {stats} FROM sp WHERE split = 'train')") + \
        f"\nSELECT obs_id, split, {cols} FROM sp, st"


@register("standardize", _scaler_sql())
def q_standardize(spark, sf):
    """z-score FS18 with population std fitted on the train split only."""
    sp = O.chrono_split(orders_feat(spark, sf, encode=True), with_index=False)
    stats = Sc.fit_scaler(sp.where(F.col("split") == "train"), S.FS18)
    out = Sc.apply_scaler(sp, stats, S.FS18)
    return out.select("obs_id", "split", *[F.bround(c, 6).alias(c) for c in S.FS18])


@register("target_scaling", Q.with_orders(_SPLIT80, """
st AS (SELECT min(traffic_volume) AS mn, max(traffic_volume) AS mx, avg(CAST(traffic_volume AS DOUBLE)) AS mu,
              stddev_pop(CAST(traffic_volume AS DOUBLE)) AS sd FROM sp WHERE split = 'train')""") + """
SELECT obs_id, split,
       round_even((traffic_volume - mn) / (mx - mn + 1e-8), 9) AS y_minmax_eps,
       round_even((traffic_volume - mn) / CAST(mx - mn AS DOUBLE), 9) AS y_minmax,
       round_even((traffic_volume - mu) / sd, 9) AS y_zscore,
       round_even(((traffic_volume - mn) / (mx - mn + 1e-8)) * (mx - mn + 1e-8) + mn, 6) AS y_back
FROM sp, st""")
def q_target_scaling(spark, sf):
    """the three target scalings fitted on train in one pass, and the inverse."""
    sp = O.chrono_split(orders_feat(spark, sf), with_index=False)
    kinds = {"minmax_eps": "y_minmax_eps", "minmax": "y_minmax", "zscore": "y_zscore"}
    stats = Sc.fit_target_scales(sp.where(F.col("split") == "train"), kinds)
    out = sp
    for kind, name in kinds.items():
        out = Sc.scale_target(out, stats[kind], out=name)
    out = Sc.unscale_target(out, stats["minmax_eps"], col="y_minmax_eps", out="y_back")
    return out.select("obs_id", "split", F.bround("y_minmax_eps", 9).alias("y_minmax_eps"),
                      F.bround("y_minmax", 9).alias("y_minmax"), F.bround("y_zscore", 9).alias("y_zscore"),
                      F.bround("y_back", 6).alias("y_back"))
