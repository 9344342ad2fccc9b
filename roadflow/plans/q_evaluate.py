"""Evaluation queries on the baseline predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.operators import evaluate as Ev
from roadflow.operators import ordering as O
from roadflow.operators.broadcast import bounded_broadcast
from roadflow.operators.baseline import BASELINES, baseline_predictions, mean_predictions
from roadflow.plans import sql as Q
from roadflow.plans.catalog import register
from roadflow.plans.common import events_feat

IDX = "row_number() OVER (ORDER BY date_time, obs_id) - 1"

PREDS_CTES = f"""
ix AS (SELECT *, {IDX} AS row_idx, count(*) OVER () AS n FROM feat),
sp AS (SELECT *, CASE WHEN row_idx < CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ix),
tr AS (SELECT * FROM sp WHERE split = 'train'),
g AS (SELECT avg(CAST(traffic_volume AS DOUBLE)) AS m FROM tr),
hm AS (SELECT hour, avg(CAST(traffic_volume AS DOUBLE)) AS m FROM tr GROUP BY hour),
wm AS (SELECT weather_main, avg(CAST(traffic_volume AS DOUBLE)) AS m FROM tr GROUP BY weather_main),
dm AS (SELECT dow, hour, avg(CAST(traffic_volume AS DOUBLE)) AS m FROM tr GROUP BY dow, hour),
raw AS (
  SELECT 'Global Mean' AS model, split, row_idx, date_time AS ts, CAST(traffic_volume AS DOUBLE) AS actual, g.m AS predicted FROM sp, g
  UNION ALL SELECT 'Hourly Mean', split, row_idx, date_time, CAST(traffic_volume AS DOUBLE), coalesce(hm.m, g.m)
            FROM sp LEFT JOIN hm ON sp.hour = hm.hour, g
  UNION ALL SELECT 'Weather Mean', split, row_idx, date_time, CAST(traffic_volume AS DOUBLE), coalesce(wm.m, g.m)
            FROM sp LEFT JOIN wm ON sp.weather_main = wm.weather_main, g
  UNION ALL SELECT 'Day-Hour Mean', split, row_idx, date_time, CAST(traffic_volume AS DOUBLE), coalesce(dm.m, g.m)
            FROM sp LEFT JOIN dm ON sp.dow = dm.dow AND sp.hour = dm.hour, g),
preds AS (SELECT model, split, row_idx, ts, actual, 
  CASE WHEN predicted IS NOT NULL THEN least(greatest(predicted, 0.0), 10000.0) END AS predicted FROM raw),
tp AS (SELECT * FROM preds WHERE split = 'test'),
te AS (SELECT *, row_idx - min(row_idx) OVER (PARTITION BY model) AS t_idx,
              count(*) OVER (PARTITION BY model) AS n_test FROM tp)"""


def _with_preds(*ctes):
    return Q.with_events(PREDS_CTES, *ctes)


def _raw_sql(src: str, by: str) -> str:
    scored = "CASE WHEN predicted IS NOT NULL THEN actual END"
    return f"""
SELECT {by}, count(*) AS n, count(*) FILTER (WHERE predicted IS NULL) AS unscored,
       avg(abs(actual - predicted)) AS MAE,
       sqrt(avg((actual - predicted) * (actual - predicted))) AS RMSE,
       CASE WHEN var_pop({scored}) * count({scored}) = 0
            THEN CASE WHEN sum((actual - predicted) * (actual - predicted)) = 0 THEN 1.0 ELSE 0.0 END
            ELSE 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop({scored}) * count({scored})) END AS R2,
       avg(abs((actual - predicted) / (actual + 1e-6))) * 100 AS MAPE,
       avg(CASE WHEN {Q.level('actual')} = {Q.level('predicted')} THEN 1.0
                WHEN {Q.level('actual')} <> {Q.level('predicted')} THEN 0.0 END) * 100 AS ClassAcc
FROM {src} GROUP BY {by}"""


def _metrics_sql(src: str, by: str) -> str:
    return f"""
SELECT {by}, n, unscored, round_even(MAE, 4) AS MAE, round_even(RMSE, 4) AS RMSE, round_even(R2, 6) AS R2,
       round_even(MAPE, 4) AS MAPE, round_even(ClassAcc, 4) AS ClassAcc FROM ({_raw_sql(src, by)})"""


def _split(spark, sf, index=False):
    return O.chrono_split(events_feat(spark, sf), with_index=index)


def _preds(spark, sf, index=False):
    return baseline_predictions(_split(spark, sf, index))


def _test(spark, sf, index=False):
    """Test rows with their predictions; the row index costs a sort, so only where it is used."""
    return _preds(spark, sf, index).where(F.col("split") == "test")


@register("baseline_predictions", _with_preds() + """
SELECT model, split, row_idx, ts, actual, round_even(predicted, 6) AS predicted FROM raw""")
def q_baseline_predictions(spark, sf):
    """Train-mean predictors (global, hour, weather, day x hour) for every row."""
    p = _preds(spark, sf, index=True)
    return p.withColumn("predicted", F.bround("predicted", 6))


@register("evaluate", _with_preds() + _metrics_sql("tp", "model"))
def q_evaluate(spark, sf):
    """MAE, RMSE, R², MAPE, class accuracy per model on the test split."""
    return Ev.evaluate(_test(spark, sf))


@register("union_metrics", _with_preds() + _metrics_sql("tp", "model"))
def q_union_metrics(spark, sf):
    """Models evaluated one by one, metric rows appended."""
    sp = _split(spark, sf)
    frames = [Ev.evaluate(mean_predictions(sp, name, keys, bound).where(F.col("split") == "test"))
              for name, (keys, bound) in BASELINES.items()]
    return Ev.union_metrics(frames)


_LEVELS = "('LOW','MEDIUM','HIGH','SEVERE')"


@register("confusion", _with_preds(f"""
lc AS (SELECT model, {Q.level('actual')} AS actual_level, {Q.level('predicted')} AS predicted_level, count(*) AS cnt
       FROM tp GROUP BY ALL)""") + """
SELECT model, actual_level, """ + ", ".join(
    f"CAST(coalesce(sum(cnt) FILTER (WHERE predicted_level = '{lv}'), 0) AS BIGINT) AS {lv}" for lv in S.LEVEL_NAMES)
    + " FROM lc GROUP BY model, actual_level")
def q_confusion(spark, sf):
    """Confusion matrix of congestion levels per model."""
    return Ev.confusion(_test(spark, sf))


@register("class_report", _with_preds(f"""
lc AS (SELECT model, {Q.level('actual')} AS a, {Q.level('predicted')} AS p, count(*) AS cnt FROM tp GROUP BY ALL),
sup AS (SELECT model, a AS level, sum(cnt) AS support, sum(CASE WHEN a = p THEN cnt ELSE 0 END) AS tp FROM lc GROUP BY ALL),
prd AS (SELECT model, p AS level, sum(cnt) AS predicted FROM lc GROUP BY ALL),
j AS (SELECT coalesce(sup.model, prd.model) AS model, coalesce(sup.level, prd.level) AS level,
             coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
      FROM sup FULL OUTER JOIN prd ON sup.model = prd.model AND sup.level = prd.level),
m AS (SELECT model, level, support,
             CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM j),
m2 AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM m)""") + """
SELECT model, level, round_even(precision, 4) AS precision, round_even(recall, 4) AS recall, round_even(f1, 4) AS f1,
       CAST(support AS BIGINT) AS support FROM m2
UNION ALL
SELECT model, 'weighted avg', round_even(sum(precision * support) / sum(support), 4),
       round_even(sum(recall * support) / sum(support), 4), round_even(sum(f1 * support) / sum(support), 4),
       CAST(sum(support) AS BIGINT) FROM m2 GROUP BY model""")
def q_class_report(spark, sf):
    """Precision / recall / F1 / support per level and weighted average."""
    return Ev.class_report(_test(spark, sf))


_PERIOD_SQL = ("CASE WHEN hour(ts) BETWEEN 0 AND 5 THEN 'night' WHEN hour(ts) BETWEEN 6 AND 9 THEN 'morning' "
               "WHEN hour(ts) BETWEEN 10 AND 13 THEN 'midday' WHEN hour(ts) BETWEEN 14 AND 16 THEN 'afternoon' "
               "WHEN hour(ts) BETWEEN 17 AND 19 THEN 'evening' WHEN hour(ts) BETWEEN 20 AND 23 THEN 'late' END")


@register("by_period", _with_preds(f"pp AS (SELECT *, {_PERIOD_SQL} AS period FROM tp),\n"
                                   f"mm AS ({_metrics_sql('pp', 'model, period')})") + """
SELECT model, period, n, MAE, R2 FROM mm""")
def q_by_period(spark, sf):
    """MAE and R² per time-of-day period."""
    return Ev.by_period(_test(spark, sf))


_RES_BIN = "CASE " + " ".join(f"WHEN predicted - actual >= {e} THEN {e}" for e in reversed(S.RESIDUAL_EDGES)) + " END"


@register("residual_histogram", _with_preds(f"rb AS (SELECT model, {_RES_BIN} AS bin_from FROM tp)") + """
SELECT model, bin_from, count(*) AS count FROM rb WHERE bin_from IS NOT NULL GROUP BY ALL""")
def q_residual_histogram(spark, sf):
    """Residual histogram per model."""
    return Ev.residual_histogram(_test(spark, sf))


@register("overfit_report", _with_preds(f"mm AS ({_metrics_sql('preds', 'model, split')})", """
w AS (SELECT model, max(CASE WHEN split = 'train' THEN R2 END) AS train_r2,
             max(CASE WHEN split = 'test' THEN R2 END) AS test_r2 FROM mm GROUP BY model)""") + """
SELECT model, train_r2, test_r2, round_even(train_r2 - test_r2, 6) AS gap,
       CASE WHEN train_r2 < 0.8 THEN 'Underfit' WHEN train_r2 - test_r2 > 0.06 THEN 'Slight Overfit'
            WHEN test_r2 = (SELECT max(test_r2) FROM w) THEN 'Best Balance' ELSE 'Good' END AS status FROM w""")
def q_overfit_report(spark, sf):
    """Train vs test R², gap and status."""
    return Ev.overfit_report(_preds(spark, sf))


_SAMPLE_SQL = f"""
sm AS (SELECT model, t_idx, strftime(ts, '%Y-%m-%d %H:%M') AS minute, CAST(trunc(actual) AS BIGINT) AS actual,
              CAST(trunc(predicted) AS BIGINT) AS predicted, round_even(predicted - actual, 0) AS error,
              {Q.emoji('actual')} AS actual_level, {Q.emoji('predicted')} AS predicted_level,
              {Q.level('actual')} = {Q.level('predicted')} AS match
       FROM te WHERE t_idx % greatest(n_test // 20, 1) = 0 AND t_idx < greatest(n_test // 20, 1) * 20)"""


def _sample(spark, sf):
    t = _test(spark, sf, index=True)
    per_model = t.groupBy("model").agg(F.min("row_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    t = t.join(bounded_broadcast(per_model), "model").withColumn("t_idx", F.col("row_idx") - F.col("_first"))
    return Ev.sample_report(t, 20, total="_n")


@register("sample_report", _with_preds(_SAMPLE_SQL) + "\nSELECT * FROM sm")
def q_sample_report(spark, sf):
    """20 evenly spaced test rows per model with levels and match."""
    return _sample(spark, sf)


@register("sample_match", _with_preds(_SAMPLE_SQL) + """
SELECT model, CAST(sum(CASE WHEN match THEN 1 ELSE 0 END) AS BIGINT) AS matched, count(*) AS rows,
       round_even(avg(CASE WHEN match THEN 1.0 ELSE 0.0 END) * 100, 0) AS match_pct FROM sm GROUP BY model""")
def q_sample_match(spark, sf):
    """E13 summary: matched count and percentage."""
    return Ev.sample_match(_sample(spark, sf))


@register("prediction_table", _with_preds() + f"""
SELECT model, row_idx, ts, actual, round_even(predicted, 6) AS predicted, round_even(predicted - actual, 6) AS error,
       round_even(abs(predicted - actual), 6) AS abs_error,
       round_even(CASE WHEN actual = 0 THEN NULL ELSE (predicted - actual) / actual END, 6) AS rel_error,
       {Q.emoji('actual', True)} AS actual_level, {Q.emoji('predicted', True)} AS predicted_level FROM tp""")
def q_prediction_table(spark, sf):
    """E14 (+F26): per-row result table."""
    t = Ev.prediction_table(_test(spark, sf, index=True))
    return t.select("model", "row_idx", "ts", "actual", *[F.bround(c, 6).alias(c) for c in
                    ("predicted", "error", "abs_error", "rel_error")], "actual_level", "predicted_level")


def _cats_sql():
    rows = ", ".join(f"('{cat}', {ci}, '{m}', {mi})" for ci, (cat, names) in enumerate(S.REPORT_CATEGORIES.items())
                     for mi, m in enumerate(names))
    return f"cats AS (SELECT * FROM (VALUES {rows}) t(Category, cat_order, Model, model_order))"


@register("leaderboard", _with_preds(f"mm AS ({_raw_sql('tp', 'model')})", _cats_sql()) + """
SELECT c.Model, c.Category, round_even(MAE, 1) AS MAE, round_even(RMSE, 1) AS RMSE,
       round_even(greatest(R2, 0.0) * 100, 2) AS R2_percent, round_even(ClassAcc, 1) AS ClassAcc
FROM cats c JOIN mm ON c.Model = mm.model ORDER BY cat_order, model_order""")
def q_leaderboard(spark, sf):
    """E15 (J2): rounded leaderboard of the models that have results."""
    return Ev.leaderboard(Ev.raw_metrics(_test(spark, sf)), Ev.category_frame(spark))


@register("with_category", _with_preds(f"mm AS ({_metrics_sql('tp', 'model')})", """
cats AS (SELECT * FROM (VALUES ('Global Mean', 'Baselines'), ('Hourly Mean', 'Baselines')) t(Model, Category))""") + """
SELECT mm.model AS Model, coalesce(c.Category, 'OTHER') AS Category, R2 FROM mm LEFT JOIN cats c ON mm.model = c.Model""")
def q_with_category(spark, sf):
    """Category lookup with default OTHER."""
    m = Ev.evaluate(_test(spark, sf)).withColumnRenamed("model", "Model")
    cats = spark.createDataFrame([("Global Mean", "Baselines"), ("Hourly Mean", "Baselines")],
                                 "Model string, Category string")
    return Ev.with_category(m, cats).select("Model", "Category", "R2")


@register("rank_models", _with_preds(f"mm AS ({_metrics_sql('tp', 'model')})") + """
SELECT model, R2, MAE, CAST(row_number() OVER (ORDER BY R2 DESC, model) AS INTEGER) AS rank FROM mm""")
def q_rank_models(spark, sf):
    """Models ranked by R²."""
    return Ev.rank_models(Ev.evaluate(_test(spark, sf))).select("model", "R2", "MAE", "rank")


@register("best_models", _with_preds(f"mm AS ({_metrics_sql('tp', 'model')})") + """
SELECT arg_max(model, (R2, model)) AS best_r2_model, max(R2) AS best_r2,
       arg_min(model, (MAE, model)) AS best_mae_model, min(MAE) AS best_mae FROM mm""")
def q_best_models(spark, sf):
    """T4: best model by R² and by MAE."""
    return Ev.best_models(Ev.evaluate(_test(spark, sf)))


@register("scatter_sample", _with_preds() + """
SELECT model, row_idx, actual, round_even(predicted, 6) AS predicted FROM tp WHERE model = 'Hourly Mean'
ORDER BY md5('42' || CAST(row_idx AS VARCHAR)), row_idx LIMIT 200""")
def q_scatter_sample(spark, sf):
    """200 hash-chosen (actual, predicted) points of one model."""
    s = Ev.scatter_sample(_test(spark, sf, index=True).where(F.col("model") == "Hourly Mean"), 200)
    return s.withColumn("predicted", F.bround("predicted", 6))


@register("align", _with_preds() + """
SELECT a.row_idx, a.actual, round_even(p.predicted, 6) AS predicted, round_even(p.predicted - a.actual, 6) AS error
FROM (SELECT row_idx, actual FROM tp WHERE model = 'Global Mean') a
JOIN (SELECT row_idx, predicted FROM tp WHERE model = 'Hourly Mean') p ON a.row_idx = p.row_idx""")
def q_align(spark, sf):
    """Predictions aligned to actuals by row index."""
    t = _test(spark, sf, index=True)
    actual = t.where(F.col("model") == "Global Mean").select("row_idx", "actual")
    pred = t.where(F.col("model") == "Hourly Mean").select("row_idx", "predicted")
    out = Ev.align(pred, actual)
    return out.select("row_idx", "actual", F.bround("predicted", 6).alias("predicted"),
                      F.bround("error", 6).alias("error"))


_KNN_DIST = " + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in S.FS18)
_KNN_STATS = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, CASE WHEN coalesce(stddev_pop(CAST({c} AS DOUBLE)), 0) = 0 "
                       f"THEN 1.0 ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS s_{c}" for c in S.FS18)
_KNN_SCALED = ", ".join(f"(CAST({c} AS DOUBLE) - m_{c}) / s_{c} AS {c}" for c in S.FS18)


@register("knn_predict", Q.with_events(f"""
ix AS (SELECT *, {IDX} AS row_idx, count(*) OVER () AS n FROM feat),
sp AS (SELECT *, CASE WHEN row_idx < CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ix),
st AS (SELECT {_KNN_STATS} FROM sp WHERE split = 'train'),
z AS (SELECT row_idx, split, CAST(traffic_volume AS DOUBLE) AS y, {_KNN_SCALED} FROM sp, st),
d AS (SELECT q.row_idx AS qid, t.row_idx AS tid, t.y, round({_KNN_DIST}, 6) AS dist
      FROM (SELECT * FROM z WHERE split = 'test') q, (SELECT * FROM z WHERE split = 'train') t),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d)""") + """
SELECT qid AS row_idx, round_even(avg(y), 6) AS predicted, count(*) AS neighbours FROM r WHERE rn <= 10 GROUP BY qid""")
def q_knn_predict(spark, sf):
    """Exact 10-NN regression of each test row on the train split, on the
    eighteen features scaled by the train split."""
    from roadflow.operators.neighbours import knn_predict
    sp = O.chrono_split(events_feat(spark, sf, encode=True))
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    p = knn_predict(train, test, S.FS18, k=10, scale=True)
    return p.select("row_idx", F.bround("predicted", 6).alias("predicted"), "neighbours")


@register("knn_index_recall", Q.with_events() + """
SELECT count(*) FILTER (WHERE obs_id % 100 = 0) AS queries,
       count(*) FILTER (WHERE obs_id % 100 = 0) * least(10, count(*)) AS neighbours, TRUE AS recall_reached FROM feat""")
def q_knn_index_recall(spark, sf):
    """J5 at size: ids divisible by 100 against all rows, through the index and exactly.
    A neighbour counts where it is no farther than the exact tenth; recall of 0.9 is asked."""
    from roadflow.operators.neighbours import knn_candidates, knn_index_candidates
    from roadflow.operators.scaling import apply_scaler, fit_scaler
    feat = events_feat(spark, sf, encode=True)
    rows = apply_scaler(feat, fit_scaler(feat, S.FS18), S.FS18)
    asked = rows.where(F.col("obs_id") % 100 == 0)
    exact = knn_candidates(rows, asked, S.FS18, train_id="obs_id", query_id="obs_id").groupBy("qid").agg(
        F.max("dist").alias("reach"), F.count(F.lit(1)).alias("wanted"))
    found = knn_index_candidates(rows, asked, S.FS18, train_id="obs_id", query_id="obs_id")
    each = exact.join(found, "qid", "left").groupBy("qid", "wanted").agg(
        F.count("tid").alias("got"), F.count_if(F.col("dist") <= F.col("reach")).alias("hits"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("got"), F.lit(0)).alias("neighbours"),
                    (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("recall_reached"))


@register("overview_with_model", _with_preds(f"mm AS ({_metrics_sql('tp', 'model')})") + """,
hx AS (SELECT hour, avg(traffic_volume) AS m FROM feat WHERE hour IS NOT NULL GROUP BY hour)
SELECT (SELECT hour FROM hx ORDER BY m DESC, hour LIMIT 1) AS peak_hour,
       (SELECT CAST(trunc(max(m)) AS BIGINT) FROM hx) AS peak_volume,
       (SELECT CAST(trunc(avg(traffic_volume)) AS BIGINT) FROM feat) AS avg_volume,
       (SELECT count(*) FROM feat) AS total_records,
       (SELECT arg_max(R2, R2) FROM mm) AS model_r2, (SELECT arg_max(MAE, R2) FROM mm) AS model_mae""")
def q_overview_with_model(spark, sf):
    """A5: overview KPIs with R² / MAE of the best evaluated model (not constants)."""
    from roadflow.operators.profiles import overview
    metrics = Ev.evaluate(_test(spark, sf))
    o = overview(events_feat(spark, sf), metrics)
    return o.select("peak_hour", "peak_volume", "avg_volume", "total_records", "model_r2", "model_mae")


@register("csv_roundtrip", _with_preds() + f"""
SELECT model, row_idx, actual, round_even(predicted, 6) AS predicted, {Q.emoji('actual', True)} AS actual_level FROM tp""")
def q_csv_roundtrip(spark, sf):
    """S5 + S1: the per-row result table written as CSV (header) into the
    shared checkpoint folder and scanned back with a declared schema."""
    import uuid

    from roadflow.session import ensure_checkpoint_dir
    from roadflow.sources.sinks import write_csv
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/predictions-{uuid.uuid4().hex}"
    t = Ev.prediction_table(_test(spark, sf, index=True)).select(
        "model", "row_idx", "actual", F.bround("predicted", 6).alias("predicted"), "actual_level")
    write_csv(t, path)
    return spark.read.schema("model string, row_idx long, actual double, predicted double, actual_level string") \
        .option("header", True).csv(path)


@register("run_config", _with_preds(f"mm AS ({_metrics_sql('tp', 'model')})") + """
SELECT 24 AS seq_len, 18 AS input_dim, 'hour,dow,month,quarter,is_weekend,temp_c,rain_1h,snow_1h,clouds_all,weather_enc,rush_hour,night,hour_sin,hour_cos,dow_sin,dow_cos,month_sin,month_cos' AS features,
       MAE AS mae, RMSE AS rmse, R2 AS r2 FROM mm WHERE model = 'Day-Hour Mean'""")
def q_run_config(spark, sf):
    """Run metadata (sequence length, features, metrics) written as JSON
    into the shared checkpoint folder and read back."""
    import uuid

    from roadflow.session import ensure_checkpoint_dir
    from roadflow.sources.sinks import write_run_config
    m = Ev.evaluate(_test(spark, sf)).where(F.col("model") == "Day-Hour Mean")
    cfg = m.select(F.lit(24).alias("seq_len"), F.lit(len(S.FS18)).alias("input_dim"),
                   F.lit(",".join(S.FS18)).alias("features"), F.col("MAE").alias("mae"),
                   F.col("RMSE").alias("rmse"), F.col("R2").alias("r2"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/config-{uuid.uuid4().hex}"
    write_run_config(cfg, path)
    return spark.read.schema("seq_len int, input_dim int, features string, mae double, rmse double, r2 double") \
        .json(path)
