"""Evaluation (E1-E16), lookups (J1, J2, J4), metric union (U1), ranking.

A predictions frame has ``model, split, row_idx, ts, actual, predicted``.
Every metric is an aggregate, so one grouped pass (partial + final) computes
all of them per model; R² uses a numerically stable one-pass variance
(``var_pop * n``) for the total sum of squares, so no join back is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.functions import levels as L
from roadflow.operators.broadcast import bounded_broadcast
from roadflow.operators.ordering import systematic_sample



def _ap(a, p):
    return (F.col("actual") if a is None else a), (F.col("predicted") if p is None else p)


# -- metric expressions (aggregate context) --------------------------------------

def mae(a: Column | None = None, p: Column | None = None) -> Column:
    """E1."""
    a, p = _ap(a, p)
    return F.avg(F.abs(a - p))


def rmse(a: Column | None = None, p: Column | None = None) -> Column:
    """E2."""
    a, p = _ap(a, p)
    return F.sqrt(F.avg((a - p) * (a - p)))


def r2(a: Column | None = None, p: Column | None = None) -> Column:
    """1 - SSE/SST; SST = 0 → 1 when SSE = 0, else 0 (as scikit-learn).
    Rows without a prediction take no part."""
    a, p = _ap(a, p)
    a = F.when(p.isNotNull(), a)
    sse = F.sum((a - p) * (a - p))
    sst = F.var_pop(a) * F.count(a)
    return F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - sse / sst)


def mape(a: Column | None = None, p: Column | None = None) -> Column:
    """Mean |(a - p) / (a + 1e-6)| x 100."""
    a, p = _ap(a, p)
    return F.avg(F.abs((a - p) / (a + S.MAPE_EPS))) * 100


def class_accuracy(a: Column | None = None, p: Column | None = None) -> Column:
    """E5: % of rows whose congestion level is predicted right."""
    a, p = _ap(a, p)
    return F.avg((L.level(a) == L.level(p)).cast("double")) * 100


def r2_percent(r: Column) -> Column:
    """R² as a percentage, floored at 0."""
    return F.greatest(r, F.lit(0.0)) * 100


def clip_predictions(df: DataFrame) -> DataFrame:
    """F16: predictions clipped to [0, 10000] before scoring."""
    lo, hi = S.PREDICTION_CLIP
    return df.withColumn("predicted", L.clamp(F.col("predicted"), lo, hi))


def evaluate(preds: DataFrame, by=("model",), digits: int = 4, r2_digits: int = 6,
             clip: bool = True) -> DataFrame:
    """All metrics per group in one aggregate, rounded at the end.

    ``n`` counts all rows, ``unscored`` those without a prediction, which take no
    part in any metric."""
    return round_metrics(raw_metrics(preds, by, clip), digits, r2_digits)


def raw_metrics(preds: DataFrame, by=("model",), clip: bool = True) -> DataFrame:
    """The metrics of :func:`evaluate` before rounding."""
    df = clip_predictions(preds) if clip else preds
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted").isNull()).alias("unscored"),
        mae().alias("MAE"), rmse().alias("RMSE"), r2().alias("R2"), mape().alias("MAPE"),
        class_accuracy().alias("ClassAcc"))


def round_metrics(metrics: DataFrame, digits: int = 4, r2_digits: int = 6) -> DataFrame:
    return metrics.withColumns({c: F.bround(c, r2_digits if c == "R2" else digits)
                                for c in ("MAE", "RMSE", "R2", "MAPE", "ClassAcc")})


def union_metrics(frames) -> DataFrame:
    """Append metric rows of separately evaluated models."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


# -- classification views ------------------------------------------------------------

def level_counts(preds: DataFrame, by=("model",)) -> DataFrame:
    df = clip_predictions(preds)
    return df.groupBy(*by, L.level("actual").alias("actual_level"),
                      L.level("predicted").alias("predicted_level")).agg(F.count(F.lit(1)).alias("count"))


def confusion(preds: DataFrame, by=("model",)) -> DataFrame:
    """4 x 4 matrix, one row per actual level, one column per predicted level."""
    c = level_counts(preds, by)
    wide = c.groupBy(*by, "actual_level").pivot("predicted_level", list(S.LEVEL_NAMES)).agg(F.sum("count"))
    return wide.na.fill(0, list(S.LEVEL_NAMES))


def class_report(preds: DataFrame, by=("model",), digits: int = 4) -> DataFrame:
    """Precision, recall, F1, support per level, plus the support-weighted
    average row ('weighted avg'), as scikit-learn's report (0 when undefined).

    One aggregate pass over the (tiny) level-count table: each count row is
    exploded into its actual-level and predicted-level contributions, so
    support, predicted count and true positives come out of a single
    ``groupBy`` (no self-join); the weighted average is a window over the at
    most four level rows of each model.
    """
    c = level_counts(preds, by)
    hit = F.when(F.col("actual_level") == F.col("predicted_level"), F.col("count")).otherwise(0)
    side = F.explode(F.array(
        F.struct(F.col("actual_level").alias("level"), F.col("count").alias("sup"), F.lit(0).cast("bigint").alias("prd"),
                 hit.cast("bigint").alias("tp")),
        F.struct(F.col("predicted_level").alias("level"), F.lit(0).cast("bigint").alias("sup"),
                 F.col("count").alias("prd"), F.lit(0).cast("bigint").alias("tp"))))
    per = (c.select(*by, side.alias("s")).groupBy(*by, F.col("s.level").alias("level"))
           .agg(F.sum("s.sup").alias("support"), F.sum("s.prd").alias("predicted"), F.sum("s.tp").alias("tp")))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    per = per.withColumns({"precision": prec, "recall": rec})
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                       F.col("precision") + F.col("recall")), F.lit(0.0)))
    w = Window.partitionBy(*by)
    total = F.sum("support").over(w)
    wavg = {m: F.try_divide(F.sum(F.col(m) * F.col("support")).over(w), total) for m in ("precision", "recall", "f1")}
    # each level row also carries its model's weighted average; the average
    # rows are emitted once per model (from the first level in name order).
    per = per.withColumns({"_wp": wavg["precision"], "_wr": wavg["recall"], "_wf": wavg["f1"], "_wt": total,
                           "_first": F.row_number().over(w.orderBy("level")) == 1})
    rows = F.array(
        F.struct(F.col("level"), F.col("precision"), F.col("recall"), F.col("f1"), F.col("support"),
                 F.lit(True).alias("keep")),
        F.struct(F.lit("weighted avg").alias("level"), F.col("_wp").alias("precision"), F.col("_wr").alias("recall"),
                 F.col("_wf").alias("f1"), F.col("_wt").alias("support"), F.col("_first").alias("keep")))
    out = per.select(*by, F.inline(rows)).where("keep")
    return out.select(*by, "level", *[F.bround(m, digits).alias(m) for m in ("precision", "recall", "f1")],
                      F.col("support").cast("bigint").alias("support"))


def by_period(preds: DataFrame) -> DataFrame:
    """MAE and R² per model and time-of-day period."""
    df = preds.withColumn("period", L.period(F.hour("ts")))
    m = evaluate(df, by=("model", "period"))
    return m.select("model", "period", "n", "MAE", "R2")


def residual_histogram(preds: DataFrame, edges=S.RESIDUAL_EDGES) -> DataFrame:
    """Residual (predicted - actual) counts per left-closed bin, labelled
    by the left edge; the last bin is open-ended; below the first edge dropped."""
    e = clip_predictions(preds).withColumn("_res", F.col("predicted") - F.col("actual"))
    b = None
    for lo in reversed(edges):
        cond = F.col("_res") >= lo
        b = F.when(cond, F.lit(lo)) if b is None else b.when(cond, F.lit(lo))
    return (e.select("model", b.alias("bin_from")).where(F.col("bin_from").isNotNull())
            .groupBy("model", "bin_from").agg(F.count(F.lit(1)).alias("count")))


def overfit_report(preds: DataFrame, digits: int = 6) -> DataFrame:
    """Train vs test R² per model, gap and status."""
    m = evaluate(preds, by=("model", "split"), r2_digits=digits)
    wide = m.groupBy("model").agg(
        F.max(F.when(F.col("split") == "train", F.col("R2"))).alias("train_r2"),
        F.max(F.when(F.col("split") == "test", F.col("R2"))).alias("test_r2"))
    best = wide.agg(F.max("test_r2")).scalar()
    return wide.select("model", "train_r2", "test_r2", F.bround(F.col("train_r2") - F.col("test_r2"), digits).alias("gap"),
                       L.fit_status("train_r2", "test_r2", F.col("test_r2") == best).alias("status"))


def prediction_table(preds: DataFrame, short_labels: bool = True) -> DataFrame:
    """E14 (+F26): per-row actual, predicted, signed/absolute/relative error, levels."""
    a, p = _ap(None, None)
    return preds.select(
        "model", "row_idx", "ts", "actual", "predicted",
        (p - a).alias("error"), F.abs(p - a).alias("abs_error"),
        F.try_divide(p - a, a).alias("rel_error"),
        L.level_emoji("actual", short_labels).alias("actual_level"),
        L.level_emoji("predicted", short_labels).alias("predicted_level"))


def sample_report(preds: DataFrame, k: int = 20, idx: str = "t_idx", total: str | None = None) -> DataFrame:
    """``k`` evenly spaced test rows with error, levels and match flag.
    ``total`` names a column with the per-model row count."""
    s = systematic_sample(preds, k, idx=idx, total=total)
    return s.select("model", idx, F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"),
                    F.col("actual").cast("bigint").alias("actual"),
                    F.col("predicted").cast("bigint").alias("predicted"),
                    F.bround(F.col("predicted") - F.col("actual"), 0).alias("error"),
                    L.level_emoji("actual").alias("actual_level"),
                    L.level_emoji("predicted").alias("predicted_level"),
                    (L.level("actual") == L.level("predicted")).alias("match"))


def sample_match(report: DataFrame) -> DataFrame:
    """E13 summary: matched count and % per model."""
    return report.groupBy("model").agg(
        F.sum(F.col("match").cast("int")).alias("matched"), F.count(F.lit(1)).alias("rows"),
        F.bround(F.avg(F.col("match").cast("double")) * 100, 0).alias("match_pct"))


def scatter_sample(preds: DataFrame, n: int = 200, seed: int = 42) -> DataFrame:
    """``n`` (actual, predicted) points, hash-ordered (TakeOrderedAndProject)."""
    h = F.md5(F.concat(F.lit(str(seed)), F.col("row_idx").cast("string")))
    return (preds.select("model", "row_idx", "actual", "predicted", h.alias("_h"))
            .orderBy("_h", "row_idx").limit(n).drop("_h"))


# -- lookups, ranking ----------------------------------------------------------------

def category_frame(spark, categories=S.REPORT_CATEGORIES) -> DataFrame:
    rows = [(cat, ci, name, mi) for ci, (cat, names) in enumerate(categories.items())
            for mi, name in enumerate(names)]
    return spark.createDataFrame(rows, "Category string, cat_order int, Model string, model_order int")


def with_category(metrics: DataFrame, cats: DataFrame) -> DataFrame:
    """Model → category, default 'OTHER' (broadcast lookup, size-checked)."""
    c = bounded_broadcast(cats.select("Model", "Category"), max_rows=100_000)
    return metrics.join(c, "Model", "left").withColumn("Category", F.coalesce("Category", F.lit("OTHER")))


def known_models(cats: DataFrame, metrics: DataFrame) -> DataFrame:
    """The category list restricted to models that have results, in order."""
    return cats.join(metrics, "Model", "inner")


def leaderboard(metrics: DataFrame, cats: DataFrame) -> DataFrame:
    """Leaderboard of known models in category/list order, rounded once
    from the raw metrics (:func:`raw_metrics`)."""
    m = metrics.withColumnRenamed("model", "Model") if "model" in metrics.columns else metrics
    j = known_models(bounded_broadcast(cats, max_rows=100_000), m)
    return j.select(
        "Model", "Category", F.bround("MAE", 1).alias("MAE"), F.bround("RMSE", 1).alias("RMSE"),
        F.bround(r2_percent(F.col("R2")), 2).alias("R2_percent"), F.bround("ClassAcc", 1).alias("ClassAcc"),
        "cat_order", "model_order").orderBy("cat_order", "model_order").drop("cat_order", "model_order")


def rank_models(metrics: DataFrame, metric: str = "R2", ascending: bool = False) -> DataFrame:
    """Rank by a metric (ties by name).  The window runs over the metrics
    table only - one row per model."""
    o = F.col(metric).asc() if ascending else F.col(metric).desc()
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(o, F.col("model"))))


def best_models(metrics: DataFrame) -> DataFrame:
    """T4: best model by R² (max) and by MAE (min)."""
    return metrics.agg(F.max_by("model", F.struct("R2", F.col("model"))).alias("best_r2_model"),
                       F.max("R2").alias("best_r2"),
                       F.min_by("model", F.struct("MAE", F.col("model"))).alias("best_mae_model"),
                       F.min("MAE").alias("best_mae"))


def align(pred: DataFrame, actual: DataFrame, key: str = "row_idx") -> DataFrame:
    """Equi-join predictions to actuals on the row index."""
    return actual.join(pred, key, "inner").select(
        key, "actual", "predicted", (F.col("predicted") - F.col("actual")).alias("error"))
