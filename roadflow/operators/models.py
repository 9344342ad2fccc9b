"""Regression models on Spark MLlib.

Every model is a ``Pipeline``: a ``SQLTransformer`` that standardises the
feature columns with the train-split mean and *population* std (fitted by us,
baked in as literals, so the saved model carries its scaler), a
``VectorAssembler`` and the estimator.  Training and serving therefore use
the same fitted pipeline.

The single tree is Spark's distributed implementation (histogram split finding,
one pass per level over the partitions).  Boosted models and forests are those of
:mod:`roadflow.operators.histboost` and :mod:`roadflow.operators.forest`: a spec whose
``build`` is their parameters.  None claims to reproduce the numbers of a
single-machine library.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.operators import evaluate as Ev
from roadflow.operators.features import display_name
from roadflow.operators.forest import ForestModel, ForestParams, fit_forest
from roadflow.operators.histboost import Binned, BoostedModel, Params, fit_boosted
from roadflow.operators.scaling import fit_scaler
from roadflow.session import side_by_side

LABEL = "label"


@dataclass
class ModelSpec:
    """A named estimator factory.  ``build(ctx)`` gets the train statistics
    (``n``, ``y_std``) some regularisation constants depend on; a boosted
    model's or forest's ``build`` is its parameters."""
    name: str
    category: str
    build: Callable | Params | ForestParams
    scaled: bool = True
    params: dict = field(default_factory=dict)


# Node-id caching and a larger per-iteration memory budget let one data pass
# split more nodes (fewer jobs per tree level); results are unchanged.
_TREE_OPTS = {"cacheNodeIds": True, "maxMemoryInMB": 1024}


def _linear(ctx):
    return LinearRegression(regParam=0.0, elasticNetParam=0.0, standardization=False)


def _ridge(alpha=1.0):
    # scikit-learn's alpha on ||w||^2 with an unscaled SSE equals Spark's
    # regParam = alpha * std_pop(y) / n (Spark scales the label internally).
    def b(ctx):
        return LinearRegression(regParam=alpha * ctx["y_std"] / ctx["n"], elasticNetParam=0.0,
                                standardization=False)
    return b


def _lasso(alpha=0.1):
    def b(ctx):
        return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=1000)
    return b


def _tree(depth=10):
    return lambda ctx: DecisionTreeRegressor(maxDepth=depth, seed=42, **_TREE_OPTS)


def _gbt(rounds=200, lr=0.05, depth=3, **options):
    return Params(rounds=rounds, rate=lr, depth=depth, **options)


# Reference configurations (names as reported).
SPECS = {
    "Linear Regression": ModelSpec("Linear Regression", "LINEAR", _linear),
    "Ridge Regression": ModelSpec("Ridge Regression", "LINEAR", _ridge(1.0)),
    "Lasso Regression": ModelSpec("Lasso Regression", "LINEAR", _lasso(0.1)),
    "Decision Tree": ModelSpec("Decision Tree", "TREE", _tree(10)),
    "Random Forest": ModelSpec("Random Forest", "TREE", ForestParams(200, random=False)),
    "Extra Trees": ModelSpec("Extra Trees", "TREE", ForestParams(200)),
    "Gradient Boosting": ModelSpec("Gradient Boosting", "TREE", _gbt(200, 0.05, 3)),
    "XGBoost": ModelSpec("XGBoost", "BOOST", _gbt(300, 0.05, 6, reg=1.0)),
    "XGBoost (subsampled)": ModelSpec("XGBoost (subsampled)", "BOOST", _gbt(300, 0.05, 6, reg=1.0, rows=0.8,
                                                                            columns=0.8)),
    "LightGBM": ModelSpec("LightGBM", "BOOST", _gbt(300, 0.05, None, leaves=31, least_weight=20)),
    "LightGBM (63 leaves)": ModelSpec("LightGBM (63 leaves)", "BOOST", _gbt(300, 0.05, None, leaves=63,
                                                                          least_weight=20)),
}

def scaler_literals(train: DataFrame, cols) -> dict:
    """Fit mean / population std (zero → 1) on train; a handful of scalars."""
    row = fit_scaler(train, cols).first()
    return {c: (row[f"{c}__mean"], row[f"{c}__std"]) for c in cols}


def scaler_stage(stats: dict, cols, suffix: str = "__z") -> SQLTransformer:
    exprs = ", ".join(f"(CAST(`{c}` AS DOUBLE) - ({stats[c][0]!r})) / ({stats[c][1]!r}) AS `{c}{suffix}`"
                      for c in cols)
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


def train_context(train: DataFrame, y: str = S.TARGET) -> dict:
    r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(F.col(y).cast("double")).alias("s")).first()
    return {"n": r["n"], "y_std": r["s"] or 1.0}


def fit_state(train: DataFrame, cols, y: str = S.TARGET) -> tuple[dict, dict]:
    """Label statistics and the feature scaler in ONE aggregate pass."""
    extra = [F.count(F.lit(1)).alias("__n"), F.stddev_pop(F.col(y).cast("double")).alias("__ystd")]
    aggs = [F.avg(F.col(c).cast("double")).alias(f"{c}__mean") for c in cols]
    aggs += [F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__sd") for c in cols]
    row = train.agg(*aggs, *extra).first()
    stats = {}
    for c in cols:
        sd = row[f"{c}__sd"]
        stats[c] = (row[f"{c}__mean"], 1.0 if not sd else sd)
    return {"n": row["__n"], "y_std": row["__ystd"] or 1.0}, stats


def fit_model(train: DataFrame, spec: ModelSpec, cols=S.FS18, y: str = S.TARGET,
              ctx: dict | None = None, stats: dict | None = None,
              known: Binned | None = None) -> PipelineModel | BoostedModel | ForestModel:
    """Fit scaler + assembler + estimator on ``train``; boosted models and forests need no scaler.

    ``known``: the cells of a boosted model, if made before."""
    if isinstance(spec.build, Params):
        return fit_boosted(train, spec.build, cols, y, known=known)
    if isinstance(spec.build, ForestParams):
        return fit_forest(train, spec.build, cols, y)
    stages = []
    feats = list(cols)
    if ctx is None and stats is None and spec.scaled:
        ctx, stats = fit_state(train, cols, y)
    if spec.scaled:
        stats = stats or scaler_literals(train, cols)
        stages.append(scaler_stage(stats, cols))
        feats = [f"{c}__z" for c in cols]
    stages.append(VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"))
    est = spec.build(ctx or train_context(train, y)).setFeaturesCol("features").setLabelCol(LABEL)
    est = est.setPredictionCol("prediction")
    stages.append(est)
    data = train.withColumn(LABEL, F.col(y).cast("double"))
    return Pipeline(stages=stages).fit(data)


def predict(model: PipelineModel | BoostedModel | ForestModel, df: DataFrame, out: str = "predicted") -> DataFrame:
    """Batch prediction (a projection on executors)."""
    if isinstance(model, BoostedModel | ForestModel):
        return model.transform(df, out)
    scored = model.transform(df)
    drop = [c for c in scored.columns if c.endswith("__z")] + ["features"]
    return scored.withColumnRenamed("prediction", out).drop(*drop)


def predictions_frame(model: PipelineModel | BoostedModel | ForestModel, df: DataFrame, name: str, y: str = S.TARGET) -> DataFrame:
    p = predict(model, df)
    index = [c for c in ("row_idx",) if c in p.columns]
    return p.select(F.lit(name).alias("model"), "split", *index, F.col("date_time").alias("ts"),
                    F.col(y).cast("double").alias("actual"), "predicted")


def run_benchmark(test: DataFrame, fits, y: str = S.TARGET) -> DataFrame:
    """Score the test split with every fitted model, evaluate, attach fit seconds.

    ``fits``: (name, category, predictor, seconds), a predictor adding
    ``predicted`` to a frame of features.
    """
    spark = test.sparkSession

    def evaluated(name, predictor) -> DataFrame:
        return Ev.evaluate(predictor(test).select(
            F.lit(name).alias("model"), "split", F.col(y).cast("double").alias("actual"), "predicted"))

    # predictors may run jobs of their own
    frames = side_by_side(spark, [partial(evaluated, name, predictor) for name, _, predictor, _ in fits])
    times = [(name, category, round(seconds, 3)) for name, category, _, seconds in fits]
    metrics = Ev.union_metrics(frames).withColumnRenamed("model", "Model")
    t = spark.createDataFrame(times, "Model string, Category string, Time double")
    return metrics.join(F.broadcast(t), "Model").select(
        "Model", "Category", "MAE", "RMSE", "R2", "MAPE", "ClassAcc", "Time")


def feature_importance(model: PipelineModel | BoostedModel, cols=S.FS18, digits: int = 4) -> DataFrame:
    """M14 + J3 + T3: normalised importances zipped with names by position,
    display names, sorted descending."""
    spark = SparkSession.getActiveSession()
    imp = model.importances() if isinstance(model, BoostedModel) else \
        model.stages[-1].featureImportances.toArray().tolist()
    return rank_importance(spark.createDataFrame(list(zip(cols, imp)), "feature string, importance double"), digits)


def rank_importance(importance: DataFrame, digits: int = 4) -> DataFrame:
    """J3 + T3 on a table (feature, importance): sorted by the raw value, then rounded."""
    named = importance.orderBy(F.desc("importance"), F.asc("feature"))
    return named.select(display_name("feature").alias("feature"), F.bround("importance", digits).alias("importance"),
                        F.col("feature").alias("column"))


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """T5: the ``k`` most important features."""
    return importance.limit(k)


def ablation(train: DataFrame, test: DataFrame, spec: ModelSpec, sets=("FS7", "FS18"),
             y: str = S.TARGET, fitted: dict | None = None) -> DataFrame:
    """The same model on each feature set; R² and gain over the first.
    ``fitted`` holds models that have been fitted already, by set."""
    rows = []
    for s in sets:
        cols = S.FEATURE_SETS[s]
        m = (fitted or {}).get(s) or fit_model(train, spec, cols, y)
        rows.append(Ev.evaluate(predictions_frame(m, test, spec.name, y)).select(
            F.lit(s).alias("feature_set"), F.lit(len(cols)).alias("n_features"), "R2", "MAE"))
    out = Ev.union_metrics(rows)
    base = out.where(F.col("feature_set") == sets[0]).select("R2").scalar()
    return out.withColumn("r2_gain", F.bround(F.col("R2") - base, 6))
