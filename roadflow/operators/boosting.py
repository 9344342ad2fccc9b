"""AdaBoost.R2 regression (M7) as a driver loop of distributed tree fits.

Each round fits a weighted ``DecisionTreeRegressor`` (``weightCol``), scores
the train split, and updates sample weights with DataFrame arithmetic; only
three scalars per round (max error, weighted error, total weight) reach the
driver, from one aggregate.
Lineage is cut with ``checkpoint()`` every few rounds (shared checkpoint
folder), so a lost executor never replays the whole loop.  Prediction is the
weighted median of the rounds' predictions, computed per row with array
higher-order functions (no Python on the executors).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.operators.models import scaler_literals, scaler_stage
from roadflow.session import cut_lineage


class AdaBoostModel:
    def __init__(self, scaler, assembler, trees, weights):
        self.scaler, self.assembler, self.trees, self.weights = scaler, assembler, trees, weights

    def transform(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        x = self.assembler.transform(self.scaler.transform(df))
        preds = []
        for i, t in enumerate(self.trees):
            x = t.setPredictionCol(f"_p{i}").transform(x)
            preds.append(F.struct(F.col(f"_p{i}").alias("p"), F.lit(float(self.weights[i])).alias("w")))
        arr = F.array_sort(F.array(*preds), lambda a, b: F.when(a["p"] < b["p"], -1)
                           .when(a["p"] > b["p"], 1).otherwise(0))
        half = 0.5 * sum(self.weights)
        init = F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast("double").alias("ans"))
        med = F.aggregate(arr, init, lambda s, e: F.struct(
            (s["acc"] + e["w"]).alias("acc"),
            F.coalesce(s["ans"], F.when(s["acc"] + e["w"] >= half, e["p"])).alias("ans")))
        drop = [f"_p{i}" for i in range(len(self.trees))] + ["features"] + \
            [c for c in x.columns if c.endswith("__z")]
        return x.withColumn(out, med["ans"]).drop(*drop)


def fit_adaboost(train: DataFrame, cols=S.FS18, y: str = S.TARGET, rounds: int = 100,
                 depth: int = 3, lr: float = 1.0, checkpoint_every: int = 5) -> AdaBoostModel:
    stats = scaler_literals(train, cols)
    scaler = scaler_stage(stats, cols)
    assembler = VectorAssembler(inputCols=[f"{c}__z" for c in cols], outputCol="features")
    data = assembler.transform(scaler.transform(train)).select(
        "features", F.col(y).cast("double").alias("label"))
    # weights start equal; only their proportions matter
    data = cut_lineage(data.withColumn("w", F.lit(1.0)))
    trees, weights = [], []
    for m in range(rounds):
        tree = DecisionTreeRegressor(maxDepth=depth, weightCol="w", seed=42 + m).fit(data)
        scored = tree.transform(data).withColumn("_err", F.abs(F.col("prediction") - F.col("label")))
        # one pass: the mean loss is sum(w * err) / max(err) / sum(w)
        agg = scored.agg(F.max("_err").alias("dmax"), F.sum(F.col("w") * F.col("_err")).alias("we"),
                         F.sum("w").alias("ws")).first()
        dmax = agg["dmax"]
        if not dmax:
            trees.append(tree)
            weights.append(1.0)
            break
        avg_loss, wsum = agg["we"] / dmax / agg["ws"], agg["ws"]
        if avg_loss >= 0.5:
            if not trees:
                trees.append(tree)
                weights.append(1.0)
            break
        beta = avg_loss / (1.0 - avg_loss)
        trees.append(tree)
        weights.append(lr * math.log(1.0 / beta) if beta > 0 else 1.0)
        if beta == 0:
            break
        data = scored.select("features", "label", (
            F.col("w") / wsum * F.pow(F.lit(beta), lr * (1.0 - F.col("_err") / dmax))).alias("w"))
        if (m + 1) % checkpoint_every == 0:
            data = cut_lineage(data)
    return AdaBoostModel(scaler, assembler, trees, weights)
