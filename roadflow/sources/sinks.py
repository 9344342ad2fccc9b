"""Sinks (S4-S8): JSON records, CSV tables, fitted state, run metadata."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.operators.histboost import BoostedModel


def to_json_records(df: DataFrame, col: str = "json") -> DataFrame:
    """One JSON object per row (encoded on executors)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(col))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, written in parallel (one file per partition)."""
    df.write.mode(mode).option("header", True).csv(path)


def leaderboard_frame(spark: SparkSession, rows, schema=S.LEADERBOARD_SCHEMA) -> DataFrame:
    """Small list of result records → DataFrame with a declared schema."""
    return spark.createDataFrame(rows, schema=schema)


def save_model(model, path: str, state: dict[str, DataFrame] | None = None) -> None:
    """Persist a fitted pipeline or boosted model and its state tables
    (vocabulary, scaler stats, target stats) as parquet next to it."""
    if isinstance(model, BoostedModel):
        model.save(SparkSession.getActiveSession(), f"{path}/boosted")
    else:
        model.write().overwrite().save(f"{path}/model")
    for name, df in (state or {}).items():
        df.write.mode("overwrite").parquet(f"{path}/state/{name}")


def load_model(spark: SparkSession, path: str, names=(), boosted: bool = False):
    model = BoostedModel.load(spark, f"{path}/boosted") if boosted else PipelineModel.load(f"{path}/model")
    state = {n: spark.read.parquet(f"{path}/state/{n}") for n in names}
    return model, state


def write_run_config(df: DataFrame, path: str) -> None:
    """One-row run metadata (features, metrics) as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)
