"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadflow.operators.features import add_features
from roadflow.sources.observations import obs_events, obs_orders


def events_obs(spark: SparkSession, sf: str) -> DataFrame:
    return obs_events(spark, sf)


def events_feat(spark: SparkSession, sf: str, encode: bool = False) -> DataFrame:
    """Observations from ``events`` with derived features (no weather code
    unless asked, so profile plans carry no vocabulary join)."""
    return add_features(obs_events(spark, sf), encode=encode)


def orders_feat(spark: SparkSession, sf: str, encode: bool = False) -> DataFrame:
    return add_features(obs_orders(spark, sf), encode=encode)
