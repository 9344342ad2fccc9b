"""Observation scans (S1) and adapters from the driver tables.

Adapters are pure projections: Catalyst prunes the scan to the referenced
columns and pushes any later filter on the source columns into parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow import schema as S
from roadflow.functions.calendar import parse_ts


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_observations(spark: SparkSession, path: str,
                      schema=S.OBSERVATION_SCHEMA, header: bool = True) -> DataFrame:
    """CSV scan with an explicit schema; 'None'/empty → null.

    A declared schema avoids the inference pass over the whole file and makes
    missing or mistyped columns fail at load (FAILFAST).  Times are read as text
    and parsed (F1); one that cannot be parsed is null.  ``obs_id`` is a hash of
    the whole row, so it does not depend on how files are split; rows that are
    alike in everything share it.
    """
    times = [f.name for f in schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    scanned = T.StructType([T.StructField(f.name, T.StringType()) if f.name in times else f for f in schema.fields])
    df = (spark.read.schema(scanned)
          .option("header", header)
          .option("nullValue", "None")
          .option("emptyValue", None)
          .option("mode", "FAILFAST")
          .csv(path))
    df = df.withColumns({c: parse_ts(c) for c in times})
    return df.withColumn("obs_id", F.xxhash64(*schema.names)).select(*S.OBS_COLUMNS)


def to_observations(df: DataFrame, mapping: dict[str, Column]) -> DataFrame:
    """Project any table onto the observation schema.

    ``mapping`` gives one column expression per observation column; the result
    is cast to the declared types so every adapter yields the same schema.
    """
    types = {f.name: f.dataType for f in S.OBSERVATION_SCHEMA.fields}
    cols = [mapping["obs_id"].cast("bigint").alias("obs_id")]
    for name in types:
        cols.append(mapping[name].cast(types[name]).alias(name))
    return df.select(*cols)


def _k(props: Column) -> Column:
    return F.regexp_extract(props, "[0-9]+", 0).cast("int")


def events_mapping() -> dict[str, Column]:
    k = _k(F.col("props"))
    et = F.col("event_type")
    weather = (F.when(et == "view", "Clear").when(et == "click", "Clouds")
               .when(et == "purchase", "Rain").when(et == "error", "Snow")
               .when(et == "signup", "Mist"))
    return {
        "obs_id": F.col("event_id"),
        "holiday": F.when(F.col("user_id") % 50 == 0, F.lit("Labor Day")).otherwise(F.lit("None")),
        "temp": F.lit(250.0) + k.cast("double") * F.lit(0.6),
        "rain_1h": F.when(et == "purchase", k.cast("double") / 10.0).otherwise(F.lit(0.0)),
        "snow_1h": F.when(et == "error", k.cast("double") / 100.0).otherwise(F.lit(0.0)),
        "clouds_all": k,
        "weather_main": weather,
        "weather_description": F.lower(weather),
        "date_time": F.col("ts").cast("timestamp_ntz"),
        "traffic_volume": (F.col("value") * 30).cast("bigint"),
    }


def orders_mapping() -> dict[str, Column]:
    key = F.col("o_orderkey")
    labels = F.array(*[F.lit(w) for w in S.WEATHER_LABELS])
    weather = F.element_at(labels, (key % 8 + 1).cast("int"))
    return {
        "obs_id": key,
        "holiday": F.when(F.col("o_orderpriority").startswith("1"), F.lit("Holiday"))
                    .otherwise(F.lit("None")),
        "temp": F.lit(250.0) + (F.col("o_custkey") % 100).cast("double") * F.lit(0.6),
        "rain_1h": F.lit(0.0),
        "snow_1h": F.lit(0.0),
        "clouds_all": (F.col("o_custkey") % 101).cast("int"),
        "weather_main": weather,
        "weather_description": F.lower(weather),
        "date_time": (F.col("o_orderdate").cast("timestamp_ntz")
                      + F.make_dt_interval(F.lit(0), (key % 24).cast("int"))),
        "traffic_volume": F.col("o_totalprice").cast("bigint") % 7281,
    }


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as hourly observations (January 2024, all hours/weekdays)."""
    return to_observations(load_table(spark, sf_dir, "events"), events_mapping())


def obs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as observations spanning many months and years."""
    return to_observations(load_table(spark, sf_dir, "orders"), orders_mapping())
