"""Request records (S3): JSON text → typed columns with per-field defaults.

Many requests are decoded at once by ``from_json`` on executors; a missing or
unparseable field takes its default (``coalesce(try_cast(...), default)``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow import schema as S
from roadflow.sources.observations import load_table

INT_FIELDS = ("hour", "dow", "month")
DOUBLE_FIELDS = ("temp_c", "rain", "snow", "clouds", "weather_severity",
                 "special_event", "incident", "remote_work")

# Every field is read as text so numbers and numeric strings both decode.
RAW_REQUEST_SCHEMA = T.StructType(
    [T.StructField(f, T.StringType(), True) for f in INT_FIELDS + DOUBLE_FIELDS + ("weather",)])


def decode_requests(df: DataFrame, text_col: str = "body", id_col: str = "request_id",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse request JSON and apply defaults; numbers truncate to int like ``int()``.
    Columns in ``keep`` are passed on.

    Text that is no number, and numbers that no int can hold, take the default.
    """
    # parse once into a struct column; Catalyst keeps the expensive parse in
    # its own projection instead of inlining it into every field extraction.
    parsed = df.select(F.col(id_col), *keep, F.from_json(F.col(text_col), RAW_REQUEST_SCHEMA).alias("_r"))
    r = F.col("_r")
    cols: list[Column] = [F.col(id_col), *map(F.col, keep)]
    for f in INT_FIELDS:
        cols.append(F.coalesce(r[f].try_cast(T.DoubleType()).try_cast(T.IntegerType()),
                               F.lit(S.REQUEST_DEFAULTS[f])).alias(f))
    for f in DOUBLE_FIELDS:
        cols.append(F.coalesce(r[f].try_cast(T.DoubleType()),
                               F.lit(float(S.REQUEST_DEFAULTS[f]))).alias(f))
    cols.append(F.coalesce(r["weather"], F.lit(S.REQUEST_DEFAULTS["weather"])).alias("weather"))
    return parsed.select(*cols)


def requests_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per ``events`` row, as JSON text with some fields omitted.

    The narrow rows are dealt out first: a scan has as many tasks as the file has
    splits, often one, and text, decoding and scoring would follow in them.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return events_to_requests(load_table(spark, sf_dir, "events").repartition(tasks, "event_id"))


def events_to_requests(ev: DataFrame) -> DataFrame:
    """Request JSON per event row (batch or stream), and when it was asked.

    Omitted fields (null → dropped by ``to_json``) exercise the defaults; one
    user in seven asks for an unseen weather label.
    """
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    et, uid = F.col("event_type"), F.col("user_id")
    weather = (F.when(uid % 7 == 0, "Haze").when(et == "view", "Clear").when(et == "click", "Clouds")
               .when(et == "purchase", "Rain").when(et == "error", "Snow"))
    body = F.struct(
        F.when(et != "signup", F.hour("ts")).alias("hour"),
        F.when(et != "view", F.weekday("ts")).alias("dow"),
        F.when(et != "click", k % 12 + 1).alias("month"),
        F.when(et != "error", k.cast("double") * 0.5 - 10.0).alias("temp_c"),
        F.when(et == "purchase", k.cast("double") / 10.0).alias("rain"),
        F.when(et == "error", k.cast("double") / 100.0).alias("snow"),
        F.when(et != "purchase", k).alias("clouds"),
        weather.alias("weather"),
        F.when(uid % 3 != 0, (uid % 5) * 25).alias("weather_severity"),
        F.when(uid % 4 != 0, (k % 3) * 50).alias("special_event"),
        F.when(et != "view", (uid % 2) * 100).alias("incident"),
        F.when(et != "click", (k % 5) * 25).alias("remote_work"),
    )
    return ev.select(F.col("event_id").alias("request_id"), F.to_json(body).alias("body"),
                     F.col("ts").cast("timestamp").alias("asked_at"))
