"""Score a stream of request records (ST1).

The service answered one HTTP request at a time; here requests arrive as
files and are scored in micro-batches by the same fitted pipeline used in
batch.  The query is stateless (decode → features with a broadcast vocabulary
→ model projection → level/risk/factors), so it needs no watermark; the file
source and sink checkpoint their progress in the shared checkpoint folder, so
a restarted query resumes where it stopped.

Requests may also be delivered more than once, and late (``answer_once``): ids are
remembered until the watermark passes their time by the delay, and every
micro-batch is answered by the newest model version published by then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadflow.operators.scenario import predict_requests, table_predictor
from roadflow.session import ensure_checkpoint_dir
from roadflow.sources.requests import decode_requests, events_to_requests


def request_stream(spark: SparkSession, sf_dir: str, table: str = "events",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming frame of decoded requests derived from a table's files.

    The table's own path is the source: one file, or a folder of part files.  It
    is written as a pattern, because a streaming source that is a plain path must
    be a folder.
    """
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        source = source.option("maxFilesPerTrigger", max_files_per_trigger)
    return decode_requests(events_to_requests(source.parquet(path[:-1] + "[t]")))


def score_stream(stream: DataFrame, predictor) -> DataFrame:
    """ST1: stateless scoring of a request stream (works on batch frames too)."""
    return predict_requests(stream, predictor)


def run_available(stream: DataFrame, name: str | None = None) -> DataFrame:
    """Process everything available now into a parquet sink under the shared
    checkpoint folder and return the sink as a batch frame."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name or 'q'}-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def publish_means(means: DataFrame, fallback: float, path: str, version: int) -> None:
    """Write a mean table (dow, hour, _mean) as one version of the model under ``path``."""
    means.withColumn("_fallback", F.lit(float(fallback))).write.parquet(f"{path}/version={int(version)}")


def newest_means(spark: SparkSession, path: str):
    """(predictor, version) of the newest version under ``path``; at most 168 rows a version."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0]
    means = table.where(F.col("version") == version)
    return table_predictor(means.select("dow", "hour", "_mean"), fallback=means.agg(F.max("_fallback")).scalar()), version


def answer_once(stream: DataFrame, models: str, base: str, delay: str, time_col: str = "asked_at",
                id_col: str = "request_id") -> DataFrame:
    """ST1 with repeated and late requests: one answer per id, all files available now.

    Of the deliveries of an id the first to arrive is answered, whichever file or
    micro-batch the others come in; a request older than the watermark (the latest
    time seen less ``delay``) is not answered.  State is kept for ids within the
    delay only.  The model is read anew for every micro-batch, whose answers
    replace those of an earlier try of the same batch.  Called again with the same
    ``base``, it goes on with the remembered ids.
    """
    spark = stream.sparkSession
    once = stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])

    def answer(batch: DataFrame, number: int) -> None:
        predictor, version = newest_means(batch.sparkSession, models)
        answers = predict_requests(batch.drop(time_col), predictor).withColumn("model_version", F.lit(version))
        answers.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = (once.writeStream.foreachBatch(answer).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def delivered_requests(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of decoded requests from a folder of request files (request_id, body, asked_at)."""
    source = spark.readStream.schema("request_id long, body string, asked_at timestamp")
    source = source.option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return decode_requests(source, keep=("asked_at",))
