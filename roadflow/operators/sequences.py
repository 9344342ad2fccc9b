"""Sliding sequences (W1, W2, W4, D4s) that scale past one partition.

A window over the whole time series would run in one task.  Instead rows are
cut into chunks of ``chunk`` consecutive indices; the last ``s`` rows of each
chunk are also copied into the next chunk as a halo.  A window partitioned by
chunk then sees every row's ``s`` predecessors, and halo copies are dropped
after the window.  Work per task is bounded by ``chunk + s`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def make_sequences(df: DataFrame, cols, y: str = "traffic_volume", s: int = 24,
                   idx: str = "row_idx", ts: str = "date_time", within: str | None = None,
                   chunk: int = 4096) -> DataFrame:
    """Previous ``s`` rows' features → ``seq`` (s x F doubles); this row's
    target → ``label``, its time → ``label_ts`` (W1/W2).

    ``within`` names a split column: sequences never cross it (W4).  ``df``
    needs a dense ``idx``; rows with null features must be removed first
    (``collect_list`` skips nulls).
    """
    if chunk < s:
        raise ValueError("chunk must be >= s")
    c = F.floor(F.col(idx) / chunk).cast("bigint")
    in_halo = (F.col(idx) % chunk) >= (chunk - s)
    rows = df.select(
        idx, F.col(y).cast("double").alias("label"), F.col(ts).alias("label_ts"),
        *([within] if within else []),
        F.array(*[F.col(x).cast("double") for x in cols]).alias("_x"),
        c.alias("_home"),
        F.explode(F.when(in_halo, F.array(c, c + 1)).otherwise(F.array(c))).alias("_chunk"))
    part = ["_chunk"] + ([within] if within else [])
    w = Window.partitionBy(*part).orderBy(idx).rowsBetween(-s, -1)
    seqs = rows.withColumn("seq", F.collect_list("_x").over(w))
    return (seqs.where((F.col("_chunk") == F.col("_home")) & (F.size("seq") == s))
            .drop("_x", "_home", "_chunk"))


def sequence_steps(seqs: DataFrame, cols) -> DataFrame:
    """Long form of ``make_sequences``: one row per (sequence, step) with the
    feature values as columns; step 0 is the oldest row."""
    ex = seqs.select("*", F.posexplode("seq").alias("step", "_v")).drop("seq")
    return ex.select(*[c for c in ex.columns if c != "_v"],
                     *[F.col("_v")[i].alias(c) for i, c in enumerate(cols)])


def split_sequences(seqs: DataFrame, frac: float = 0.8, s: int = 24,
                    idx: str = "row_idx") -> DataFrame:
    """D4s: chronological split over sequences: ordinal = idx - s, the first
    ``int(n_seq * frac)`` are train.  ``n_seq`` is a scalar subquery."""
    n = seqs.agg(F.count(F.lit(1))).scalar()
    cut = F.floor(n.cast("double") * F.lit(float(frac))).cast("bigint")
    return seqs.withColumn("seq_split", F.when(F.col(idx) - s < cut, F.lit("train"))
                           .otherwise(F.lit("test")))
