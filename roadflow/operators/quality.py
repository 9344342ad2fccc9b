"""Data-quality profiling.

Exact quantiles never gather a column into one task: rows are counted by value,
the distinct values are range-partitioned, and a filtered aggregate picks those
at the wanted ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadflow.functions import levels as L
from roadflow.operators.features import display_name
from roadflow.operators.profiles import pct_1dp
from roadflow.session import cut_lineage

V = "traffic_volume"


def profile_columns(df: DataFrame, cols=None, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Per column its type, missing count and %, distinct count.

    Exact: every column is counted by value on its own (a partial aggregate on a
    pruned scan, one row per distinct value after it), so no row is expanded into
    one copy a column.  ``exact=False`` uses HyperLogLog++ in a single pass, which
    keeps state per task bounded on high-cardinality data.
    """
    cols = cols or df.columns
    types = dict(df.dtypes)
    if exact:
        long = None
        for c in cols:
            values = df.groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
            one = values.agg(F.sum("_c").alias("_n"), F.sum(F.when(F.col("_v").isNull(), F.col("_c"))).alias("_m"),
                             F.count("_v").alias("n_distinct")).select(
                F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                F.coalesce("_n", F.lit(0)).alias("_n"), F.coalesce("_m", F.lit(0)).alias("missing"), "n_distinct")
            long = one if long is None else long.unionByName(one)
    else:
        aggs = [F.count(F.lit(1)).alias("_n")]
        for i, c in enumerate(cols):
            aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"_m{i}"),
                     F.approx_count_distinct(F.col(c), rsd).alias(f"_d{i}")]
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                                  F.col(f"_m{i}").alias("missing"), F.col(f"_d{i}").alias("n_distinct"))
                         for i, c in enumerate(cols)])
        long = df.agg(*aggs).select("_n", F.inline(rows))
    share = F.when(F.col("_n") > 0, pct_1dp("missing", "_n"))
    return long.select("column_name", "dtype", "missing", share.alias("missing_pct"), "n_distinct")


def exact_quantiles(df: DataFrame, col: str, probs) -> DataFrame:
    """One row with ``q{p}`` = linear-interpolated quantile (type 7) of ``col``.

    Rows are first reduced to (value, count): a value that fills most of the
    table is absorbed by the partial aggregate.  The distinct values are ranged
    (they are unique, so no range is oversized), and each knows its first and
    last rank from the running count in its range and the ranges before it.
    """
    v = F.col(col).cast("double")
    counts = df.select((v + F.lit(0.0)).alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")) \
        .groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    ranged = cut_lineage(counts.repartitionByRange("_v").withColumn("_pid", F.spark_partition_id()))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_pid").agg(F.sum("_c").alias("_s")).select(  # one row per range
        "_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"),
        F.sum("_s").over(Window.partitionBy()).alias("_n"))
    inside = Window.partitionBy("_pid").orderBy("_v")
    idx = ranged.join(F.broadcast(offsets), "_pid").withColumn("_last", F.col("_off") + F.sum("_c").over(inside))
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)

        def holds(rank):
            return (F.col("_last") - F.col("_c") <= rank) & (rank < F.col("_last"))

        aggs += [F.max(F.when(holds(lo), F.col("_v"))).alias(f"_lo{i}"),
                 F.max(F.when(holds(hi), F.col("_v"))).alias(f"_hi{i}"),
                 F.max(pos - lo).alias(f"_f{i}")]
    picked = idx.agg(*aggs)
    return picked.select(*[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
                           .alias(_qname(p)) for i, p in enumerate(probs)])


def _qname(p: float) -> str:
    return "q" + str(p).replace("0.", "").ljust(2, "0")


def summary(df: DataFrame, col: str = V, digits: int = 6) -> DataFrame:
    """Count, min, q1, median, mean, q3, max, sample std."""
    q = exact_quantiles(df, col, (0.25, 0.5, 0.75))
    c = F.col(col).cast("double")
    basic = df.agg(F.count(c).alias("count"), F.min(c).alias("min"), F.avg(c).alias("mean"),
                   F.max(c).alias("max"), F.stddev_samp(c).alias("std"))
    r = lambda x: F.bround(x, digits)
    return basic.select(
        "count", r(F.col("min")).alias("min"), r(q.select("q25").scalar()).alias("q1"),
        r(q.select("q50").scalar()).alias("median"), r(F.col("mean")).alias("mean"),
        r(q.select("q75").scalar()).alias("q3"), r(F.col("max")).alias("max"),
        r(F.col("std")).alias("std"))


def iqr_outliers(df: DataFrame, col: str = V, k: float = 1.5) -> DataFrame:
    """Q1, Q3, IQR, bounds Q1-k*IQR / Q3+k*IQR and rows outside them."""
    q = exact_quantiles(df, col, (0.25, 0.75))
    q1, q3 = q.select("q25").scalar(), q.select("q75").scalar()
    lower, upper = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    c = F.col(col).cast("double")
    flagged = df.select(c.alias("_v"), ((c < lower) | (c > upper)).alias("_out"))
    return flagged.agg(F.count(F.when(F.col("_out"), 1)).alias("n_outliers"),
                       F.count("_v").alias("n")).select(
        F.bround(q1, 6).alias("q1"), F.bround(q3, 6).alias("q3"),
        F.bround(q3 - q1, 6).alias("iqr"), F.bround(lower, 6).alias("lower"),
        F.bround(upper, 6).alias("upper"), "n_outliers", "n")


def correlations(df: DataFrame, cols, y: str = V, digits: int = 6) -> DataFrame:
    """Pearson correlation of each column with ``y`` (one aggregate pass),
    ranked by absolute value, tagged and named for display."""
    yy = F.col(y).cast("double")
    # covariance over the product of population deviations; a constant column
    # (zero deviation) gives null instead of a division error.
    wide = df.agg(*[F.try_divide(F.covar_pop(F.col(c).cast("double"), yy),
                                 F.stddev_pop(F.col(c).cast("double")) * F.stddev_pop(yy)).alias(f"_c{i}")
                    for i, c in enumerate(cols)])
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("_r")) for i, c in enumerate(cols)])))
    r = F.bround(F.nanvl(F.col("_r"), F.lit(None).cast("double")), digits)
    w = Window.orderBy(F.abs(r).desc_nulls_last(), F.col("feature"))
    return long.select(
        "feature", display_name("feature").alias("display_name"), r.alias("corr"),
        F.abs(r).alias("abs_corr"), L.corr_tag(r).alias("strength"),
        F.row_number().over(w).alias("rank"))


def volume_histogram(df: DataFrame, col: str = V, width: int = 500, top: int = 11) -> DataFrame:
    """Counts per fixed-width bin; the last bin is open-ended."""
    b = L.fixed_bins(col, width, top)
    return (df.where(F.col(col).isNotNull()).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.col("bin") * width).alias("bin_from"),
                    F.when(F.col("bin") == top, F.lit(None))
                    .otherwise((F.col("bin") + 1) * width).alias("bin_to"), "count"))


def weather_share(df: DataFrame) -> DataFrame:
    """Share of rows per weather label, percent to one decimal."""
    counts = (df.where(F.col("weather_main").isNotNull()).groupBy(F.col("weather_main").alias("weather"))
              .agg(F.count(F.lit(1)).alias("count")))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("_t", total).select(
        "weather", "count", pct_1dp("count", "_t").alias("pct"))
