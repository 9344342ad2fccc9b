"""Data-quality profiles from stored daily sketches.

One pass over new rows makes one row per day: row and missing counts, a
HyperLogLog sketch of every column's values and a KLL quantile sketch of every
numeric one.  These rows are written once; the profile of any range of days merges
them and reads no observation again.  Sketches have a fixed size, so a day's row
does not grow with the day, and a hot day is absorbed by the partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the HyperLogLog registers: a relative standard error of 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Size of the quantile sketches: ranks are off by about 0.7 % at most.
KLL_K = 400
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def daily_sketches(df: DataFrame, cols, time_col: str = "date_time") -> DataFrame:
    """One row per day (null times: a null day) with ``n`` and, per column, missing count and sketches.

    Null values are missing; NaN counts as a value but is in no quantile sketch.
    """
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__missing"),
                 F.hll_sketch_agg(F.col(c).cast("string"), LG_K).alias(f"{c}__distinct")]
        if types[c] in NUMERIC:
            value = F.col(c).cast("double")
            aggs.append(F.kll_sketch_agg_double(F.when(~F.isnan(value), value), KLL_K).alias(f"{c}__ranks"))
    return df.groupBy(F.to_date(time_col).alias("day")).agg(*aggs)


def merged_profile(sketches: DataFrame, cols, first: str | None = None, last: str | None = None) -> DataFrame:
    """Per column over the days ``first`` to ``last``: n, missing, n_distinct, q1, median, q3.

    Quartiles are null for columns without a quantile sketch, and where no value was seen.
    """
    days = sketches
    if first is not None:
        days = days.where(F.col("day") >= F.to_date(F.lit(first)))
    if last is not None:
        days = days.where(F.col("day") <= F.to_date(F.lit(last)))
    ranked = [c for c in cols if f"{c}__ranks" in sketches.columns]
    aggs = [F.coalesce(F.sum("n"), F.lit(0)).alias("n")]
    for c in cols:
        aggs += [F.coalesce(F.sum(f"{c}__missing"), F.lit(0)).alias(f"{c}__missing"),
                 F.hll_sketch_estimate(F.hll_union_agg(f"{c}__distinct")).alias(f"{c}__distinct")]
    aggs += [F.kll_merge_agg_double(f"{c}__ranks", KLL_K).alias(f"{c}__ranks") for c in ranked]
    one = days.agg(*aggs)
    names = ("q1", "median", "q3")

    def quartiles(c: str):
        if c not in ranked:
            return [F.lit(None).cast("double").alias(q) for q in names]
        held = F.coalesce(F.kll_sketch_get_n_double(f"{c}__ranks"), F.lit(0)) > 0
        return [F.when(held, F.kll_sketch_get_quantile_double(f"{c}__ranks", F.lit(p))).alias(q)
                for q, p in zip(names, (0.25, 0.5, 0.75), strict=True)]

    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n"), F.col(f"{c}__missing").alias("missing"),
                     F.coalesce(f"{c}__distinct", F.lit(0)).alias("n_distinct"), *quartiles(c)) for c in cols]
    return one.select(F.inline(F.array(*rows)))
