"""Profile queries over observations.

Each profile is a partial/final hash aggregate on a tiny key space (hour,
dow, month, level...), so the shuffle carries at most a few hundred rows per
map task regardless of input size; a hot key is absorbed by the map-side
partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.functions import levels as L

V = "traffic_volume"


def _mean_int(col: str = V):
    """pandas ``mean().round().astype(int)``: half-even to an integer."""
    return F.bround(F.avg(col)).cast("bigint")


def pct_1dp_of(count, total):
    """Exact half-even percentage with one decimal (integer arithmetic, R11)."""
    num, n = count.cast("bigint") * 1000, total.cast("bigint")
    r = F.pmod(num, n)
    q = ((num - r) / n).cast("bigint")
    up = (2 * r > n) | ((2 * r == n) & (q % 2 == 1))
    return (q + F.when(up, 1).otherwise(0)) / 10.0


def pct_1dp(count_col, total_col):
    return pct_1dp_of(F.col(count_col), F.col(total_col))


def totals(df: DataFrame) -> DataFrame:
    """A1: truncated mean volume and row count."""
    return df.agg(F.avg(V).cast("bigint").alias("avg_volume"),
                  F.count(F.lit(1)).alias("total_records"))


def hourly_means(df: DataFrame) -> DataFrame:
    return (df.where(F.col("hour").isNotNull())
            .groupBy("hour").agg(F.avg(V).alias("mean_volume")))


def hourly_profile(df: DataFrame) -> DataFrame:
    """A2: mean volume per hour, rounded half-even; hours present only."""
    return df.where(F.col("hour").isNotNull()).groupBy("hour").agg(_mean_int().alias("avg_volume"))


def peak_hour(df: DataFrame) -> DataFrame:
    """A3: hour with the highest mean (lowest hour wins ties), truncated mean."""
    return (hourly_means(df).orderBy(F.desc("mean_volume"), F.asc("hour")).limit(1)
            .select(F.col("hour").alias("peak_hour"),
                    F.col("mean_volume").cast("bigint").alias("peak_volume")))


def congestion_distribution(df: DataFrame) -> DataFrame:
    """A4: share of rows per congestion level, percent to one decimal."""
    counts = df.groupBy(L.level(V).alias("level")).agg(F.count(F.lit(1)).alias("count"))
    # levels partition the rows, so the total is the sum of the (<= 5) counts
    total = counts.agg(F.sum("count")).scalar()
    return (counts.withColumn("total", total)
            .select("level", "count", pct_1dp("count", "total").alias("pct")))


def overview(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """A5: the overview record in one row, from one scan.

    One ``groupBy(hour, level)`` leaves at most 25 x 5 rows of count and sum; the
    hourly list, the peak, the totals and the level shares are all taken from
    those.  A missing volume has no level: it counts as a record, under no level.
    """
    cells = df.groupBy("hour", L.level(V).alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.count(V).alias("c"), F.sum(V).alias("s"))
    # one pair of entries per cell: the same rows summed by hour and by level
    side = F.explode(F.array(
        F.struct(F.lit("hour").alias("kind"), F.col("hour").cast("string").alias("key")),
        F.struct(F.lit("level").alias("kind"), F.col("level").alias("key"))))
    rolled = cells.select(side.alias("k"), "n", "c", "s").groupBy("k.kind", "k.key").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    hour = (F.col("kind") == "hour") & F.col("key").isNotNull() & (F.col("c") > 0)
    level = F.col("kind") == "level"
    mean = F.col("s") / F.col("c")
    hours = F.sort_array(F.collect_list(F.when(hour, F.struct(F.col("key").cast("int").alias("hour"),
                                                              mean.alias("mean_volume")))))
    flat = rolled.agg(
        hours.alias("hours"),
        F.collect_list(F.when(level & F.col("key").isNotNull(), F.struct("key", "n"))).alias("levels"),
        F.sum(F.when(level, F.col("n"))).alias("total_records"),
        F.sum(F.when(level, F.col("c"))).alias("_c"), F.sum(F.when(level, F.col("s"))).alias("_s"))
    peak = F.element_at(F.array_sort("hours", lambda a, b: F.when(a["mean_volume"] > b["mean_volume"], -1)
                                     .when(a["mean_volume"] < b["mean_volume"], 1)
                                     .otherwise(a["hour"] - b["hour"])), 1)
    shares = F.transform("levels", lambda x: F.struct(x["key"], pct_1dp_of(x["n"], F.col("total_records"))))
    out = flat.withColumn("_peak", F.when(F.size("hours") > 0, peak)).select(
        F.transform("hours", lambda s: F.bround(s["mean_volume"]).cast("bigint")).alias("hourly_avg"),
        F.col("_peak.hour").alias("peak_hour"), F.col("_peak.mean_volume").cast("bigint").alias("peak_volume"),
        F.try_divide("_s", "_c").cast("bigint").alias("avg_volume"),
        F.coalesce("total_records", F.lit(0)).alias("total_records"),
        F.map_from_entries(F.sort_array(shares)).alias("congestion_dist"))
    if metrics is not None:
        best = metrics.agg(F.max_by(F.struct("R2", "MAE"), F.col("R2")).alias("_b"))
        out = out.select("*", best.select("_b.R2").scalar().alias("model_r2"),
                         best.select("_b.MAE").scalar().alias("model_mae"))
    return out


def heatmap(df: DataFrame) -> DataFrame:
    """Mean volume by (dow, hour), rounded, with level/colour/risk of it."""
    g = df.where(F.col("dow").isNotNull() & F.col("hour").isNotNull()) \
          .groupBy("dow", "hour").agg(_mean_int().alias("volume"))
    return g.select("dow", "hour", "volume", L.level("volume").alias("level"),
                    L.level_color("volume").alias("color"), L.risk("volume").alias("risk"))


def heatmap_grid(df: DataFrame) -> DataFrame:
    """Wide 7 x 24 grid, one row per dow, one column per hour."""
    hours = list(range(24))
    wide = df.where(F.col("dow").isNotNull()).groupBy("dow").pivot("hour", hours).agg(F.avg(V))
    return wide.select("dow", *[F.bround(F.col(str(h))).cast("bigint").alias(str(h)) for h in hours])


def week_profiles(df: DataFrame) -> DataFrame:
    """Hourly means for weekdays and weekends (long form)."""
    return (df.where(F.col("hour").isNotNull())
            .groupBy("is_weekend", "hour").agg(_mean_int().alias("avg_volume")))


def monthly_profile(df: DataFrame) -> DataFrame:
    """A9."""
    return df.where(F.col("month").isNotNull()).groupBy("month").agg(_mean_int().alias("avg_volume"))


def daily_profile(df: DataFrame) -> DataFrame:
    """A10."""
    return df.where(F.col("dow").isNotNull()).groupBy("dow").agg(_mean_int().alias("avg_volume"))


def patterns(df: DataFrame) -> DataFrame:
    """A8+A9+A10 stacked: (profile, key, avg_volume), from one scan.

    The input is aggregated once to (is_weekend, hour, month, dow) cells; each
    cell then adds its count and sum to three of the four profiles.
    """
    cells = (df.groupBy("is_weekend", "hour", "month", "dow")
             .agg(F.sum(V).alias("s"), F.count(V).alias("c")))
    week = F.when(F.col("is_weekend") == 0, "weekday").when(F.col("is_weekend") == 1, "weekend")
    parts = F.explode(F.array(*(F.struct(p.alias("profile"), F.col(k).alias("key")) for p, k in (
        (week, "hour"), (F.lit("monthly"), "month"), (F.lit("daily"), "dow")))))
    return (cells.select(parts.alias("p"), "s", "c").select("p.profile", "p.key", "s", "c")
            .where(F.col("profile").isNotNull() & F.col("key").isNotNull())
            .groupBy("profile", "key")
            .agg(F.bround(F.try_divide(F.sum("s"), F.sum("c"))).cast("bigint").alias("avg_volume")))


def by_weather(df: DataFrame) -> DataFrame:
    """Mean (rounded) and count per weather label; null labels dropped."""
    return (df.where(F.col("weather_main").isNotNull())
            .groupBy(F.col("weather_main").alias("weather"))
            .agg(_mean_int().alias("avg_volume"), F.count(F.lit(1)).alias("count")))


def by_temp_bin(df: DataFrame) -> DataFrame:
    """Mean volume per temperature band (right-closed, empty bands absent)."""
    return (df.select(L.temp_bin("temp_c").alias("temp_bin"), V)
            .where(F.col("temp_bin").isNotNull())
            .groupBy("temp_bin").agg(_mean_int().alias("avg_volume")))


def congestion_risk(df: DataFrame) -> DataFrame:
    """Risk of each hour's unrounded mean."""
    return hourly_means(df).select("hour", L.risk("mean_volume").alias("risk"))


def rush_impact(df: DataFrame) -> DataFrame:
    """Mean volume in and out of rush hours."""
    return (df.groupBy("rush_hour")
            .agg(F.bround(F.avg(V), 4).alias("avg_volume"), F.count(F.lit(1)).alias("count")))


def temp_curve(df: DataFrame, step: int = 5) -> DataFrame:
    """Mean volume per temperature step (left-closed [t, t+step))."""
    return (df.where(F.col("temp_c").isNotNull())
            .groupBy((F.floor(F.col("temp_c") / step) * step).cast("int").alias("temp_from"))
            .agg(F.bround(F.avg(V), 4).alias("avg_volume"), F.count(F.lit(1)).alias("count")))


def ratios(df: DataFrame) -> DataFrame:
    """weekday/weekend mean ratio and max/min ratio of hourly means, from
    one scan aggregated to (is_weekend, hour) cells."""
    cells = df.groupBy("is_weekend", "hour").agg(F.sum(V).alias("s"), F.count(V).alias("c"))

    def part(is_weekend: int):
        rows = F.col("is_weekend") == is_weekend
        return F.sum(F.when(rows, F.col("s"))), F.sum(F.when(rows, F.col("c")))

    by_hour = cells.groupBy("hour").agg(
        F.sum("s").alias("s"), F.sum("c").alias("c"),
        *(x.alias(f"{n}{i}") for i in (0, 1) for n, x in zip("sc", part(i))))
    mean = F.when(F.col("hour").isNotNull(), F.try_divide("s", "c"))
    one = by_hour.agg(F.max(mean).alias("hmax"), F.min(mean).alias("hmin"),
                      *(F.try_divide(F.sum(f"s{i}"), F.sum(f"c{i}")).alias(f"m{i}") for i in (0, 1)))
    return one.select(F.bround(F.try_divide("m0", "m1"), 6).alias("weekday_weekend_ratio"),
                      F.bround(F.try_divide("hmax", "hmin"), 6).alias("peak_valley_ratio"))


def window_means(df: DataFrame) -> DataFrame:
    """Mean volume in the named windows (morning rush, evening rush, night)."""
    return (df.select(L.window_name("hour").alias("window_name"), V)
            .where(F.col("window_name").isNotNull())
            .groupBy("window_name").agg(F.bround(F.avg(V), 4).alias("avg_volume"),
                                   F.count(F.lit(1)).alias("count")))


def peak_windows(df: DataFrame, k: int = 6) -> DataFrame:
    """Top-k hours by mean (ties → lower hour); level/risk of the unrounded
    mean, volume truncated.  ``limit`` after ``orderBy`` plans as a
    TakeOrderedAndProject (per-partition top-k, then merge)."""
    top = hourly_means(df).orderBy(F.desc("mean_volume"), F.asc("hour")).limit(k)
    return top.select("hour", F.col("mean_volume").cast("bigint").alias("volume"),
                      L.level("mean_volume").alias("level"),
                      L.level_color("mean_volume").alias("color"),
                      L.risk("mean_volume").alias("risk"))


def hour_circle(df: DataFrame) -> DataFrame:
    """F10 view: each hour's mean volume placed on the 24-hour circle."""
    import math
    hm = hourly_means(df)
    angle = F.lit(2 * math.pi) * F.col("hour") / 24
    return hm.select("hour", F.bround(F.sin(angle), 9).alias("x"), F.bround(F.cos(angle), 9).alias("y"),
                     F.bround("mean_volume").cast("bigint").alias("avg_volume"))
