"""Global order without a single-task window (W3, T1, P9, P10, D1s-D4s).

``with_row_index`` gives every row its 0-based position in a total order:

1. ``repartitionByRange(n, keys)`` - sampled range bounds over the *full*
   composite key, so one hot timestamp is still spread over many tasks;
   an explicit partition count keeps AQE from coalescing these partitions.
2. ``sortWithinPartitions(keys)`` then ``monotonically_increasing_id`` - its
   upper bits are the partition index, its lower 33 bits the local position.
3. per-partition counts → exclusive running sum over at most ``n`` rows →
   broadcast join back (the table has exactly one row per partition).

Both the counts and the rows must come from the *same* shuffle: two separate
range exchanges would sample their bounds with different seeds.  The ranged
frame is therefore persisted (one cached RDD, one ShuffleDependency with a
fixed partitioner, so recomputation after a lost executor reproduces it) or,
with ``checkpoint=True``, written to the shared checkpoint folder.

The keys must be unique (add an id tie-break) for a deterministic index.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadflow.session import cut_lineage

LOCAL_BITS = 33


def _partitions(df: DataFrame, n: int | None) -> int:
    """Range partitions: as many as the session gives any shuffle."""
    return int(n or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_row_index(df: DataFrame, order_cols, num_partitions: int | None = None,
                   name: str = "row_idx", total: str | None = None,
                   checkpoint: bool = False) -> DataFrame:
    """Add a 0-based global row index following ``order_cols``.

    ``total`` optionally names a column carrying the total row count, taken
    from the same per-partition counts (no second scan).
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    n = _partitions(df, num_partitions)
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", LOCAL_BITS))
    if checkpoint:
        ranged = cut_lineage(ranged)
    else:
        ranged = ranged.persist(StorageLevel.MEMORY_AND_DISK)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy()).alias("_total"))
    out = ranged.join(F.broadcast(offsets), "_pid")
    local = F.col("_mid") - F.shiftleft(F.col("_pid"), LOCAL_BITS)
    out = out.withColumn(name, F.col("_off") + local)
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_mid", "_pid", "_off", "_total")


def order_by_time(df: DataFrame, ts: str = "date_time", tie: str = "obs_id") -> DataFrame:
    """Total order by time with a unique tie-break (range-partitioned sort)."""
    return df.orderBy(F.col(ts).asc(), F.col(tie).asc())


def time_index(df: DataFrame, ts: str = "date_time", tie: str = "obs_id",
               total: str | None = None) -> DataFrame:
    return with_row_index(df, [ts, tie], total=total)


def _cut(total: Column, frac: float) -> Column:
    """Python ``int(n * frac)``: double product, truncated."""
    return F.floor(total.cast("double") * F.lit(float(frac))).cast("bigint")


def keys_at(df: DataFrame, order: list[str], bucket: Column, positions) -> list:
    """The key rows at given places of the total order ``order``, without sorting ``df``.

    ``bucket`` is a coarse column that sorts as ``order`` does and takes few
    values.  Rows are counted by bucket (a partial aggregate), a running count
    over the buckets finds those that hold the wanted places, and only the keys
    of these are ordered.  ``positions(n)`` gives the places for ``n`` rows; a
    place at or beyond the end gives ``None``.  Rows reach the driver one a place.
    """
    keys = df.select(*order, bucket.alias("_bucket"))
    counts = cut_lineage(keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c")))
    n = counts.agg(F.sum("_c")).first()[0] or 0
    w = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    running = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    found = []
    for place in positions(n):
        hit = running.where((F.col("_before") <= place) & (place < F.col("_before") + F.col("_c"))).first()
        if hit is None:
            found.append(None)
            continue
        inside = keys.where(F.col("_bucket").eqNullSafe(F.lit(hit["_bucket"]))).select(*order)
        ranked = with_row_index(inside, order, name="_place", checkpoint=True)
        found.append(ranked.where(F.col("_place") == place - hit["_before"]).select(*order).first())
    return found


def before_key(order: list[str], key) -> Column:
    """Whether a row comes before ``key`` in the order (ascending, nulls first); all do before ``None``."""
    if key is None:
        return F.lit(True)
    out = F.lit(False)
    for c in reversed(order):
        col, at = F.col(c), F.lit(key[c])
        if key[c] is None:
            out = col.isNull() & out
        else:
            out = col.isNull() | (col < at) | ((col == at) & out)
    return out


def chrono_split(df: DataFrame, cuts=(0.8,), labels=("train", "test"),
                 ts: str = "date_time", tie: str = "obs_id", with_index: bool = True) -> DataFrame:
    """D1s/D2s: chronological split at cumulative fractions ``cuts``.

    ``cuts=(0.8,)`` → 80/20; ``cuts=(0.7, 0.85)`` with three labels → 70/15/15.
    Adds ``split``, and ``row_idx`` if asked for.  Without the index no row moves:
    the keys at the cuts are found by counting days, and the split is a
    comparison with them.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one label more than cuts")
    if with_index:
        idx = time_index(df, ts, tie, total="_n")
        conds = [F.col("row_idx") < _cut(F.col("_n"), c) for c in cuts]
    else:
        idx = df
        found = keys_at(df, [ts, tie], F.date_trunc("DAY", F.col(ts)), lambda n: [int(n * c) for c in cuts])
        conds = [before_key([ts, tie], k) for k in found]
    expr = F.lit(labels[-1])
    for cond, lab in reversed(list(zip(conds, labels))):
        expr = F.when(cond, F.lit(lab)).otherwise(expr)
    return idx.withColumn("split", expr).drop("_n")


#: Leading hex digits of a hash that name its bucket.
HASH_DIGITS = 3


def random_split(df: DataFrame, test_frac: float = 0.2, seed: int = 42,
                 key: str = "obs_id") -> DataFrame:
    """D3s: seeded random split with exact sizes (test = ceil(frac * n)).

    Rows are ordered by ``md5(seed || key)`` - reproducible in any engine -
    and the first ``ceil(frac*n)`` positions form the test split.  The hash at
    that place is found by counting hash prefixes, so no row moves.
    """
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    hashed = df.withColumn("_h", h)
    (cut,) = keys_at(hashed, ["_h", key], F.substring("_h", 1, HASH_DIGITS),
                     lambda n: [math.ceil(float(n) * test_frac)])
    return hashed.withColumn("split", F.when(before_key(["_h", key], cut), F.lit("test"))
                             .otherwise(F.lit("train"))).drop("_h")


def systematic_sample(df: DataFrame, k: int = 20, idx: str = "row_idx",
                      total: str | None = None) -> DataFrame:
    """Every ``n//k``-th row, first ``k`` of them (step at least 1).

    ``idx`` must be a dense 0-based index of ``df``; ``total`` a column with n
    (computed with a one-row aggregate when absent).
    """
    n = F.col(total) if total else df.agg(F.count(F.lit(1))).scalar()
    step = F.greatest(F.floor(n / k), F.lit(1)).cast("bigint")
    return df.where((F.col(idx) % step == 0) & (F.col(idx) < step * k))


def head_rows(df: DataFrame, n: int, idx: str = "row_idx") -> DataFrame:
    """P10: first ``n`` rows of the index order (a filter, no sort, no limit)."""
    return df.where(F.col(idx) < n)


def split_sizes(n: int, cuts=(0.8,)) -> list[int]:
    """Sizes of a chronological split of ``n`` rows (driver arithmetic)."""
    edges = [0] + [int(n * c) for c in cuts] + [n]
    return [b - a for a, b in zip(edges[:-1], edges[1:])]


def random_test_size(n: int, frac: float = 0.2) -> int:
    return int(math.ceil(n * frac))


def split_report(df: DataFrame, split: str = "split", ts: str = "date_time",
                 y: str = "traffic_volume") -> DataFrame:
    """Rows, first/last time and target range per split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        F.min(y).alias("min_volume"), F.max(y).alias("max_volume"))
