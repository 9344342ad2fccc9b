"""k-nearest-neighbour regression (J5): exact with cell pruning, and an index that grows with the rows.

Rows of equal features are searched once: train rows become sites, of which only the
``k`` smallest ids can be neighbours, and queries of equal features share one answer.

Sites belong to the nearest of at most ``CELLS`` centres, or the square root of the
sites if that is more (a hash-chosen sample of them).  Every cell has a radius and a
count.  A query's ``k``-th distance within its own cell, or else the cells nearest by
their far side, give an upper bound; a cell whose near side lies beyond that bound cannot
hold a neighbour and is not visited.  A query is sent to the cells left, so what is
shuffled grows with the queries and the sites, not with their product.

Cells with many train or query rows are cut into blocks of at most
``block_rows``, and every (train block, query block) pair of a cell is a group of
its own.  Inside a group one matrix product finds the train rows that may be among a
query's ``k`` nearest; of those alone a NumPy kernel computes the exact squared
Euclidean distances (summed feature by feature, left to right) and keeps the
``k`` best by (distance, train id).  Distances are compared
to ``DIGITS`` places, so that engines which differ in the last bits agree.  Only
candidates leave the task; the final top-k per query is taken over at most ``k``
rows a visited block.  No candidate is capped.  Steps that compute distances are dealt
out by the number of these, as few bytes may make many.

The index (``knn_index_candidates``) has as many cells as the square root of the
sites, under as many roots as the square root of the cells.  A site goes to the
nearest cell below its nearest roots, a query to its ``probes`` nearest ones, so
neither is compared with all centres and the shuffle grows with the queries times
``probes``.  A query whose cells hold fewer than ``k`` rows is answered exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow.operators.scaling import apply_scaler, fit_scaler, fitted_values
from roadflow.session import cut_lineage

CAND_SCHEMA = "qid long, tid long, dist double, y double"
#: Centres, at least where there are as many sites: what the driver and every task hold of them.
CELLS = 256
#: Roots below which the index looks for cells, and cells that a query visits.
ROOT_PROBES, PROBES = 4, 12
#: Distances that a task computes, about.
TASK_DISTANCES = 250_000_000
#: Decimal places to which squared distances are compared.
DIGITS = 6


def _topk_kernel(cols, k, batch=128):
    """Exact top-k by (distance, train id), vectorised per query batch.

    A product gives all distances up to rounding; what lies within the ``k``-th of
    them plus a margin above that rounding is computed again, exactly, and ranked.
    """
    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"qid": [], "tid": [], "dist": [], "y": []})
        t = t.sort_values("_tid", kind="stable")
        xq, xt = q[cols].to_numpy(np.float64), t[cols].to_numpy(np.float64)
        tid, ty, qid = t["_tid"].to_numpy(np.int64), t["_y"].to_numpy(np.float64), q["_qid"].to_numpy(np.int64)
        kk = min(k, len(tid))
        middle = xt.mean(0)
        mq, mt = xq - middle, xt - middle
        sq, st = (mq * mq).sum(1), (mt * mt).sum(1)
        margin = 2 * 10.0 ** -DIGITS + 1e-11 * (sq.max() + st.max())
        parts = []
        for s in range(0, len(qid), batch):
            near = sq[s:s + batch, None] + st[None, :] - 2 * mq[s:s + batch] @ mt.T
            kth = np.partition(near, kk - 1, axis=1)[:, kk - 1:kk]
            r, c = np.nonzero(near <= kth + margin)
            d = np.zeros(len(r))
            for a, b in zip(xq[s:s + batch].T, xt.T, strict=True):   # same left-to-right sum as the SQL oracle
                d += (a[r] - b[c]) ** 2
            d = np.round(d, DIGITS)
            order = np.lexsort((c, d, r))  # columns are in id order
            r, c, d = r[order], c[order], d[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < kk
            parts.append(pd.DataFrame({"qid": qid[s + r[keep]], "tid": tid[c[keep]], "dist": d[keep], "y": ty[c[keep]]}))
        return pd.concat(parts, ignore_index=True)
    return run


def _centre_distances(batch: pa.RecordBatch, cols, centres: np.ndarray) -> np.ndarray:
    """Rows x centres Euclidean distances."""
    x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols])
    square = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


#: Rounding of distances found through products; bounds give way by this much.
SLACK = 1e-5


def _assign(cols, centres: np.ndarray):
    """Adds the cell of every train row and its distance to the centre."""
    def run(batches):
        for batch in batches:
            d = _centre_distances(batch, cols, centres)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])],
                [*batch.schema.names, "_cell", "_dist"])
    return run


def _visit(cols, centres: np.ndarray, radius: np.ndarray, count: np.ndarray, k: int):
    """One row per query and cell that may hold one of its ``k`` nearest; ``_reach`` is a known bound on them."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                d = _centre_distances(part, cols, centres)
                far = np.where(count > 0, d + radius, np.inf)
                order = far.argsort(1, kind="stable")
                held = np.cumsum(count[order], 1)
                last = np.minimum((held < k).sum(1), len(count) - 1)
                bound = np.take_along_axis(far, np.take_along_axis(order, last[:, None], 1), 1)
                bound = np.where(held[:, -1:] < k, np.inf, bound)  # fewer train rows than k: all cells
                reach = part.column("_reach").to_numpy(zero_copy_only=False).astype(np.float64)
                bound = np.fmin(bound, reach[:, None])
                near = np.maximum(d - radius, 0)
                rows, cells = np.nonzero((near <= bound + SLACK) & (count > 0))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(rows)) for c in part.columns), pa.array(cells, pa.int32())],
                    [*part.schema.names, "_cell"])
    return run


def _dealt(df: DataFrame, distances: int, *keys: str) -> DataFrame:
    """Rows spread by ``keys`` over as many tasks as so many distances take; AQE would merge them by their bytes."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, math.ceil(distances / TASK_DISTANCES)), *keys)


def _with_cell(df: DataFrame, run, *more: T.StructField) -> DataFrame:
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType()), *more]))


def _exact(sites: DataFrame, asked: DataFrame, cols, k: int, block_rows: int, cells: int | None = None) -> DataFrame:
    """Exact ``k`` nearest sites of every asked vector, by (distance, site)."""
    n, m = sites.count(), asked.count()
    cells = cells or max(CELLS, math.isqrt(n))
    centres = _sample(sites, cols, cells)
    if not len(centres):
        return asked.sparkSession.createDataFrame([], CAND_SCHEMA + ", rank int")
    away = T.StructField("_dist", T.DoubleType())
    sites, asked = _dealt(sites, n * len(centres), "_tid"), _dealt(asked, m * len(centres), "_qid")
    t = cut_lineage(_with_cell(sites, _assign(cols, centres), away))
    stats = t.groupBy("_cell").agg(F.max("_dist").alias("r"), F.count(F.lit(1)).alias("n")).collect()
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in stats:  # one row per cell
        radius[r["_cell"]], count[r["_cell"]] = r["r"], r["n"]
    t = t.drop("_dist")
    # the k-th distance within the nearest cell bounds the search of the others
    own = cut_lineage(_with_cell(asked, _assign(cols, centres), away).drop("_dist"))
    reach = _ranked(t, own, cols, k, count.tolist(), block_rows).where(F.col("rank") == k).select(
        F.col("qid").alias("_qid"), F.sqrt(F.col("dist") + 10.0 ** -DIGITS).alias("_reach"))
    bounded = _dealt(asked.join(reach, "_qid", "left"), m * len(centres), "_qid")
    q = cut_lineage(_with_cell(bounded, _visit(cols, centres, radius, count, k)).drop("_reach"))
    return _ranked(t, q, cols, k, count.tolist(), block_rows)


def _sample(sites: DataFrame, cols, n: int) -> np.ndarray:
    """At most ``n`` sites, chosen by hash."""
    rows = sites.orderBy(F.xxhash64("_tid"), "_tid").limit(n).select(*cols).toPandas()
    return rows.to_numpy(np.float64).reshape(-1, len(cols))


def _sites(train: DataFrame, cols, k: int, y: str, train_id: str) -> DataFrame:
    """Train rows of equal features as one site, named by their smallest id.

    Of a site's rows only the ``k`` with the smallest ids can be among a query's ``k`` nearest.
    """
    rows = train.select(F.col(train_id).cast("long").alias("_tid"), F.col(y).cast("double").alias("_y"),
                        *(F.col(c).cast("double").alias(c) for c in cols))
    place = F.row_number().over(Window.partitionBy(*cols).orderBy("_tid"))
    kept = rows.withColumn("_place", place).where(F.col("_place") <= k).groupBy(*cols).agg(
        F.sort_array(F.collect_list(F.struct("_tid", "_y"))).alias("_rows"))
    return cut_lineage(kept.select(F.col("_rows")[0]["_tid"].alias("_tid"), F.lit(0.0).alias("_y"), *cols, "_rows"))


def _answers(search, train: DataFrame, query: DataFrame, cols, k: int, y: str, train_id: str, query_id: str):
    """Neighbours (_asked, tid, dist, y, rank) of every distinct query vector, and the queries (_qid, _asked).

    Queries of equal features have the same neighbours.  The ``k`` nearest rows lie in the
    ``k`` nearest sites by (distance, smallest id), as every nearer site holds a nearer row.
    """
    sites = _sites(train, cols, k, y, train_id)
    q = query.select(F.col(query_id).cast("long").alias("_qid"), *(F.col(c).cast("double").alias(c) for c in cols))
    asked = cut_lineage(q.groupBy(*cols).agg(F.min("_qid").alias("_qid")))
    found = search(sites.drop("_rows"), asked, sites)
    rows = found.select("qid", "dist", "tid").join(
        sites.select(F.col("_tid").alias("tid"), "_rows"), "tid").select(
        F.col("qid").alias("_asked"), "dist", F.inline("_rows").alias("tid", "y"))
    w = Window.partitionBy("_asked").orderBy("dist", "tid")
    best = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    same = asked.withColumnRenamed("_qid", "_asked")
    return best.select("_asked", "tid", "dist", "y", "rank"), q.join(same, cols).select("_qid", "_asked")


def knn_candidates(train: DataFrame, query: DataFrame, cols, k: int = 10, y: str = "traffic_volume",
                   train_id: str = "row_idx", query_id: str = "row_idx", block_rows: int = 20000,
                   cells: int | None = None) -> DataFrame:
    """Exact k nearest train rows of every query row: (qid, tid, dist, y, rank)."""
    cols = list(cols)
    best, q = _answers(lambda t, asked, _: _exact(t, asked, cols, k, block_rows, cells),
                       train, query, cols, k, y, train_id, query_id)
    return _per_query(best, q)


def _per_query(best: DataFrame, q: DataFrame) -> DataFrame:
    return q.join(best, "_asked").select(F.col("_qid").alias("qid"), "tid", "dist", "y", "rank")


def _ranked(t: DataFrame, q: DataFrame, cols, k: int, count: list[int], block_rows: int) -> DataFrame:
    """The ``k`` best rows of the visited cells per query; ``count`` has the train rows of every cell."""
    asked = {r["_cell"]: r["n"] for r in q.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    def blocks(numbers) -> Column:
        """Blocks of each row's cell: only cells of more than one block stand in the plan."""
        many = [(c, math.ceil(n / block_rows)) for c, n in enumerate(numbers) if n > block_rows]
        if not many:
            return F.lit(1)
        known = F.create_map(*(F.lit(v) for pair in many for v in pair))
        return F.coalesce(F.element_at(known, F.col("_cell")), F.lit(1))

    tb, qb = blocks(count), blocks([asked.get(c, 0) for c in range(len(count))])
    t = t.withColumn("_tb", F.pmod(F.xxhash64("_tid"), tb).cast("int")).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), qb - 1)))
    q = q.withColumn("_qb", F.pmod(F.xxhash64("_qid"), qb).cast("int")).withColumn(
        "_tb", F.explode(F.sequence(F.lit(0), tb - 1)))
    group = ["_cell", "_tb", "_qb"]
    distances = sum(n * asked.get(c, 0) for c, n in enumerate(count))
    q, t = _dealt(q, distances, *group), _dealt(t, distances, *group)
    cand = q.groupBy(*group).cogroup(t.groupBy(*group)).applyInPandas(_topk_kernel(cols, k), CAND_SCHEMA)
    w = Window.partitionBy("qid").orderBy("dist", "tid")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class CellTree:
    """Centres below roots; finds the centres nearest to rows without comparing with all of them."""

    def __init__(self, rows: np.ndarray):
        self.centres = np.unique(rows, axis=0)
        n = len(self.centres)
        picked = np.random.default_rng(7).permutation(n)[:math.isqrt(n - 1) + 1]
        self.roots = self.centres[picked]
        mine = np.concatenate([self.distances(self.centres[s:s + 4096], self.roots).argmin(1)
                               for s in range(0, n, 4096)])
        self.members = [np.flatnonzero(mine == r) for r in range(len(picked))]

    @staticmethod
    def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return (x * x).sum(1)[:, None] - 2 * x @ to.T + (to * to).sum(1)[None, :]

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Rows x ``probes`` cells, nearest first; -1 where the roots looked at have fewer."""
        roots = min(len(self.roots), max(ROOT_PROBES, probes))
        looked = np.argpartition(self.distances(x, self.roots), roots - 1, axis=1)[:, :roots]
        best = np.full((len(x), probes), np.inf)
        cell = np.full((len(x), probes), -1)
        for r, members in enumerate(self.members):
            at = np.flatnonzero((looked == r).any(1))
            d = np.hstack([best[at], self.distances(x[at], self.centres[members])])
            c = np.hstack([cell[at], np.broadcast_to(members, (len(at), len(members)))])
            order = d.argsort(1, kind="stable")[:, :probes]
            best[at], cell[at] = np.take_along_axis(d, order, 1), np.take_along_axis(c, order, 1)
        return cell


def _to_cells(cols, tree: CellTree, probes: int):
    """One row per row and cell that it goes to."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in cols])
                cells = tree.nearest(x, probes)
                rows, place = np.nonzero(cells >= 0)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(rows)) for c in part.columns), pa.array(cells[rows, place], pa.int32())],
                    [*part.schema.names, "_cell"])
    return run


def _indexed(k: int, cols, block_rows: int, probes: int):
    """Search of the nearest sites through the index; vectors whose cells hold under ``k`` rows are answered exactly."""
    def search(t: DataFrame, asked: DataFrame, sites: DataFrame) -> DataFrame:
        n = t.count()
        if not n:
            return asked.sparkSession.createDataFrame([], CAND_SCHEMA + ", rank int")
        tree = CellTree(_sample(t, cols, math.isqrt(n - 1) + 1))
        near = 2 * PROBES * math.isqrt(len(tree.centres))  # roots, and centres below those looked at
        tc = cut_lineage(_with_cell(_dealt(t, n * near, "_tid"), _to_cells(cols, tree, 1)))
        count = [0] * len(tree.centres)
        for r in tc.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per cell
            count[r["_cell"]] = r["n"]
        visits = cut_lineage(_with_cell(_dealt(asked, asked.count() * near, "_qid"), _to_cells(cols, tree, probes)))
        found = cut_lineage(_ranked(tc, visits, cols, k, count, block_rows))
        held = sites.select(F.col("_tid").alias("tid"), F.size("_rows").alias("held"))
        least = min(k, sites.agg(F.sum(F.size("_rows").cast("long"))).first()[0])
        full = found.join(held, "tid").groupBy(F.col("qid").alias("_qid")).agg(F.sum("held").alias("held")).where(
            F.col("held") >= least).select("_qid")
        short = cut_lineage(asked.join(full, "_qid", "left_anti"))
        if short.isEmpty():
            return found
        rest = _exact(t, short, cols, k, block_rows)
        return found.join(full.withColumnRenamed("_qid", "qid"), "qid", "left_semi").unionByName(rest)
    return search


def knn_index_candidates(train: DataFrame, query: DataFrame, cols, k: int = 10, y: str = "traffic_volume",
                         train_id: str = "row_idx", query_id: str = "row_idx", block_rows: int = 20000,
                         probes: int = PROBES) -> DataFrame:
    """Approximate k nearest train rows of every query row: (qid, tid, dist, y, rank).

    Every train row is indexed with its site; only the centres, the square root of the
    sites in number, pass through the driver.
    """
    cols = list(cols)
    return _per_query(*_answers(_indexed(k, cols, block_rows, probes), train, query, cols, k, y, train_id, query_id))


def knn_predict(train: DataFrame, query: DataFrame, cols, k: int = 10, y: str = "traffic_volume",
                train_id: str = "row_idx", query_id: str = "row_idx", scale: bool = False,
                block_rows: int = 20000, index: bool = False) -> DataFrame:
    """Mean target of the ``k`` nearest train rows (Euclidean distance;
    ties broken by train id).  ``scale`` standardises features with train
    mean / population std first, as the reference does.  ``index`` takes the
    neighbours from the index instead of the exact search."""
    cols = list(cols)
    if scale:
        stats = fitted_values(fit_scaler(train, cols))
        train, query = apply_scaler(train, stats, cols), apply_scaler(query, stats, cols)
    search = _indexed(k, cols, block_rows, PROBES) if index else (
        lambda t, asked, _: _exact(t, asked, cols, k, block_rows))
    best, q = _answers(search, train, query, cols, k, y, train_id, query_id)
    means = best.groupBy("_asked").agg(F.avg("y").alias("predicted"), F.count(F.lit(1)).alias("neighbours"))
    return q.join(means, "_asked").select(F.col("_qid").alias(query_id), "predicted", "neighbours")
