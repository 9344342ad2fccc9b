"""Forests without a depth limit: extremely randomised trees (M6) and bagged best-split trees (M5).

Extremely randomised: every (node, feature) draws one threshold between the node's
least and largest value; the feature whose threshold lowers the squared error most
splits the node.  Bagged: rows are drawn with repetition, and each node takes the best
threshold of all features, midway between neighbouring values.  Both grow until a
node's labels are equal, or no feature splits it.

Growth is handed over by node size.  While a node holds more than ``HANDOVER`` rows,
the level is one pair of grouped aggregates over all big nodes of all trees: extremes
and counts first, then what lies below each drawn threshold (bagged: below each of a
few quantiles).  A smaller node moves to one task with its rows, which grows the whole
subtree, all its nodes of a level at once in NumPy: depth costs no job.  Nodes stay in
a written table, one row a subtree; nothing of them passes through the driver.

To predict, trees are dealt to tasks and the rows stream past each task's trees; sums
and counts are added per row.

Draws are arithmetic hashes of (tree, path, feature) or (tree, row number), so neither
partitioning nor the place of growth changes a tree; repeats of a row are Poisson.

Defined results: null features count as -1e300, below all others;
rows with a null label are left out; no row predicts null; ties go to the first feature.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.operators.histboost import PRIME, draw
from roadflow.session import cut_lineage, ensure_checkpoint_dir

#: Rows of a node that one task grows further.
HANDOVER = 250_000
#: Thresholds that a big node of a bagged tree tries per feature.
QUANTILES = 16
MISSING = -1e300
#: Cumulative Poisson(1) shares: how often a row is drawn.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
           0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


@dataclass(frozen=True)
class ForestParams:
    trees: int = 200
    random: bool = True      # thresholds drawn; else best thresholds on drawn rows
    seed: int = 42


def child(path, side: int):
    """Seed of a child's draws; works on Columns and on arrays."""
    return draw(path, path * 0 + side)


def repeats(tree, row):
    """How often a tree draws a row, as a Column."""
    u = draw(tree + 1000, row)
    return sum((u >= int(share * PRIME)).cast("long") for share in POISSON)


def packed(train: DataFrame, cols, y: str, row: str) -> DataFrame:
    """(number, y, x0...): doubles, no nulls."""
    values = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(MISSING)), F.lit(MISSING)).alias(f"x{i}")
              for i, c in enumerate(cols)]
    return train.filter(F.col(y).isNotNull()).select(F.col(row).cast("long").alias("number"),
                                                     F.col(y).cast("double").alias("y"), *values)


def random_splits(x, wy, w, starts, lens, paths) -> tuple[np.ndarray, np.ndarray]:
    """(feature or -1, threshold) of every node; rows of a node lie together.  ``wy``: weighted labels."""
    low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    share = np.stack([draw(paths, np.full(len(paths), 3 + f)) for f in range(x.shape[1])], 1) / PRIME
    cut = low + share * (high - low)
    below = x <= np.repeat(cut, lens, axis=0)
    n_low = np.add.reduceat(below * w[:, None], starts)
    s_low = np.add.reduceat(below * wy[:, None], starts)
    n, s = np.add.reduceat(w, starts)[:, None], np.add.reduceat(wy, starts)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = s_low ** 2 / n_low + (s - s_low) ** 2 / (n - n_low) - s ** 2 / n
    score = np.where((low < high) & (n_low > 0) & (n_low < n), score, -np.inf)
    feature = first_best(score)
    return feature, cut[np.arange(len(cut)), feature]


def first_best(score: np.ndarray) -> np.ndarray:
    """First feature of the best score, up to rounding; -1 if none is possible."""
    top = score.max(1)
    near = score >= (top - np.abs(top) * 1e-12)[:, None]
    return np.where(np.isfinite(top), np.argmax(near, axis=1), -1)


@dataclass
class Ranked:
    """Columns as ranks of their distinct values; columns of one value, or in the order of an earlier one, never split."""
    columns: np.ndarray
    ranks: np.ndarray
    values: list[np.ndarray]

    @classmethod
    def of(cls, x: np.ndarray) -> Ranked:
        kept, ranks, values, met = [], [], [], set()
        for f, column in enumerate(x.T):
            found, rank = np.unique(column, return_inverse=True)
            told = rank.tobytes()
            if len(found) > 1 and told not in met:  # equal scores everywhere: ties go to the first
                met.add(told)
                kept.append(f)
                ranks.append(rank)
                values.append(found)
        return cls(np.array(kept, np.int64), np.array(ranks, np.int64).reshape(len(kept), len(x)), values)

    def chosen(self, rows: np.ndarray) -> Ranked:
        return Ranked(self.columns, self.ranks[:, rows], self.values)


def value_sums(node, rank, many: int, nodes: int, wy, w) -> tuple[np.ndarray, ...]:
    """Node and rank of the distinct (node, rank), in order, with running sums of weights and weighted labels."""
    if nodes * many <= 4 * len(node):
        code = node * many + rank
        weights, sums = np.bincount(code, w, nodes * many), np.bincount(code, wy, nodes * many)
        met = np.flatnonzero(weights)
        return met // many, met % many, np.cumsum(weights[met]), np.cumsum(sums[met])
    bits, wide = len(node).bit_length(), many.bit_length()
    # the row number rides in the sorted word
    word = np.sort((node << (wide + bits)) | (rank << bits) | np.arange(len(node)))
    order = word & ((1 << bits) - 1)
    word >>= bits
    last = np.flatnonzero(np.append(word[1:] != word[:-1], True))
    word = word[last]
    return word >> wide, word & ((1 << wide) - 1), np.cumsum(w[order])[last], np.cumsum(wy[order])[last]


def best_splits(ranked: Ranked, rows, wy, w, starts, lens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, threshold) of every node, the best of all features; also the split column of ``ranked`` and rank."""
    count, node = len(starts), np.repeat(np.arange(len(starts)), lens)
    n, s = np.add.reduceat(w, starts), np.add.reduceat(wy, starts)
    shape = (count, len(ranked.columns))
    scores, cuts, last = np.full(shape, -np.inf), np.zeros(shape), np.zeros(shape, np.int64)
    for f, values in enumerate(ranked.values):
        rank = ranked.ranks[f][rows]
        varies = np.minimum.reduceat(rank, starts) < np.maximum.reduceat(rank, starts)
        these = np.flatnonzero(varies)
        if not len(these):
            continue
        part = (node, rank, wy, w)
        if 4 * lens[these].sum() < 3 * len(rows):
            kept = np.repeat(varies, lens)
            part = (np.repeat(np.arange(len(these)), lens[these]), rank[kept], wy[kept], w[kept])
            at_node, at_rank, n_low, s_low = value_sums(part[0], part[1], len(values), len(these), part[2], part[3])
            at_node = these[at_node]
        else:
            at_node, at_rank, n_low, s_low = value_sums(node, rank, len(values), count, wy, w)
        ends = np.append(at_node[1:] != at_node[:-1], True)
        met, done = at_node[ends], np.flatnonzero(ends)
        base_n, base_s = np.zeros(count), np.zeros(count)  # running sums before each node
        base_n[met[1:]], base_s[met[1:]] = n_low[done[:-1]], s_low[done[:-1]]
        at = np.flatnonzero(~ends)
        where = at_node[at]
        below, above = at_rank[at], at_rank[at + 1]
        n_low, s_low = n_low[at] - base_n[where], s_low[at] - base_s[where]
        score = s_low ** 2 / n_low + (s[where] - s_low) ** 2 / (n[where] - n_low) - s[where] ** 2 / n[where]
        first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
        top = np.full(count, -np.inf)
        top[where[first]] = np.maximum.reduceat(score, first)
        hit = np.flatnonzero(score >= top[where] - np.abs(top[where]) * 1e-12)
        hit = hit[np.append(True, where[hit[1:]] != where[hit[:-1]])]
        split = where[hit]
        low, high = values[below[hit]], values[above[hit]]
        middle = (low + high) / 2
        scores[split, f], last[split, f] = top[split], below[hit]
        cuts[split, f] = np.where(middle < high, middle, low)  # neighbouring doubles have no middle
    best = first_best(scores) if len(ranked.columns) else np.full(count, -1)
    every = np.arange(count)
    if not len(ranked.columns):
        return best, np.zeros(count), best, np.zeros(count, np.int64)
    return np.where(best >= 0, ranked.columns[best], -1), cuts[every, best], best, last[every, best]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, path: int, random: bool) -> dict[str, np.ndarray]:
    """A whole subtree: feature (-1: leaf), cut, left child (right is the next), value."""
    return grow_cells(x, w, w * y, y, y, path, random)


def grow_cells(x, w, wy, low, high, path: int, random: bool, ranked: Ranked | None = None) -> dict[str, np.ndarray]:
    """As :func:`grow`, on cells: rows of equal features with their weight, weighted sum, least and largest label.

    ``ranked``: the ranks of ``x``, where they are known.
    """
    ranked = None if random else ranked or Ranked.of(x)
    rows, ids, paths = np.arange(len(w)), np.zeros(1, np.int64), np.array([path], np.int64)
    lens, made = np.array([len(w)]), 1
    all_feature, all_cut = np.full(1, -1, np.int64), np.zeros(1)
    all_left, all_value = np.full(1, -1, np.int64), np.zeros(1)
    while len(ids):
        starts = np.cumsum(lens) - lens
        sums, ws = wy[rows], w[rows]
        all_value[ids] = np.add.reduceat(sums, starts) / np.add.reduceat(ws, starts)
        mixed = np.minimum.reduceat(low[rows], starts) < np.maximum.reduceat(high[rows], starts)
        mixed &= lens > 1  # no threshold parts rows of equal features
        if not mixed.any():
            break
        keep = np.repeat(mixed, lens)
        rows, sums, ws = rows[keep], sums[keep], ws[keep]
        lens, ids, paths = lens[mixed], ids[mixed], paths[mixed]
        starts = np.cumsum(lens) - lens
        if random:
            xs = x[rows]
            f, t = random_splits(xs, sums, ws, starts, lens, paths)
        else:
            f, t, column, rank = best_splits(ranked, rows, sums, ws, starts, lens)
        split = f >= 0
        if not split.any():
            break
        keep = np.repeat(split, lens)
        rows = rows[keep]
        lens, ids, paths, f, t = lens[split], ids[split], paths[split], f[split], t[split]
        node = np.repeat(np.arange(len(ids)), lens)
        if random:
            right = xs[keep][np.arange(len(rows)), f[node]] > t[node]
        else:
            right = ranked.ranks[column[split][node], rows] > rank[split][node]
        all_feature[ids], all_cut[ids] = f, t
        all_left[ids] = made + 2 * np.arange(len(ids))
        slot = 2 * node + right
        bits = len(rows).bit_length()
        rows = rows[np.sort((slot << bits) | np.arange(len(rows))) & ((1 << bits) - 1)]
        lens = np.bincount(slot, minlength=2 * len(ids))
        ids = made + np.arange(2 * len(ids))
        grown = len(ids)
        paths = np.stack([child(paths, 1), child(paths, 2)], 1).ravel() if random else np.zeros(grown, np.int64)
        made += grown
        all_feature = np.append(all_feature, np.full(grown, -1))
        all_cut, all_left = np.append(all_cut, np.zeros(grown)), np.append(all_left, np.full(grown, -1))
        all_value = np.append(all_value, np.zeros(grown))
    return {"feature": all_feature, "cut": all_cut, "left": all_left, "value": all_value}


def evaluate(nodes: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        rows = rows[nodes["feature"][at[rows]] >= 0]
        now = at[rows]
        at[rows] = nodes["left"][now] + (x[rows, nodes["feature"][now]] > nodes["cut"][now])
    return nodes["value"][at]


KINDS = {"feature": np.int16, "cut": np.float64, "left": np.int32, "value": np.float64}


@dataclass
class ForestModel:
    """A table of subtrees (tree, path, feature, cut, left, value) and the splits above them, by path."""
    cols: list[str]
    table: DataFrame
    top: dict[tuple[int, int], tuple[int, float]]
    roots: dict[int, int]

    def transform(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """Rows stream past the trees that a task holds."""
        width, top, roots = len(self.cols), self.top, self.roots
        spark = df.sparkSession
        names = [f"__x{i}" for i in range(width)]
        df = df.withColumns({n: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(MISSING)), F.lit(MISSING))
                             for n, c in zip(names, self.cols, strict=True)})
        # rows of equal features have the same prediction
        kept = cut_lineage(df.select(*names).distinct().withColumn("__row", F.monotonically_increasing_id()))
        tasks = min(max(1, len(roots)), int(spark.conf.get("spark.sql.shuffle.partitions")))
        nothing = [F.lit(None).cast("binary").alias(n) for n in KINDS]
        rows = kept.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(1).alias("kind"),
                           F.col("__row").alias("row"), F.lit(0).cast("long").alias("path"), *nothing,
                           F.array(*names).alias("x"))
        trees = self.table.select((F.col("tree") % tasks).cast("int").alias("task"), F.lit(0).alias("kind"),
                                  F.col("tree").cast("long").alias("row"), "path", *KINDS,
                                  F.lit(None).cast("array<double>").alias("x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, held = None, {}
            for batch in batches:
                tasks_of = batch.column(0).to_numpy()
                for group in np.unique(tasks_of):
                    part = batch.filter(pa.array(tasks_of == group))
                    if group != task:
                        task, held = group, {}
                    is_row = part.column(1).to_numpy() == 1
                    own = part.filter(pa.array(~is_row))
                    for r in own.to_pylist():
                        held[r["row"], r["path"]] = {n: np.frombuffer(r[n], k) for n, k in KINDS.items()}
                    part = part.filter(pa.array(is_row))
                    if not part.num_rows:
                        continue
                    x = part.column("x").flatten().to_numpy().reshape(-1, width)
                    total = np.zeros(len(x))
                    trees = sorted({t for t, _ in held})
                    for tree in trees:
                        places = followed(x, tree, roots[tree], top)
                        for path in np.unique(places):
                            rows = np.nonzero(places == path)[0]
                            total[rows] += evaluate(held[tree, int(path)], x[rows])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row"), pa.array(total), pa.array(np.full(len(x), len(trees)))],
                        ["__row", "__sum", "__n"])

        told = trees.unionByName(rows).repartitionById(tasks, F.col("task")).sortWithinPartitions(
            "task", "kind").mapInArrow(run, "__row long, __sum double, __n long")
        sums = told.groupBy("__row").agg(F.try_divide(F.sum("__sum"), F.sum("__n")).alias(out))
        known = kept.join(sums, "__row", "left").drop("__row")
        return df.join(known, names, "left").drop(*names)


def followed(x: np.ndarray, tree: int, root: int, top: dict) -> np.ndarray:
    """Path of the subtree that each row lies in."""
    at = np.full(len(x), root, np.int64)
    todo = [root]
    while todo:
        path = todo.pop()
        if (tree, path) in top:
            f, t = top[tree, path]
            here = at == path
            low = here & (x[:, f] <= t)
            at[low], at[here & ~low] = child(path, 1), child(path, 2)
            todo += [child(path, 1), child(path, 2)]
    return at


def routed(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``rows`` (tree, path, ...) one level down where ``splits`` (tree, path, feature, cut) has their node."""
    width = sum(c.startswith("x") for c in rows.columns)
    value = F.element_at(F.array(*(F.col(f"x{i}") for i in range(width))), F.col("feature") + 1)
    below = F.when(value <= F.col("cut"), child(F.col("path"), 1)).otherwise(child(F.col("path"), 2))
    return rows.join(splits, ["tree", "path"], "left").withColumn(
        "path", F.when(F.col("feature").isNull(), F.col("path")).otherwise(below)).drop("feature", "cut")


def big_splits(rows: DataFrame, big: DataFrame, width: int, random: bool) -> DataFrame:
    """(tree, path, feature, cut) of big nodes, from two grouped aggregates."""
    part = rows.join(F.broadcast(big), ["tree", "path"])
    shares = [i / (QUANTILES + 1) for i in range(1, QUANTILES + 1)]
    asked = []
    for i in range(width):
        asked += [F.min(f"x{i}").alias(f"a{i}"), F.max(f"x{i}").alias(f"b{i}")]
        if not random:
            asked.append(F.percentile_approx(f"x{i}", shares, 1000).alias(f"q{i}"))
    known = part.groupBy("tree", "path").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"), *asked)
    for i in range(width):
        drawn = F.col(f"a{i}") + draw(F.col("path"), F.col("path") * 0 + 3 + i) / PRIME * (F.col(f"b{i}") - F.col(f"a{i}"))
        known = known.withColumn(f"t{i}", F.array(drawn) if random else F.array_distinct(f"q{i}"))
    known = cut_lineage(known.select("tree", "path", "n", "s", *(f"t{i}" for i in range(width)),
                                     *(F.col(f"b{i}") for i in range(width))))
    met = part.join(F.broadcast(known), ["tree", "path"])
    def tried(i: int):
        return F.transform(f"t{i}", lambda t: F.struct(
            F.lit(i).alias("feature"), t.alias("cut"), (F.col(f"x{i}") <= t).alias("low"),
            (t < F.col(f"b{i}")).alias("splits")))

    each = F.explode(F.flatten(F.array(*map(tried, range(width))))).alias("c")
    sums = met.select("tree", "path", "n", "s", "w", "y", each).filter("c.splits").groupBy(
        "tree", "path", "n", "s", "c.feature", "c.cut").agg(
        F.sum(F.when(F.col("c.low"), F.col("w")).otherwise(0)).alias("nl"),
        F.sum(F.when(F.col("c.low"), F.col("w") * F.col("y")).otherwise(0.0)).alias("sl"))
    score = F.col("sl") ** 2 / F.col("nl") + (F.col("s") - F.col("sl")) ** 2 / (F.col("n") - F.col("nl")) \
        - F.col("s") ** 2 / F.col("n")
    scored = sums.filter("nl > 0 AND nl < n").withColumn("score", score)
    best = F.max_by(F.struct("feature", "cut"), F.struct("score", -F.col("feature"), -F.col("cut"))).alias("b")
    return scored.groupBy("tree", "path").agg(best).select("tree", "path", "b.feature", "b.cut")


def fit_forest(train: DataFrame, params: ForestParams, cols=S.FS18, y: str = S.TARGET,
               row: str = "obs_id") -> ForestModel:
    """Grows the forest; ``row`` names the unique row number that rows are drawn by."""
    spark, cols, width = train.sparkSession, list(cols), len(cols)
    roots = {t: int(draw(params.seed, t)) for t in range(params.trees)}
    base = packed(train, cols, y, row)
    rows = base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(params.trees - 1)))).withColumn(
        "path", draw(F.lit(params.seed), F.col("tree").cast("long")))
    if params.random:
        rows = rows.withColumn("w", F.lit(1).cast("long"))
    else:
        rows = rows.withColumn("w", repeats(F.col("tree").cast("long"), F.col("number"))).filter("w > 0")
    top: dict[tuple[int, int], tuple[int, float]] = {}
    total = base.count()
    names = [f"x{i}" for i in range(width)]
    if 0 < base.select(*names).distinct().count() <= HANDOVER:
        return ForestModel(cols, written(grown_on_cells(base, params, width)), top, roots)
    while total > HANDOVER:
        big = rows.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > HANDOVER)
        big = cut_lineage(big.select("tree", "path"))
        splits = cut_lineage(big_splits(rows, big, width, params.random))
        found = splits.collect()  # at most the rows of all trees over HANDOVER
        if not found:
            break
        top |= {(r.tree, r.path): (r.feature, r.cut) for r in found}
        rows = routed(rows, F.broadcast(splits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def subtree() -> pa.RecordBatch:
            x = np.concatenate([np.stack([p.column(f"x{i}").to_numpy() for i in range(width)], 1) for p in held])
            label, w = (np.concatenate([p.column(c).to_numpy() for p in held]) for c in ("y", "w"))
            made = grow(x, label, w, group[1], random)
            return pa.RecordBatch.from_arrays(
                [pa.array([group[0]], pa.int32()), pa.array([group[1]], pa.int64()),
                 *(pa.array([made[n].astype(k).tobytes()], pa.binary()) for n, k in KINDS.items())],
                ["tree", "path", *KINDS])

        random, group, held = params.random, None, []
        for batch in batches:
            tree, path = batch.column("tree").to_numpy(), batch.column("path").to_numpy()
            cuts = np.nonzero((tree[1:] != tree[:-1]) | (path[1:] != path[:-1]))[0] + 1
            for a, b in zip([0, *cuts], [*cuts, len(tree)]):
                if a == b:
                    continue
                if group != (int(tree[a]), int(path[a])):
                    if held:
                        yield subtree()
                    group, held = (int(tree[a]), int(path[a])), []
                held.append(batch.slice(a, b - a))
        if held:
            yield subtree()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(params.trees, 200))
    made = rows.repartition(tasks, "tree", "path").sortWithinPartitions("tree", "path", "number").mapInArrow(
        run, "tree int, path long, " + ", ".join(f"{n} binary" for n in KINDS))
    return ForestModel(cols, written(made), top, roots if total else {})


def written(made: DataFrame) -> DataFrame:
    """The table of subtrees, in the shared folder."""
    spark = made.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


#: Tasks, at most, that the trees are dealt to where each gets all cells.
DEALT = 100
#: Per cell: weight, weighted sum, least and largest label.
SUMS = ("w", "wy", "low", "high")


def cell_sums(number, y, starts, trees, random: bool) -> dict[str, np.ndarray]:
    """Trees x cells: ``SUMS`` of rows whose cells begin at ``starts``."""
    w = np.ones((1, len(y)), np.int8)
    if not random:
        u = draw(trees[:, None] + 1000, number[None, :])
        w = sum((u >= int(share * PRIME)).view(np.int8) for share in POISSON)
    taken = w > 0
    return {"w": np.add.reduceat(w, starts, 1, np.float64), "wy": np.add.reduceat(w * y, starts, 1),
            "low": np.minimum.reduceat(np.where(taken, y, np.inf), starts, 1),
            "high": np.maximum.reduceat(np.where(taken, y, -np.inf), starts, 1)}


def grown_on_cells(base: DataFrame, params: ForestParams, width: int) -> DataFrame:
    """All trees, where rows of equal features are so few cells that a task can hold them.

    Rows are dealt by their features; a task sums its cells for every tree as the rows
    stream past.  Every task of the second step gets all cells and grows its share of trees.
    """
    random, count, seed = params.random, params.trees, params.seed
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(count, DEALT, max(24, 2 * parts))  # each of them gets all cells
    names = [f"x{i}" for i in range(width)]
    ways = {"w": np.add, "wy": np.add, "low": np.minimum, "high": np.maximum}
    schema = "task int, tree int, part int, x binary, " + ", ".join(f"{n} binary" for n in SUMS)
    fields = [f.split()[0] for f in schema.split(", ")]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sums, part = [], {n: [] for n in SUMS}, None
        trees = np.arange(count)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            x = np.stack([batch.column(n).to_numpy() for n in names], 1)
            starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1)))
            made = cell_sums(batch.column("number").to_numpy(), batch.column("y").to_numpy(), starts, trees, random)
            own = x[starts]
            if cells and (cells[-1][-1] == own[0]).all():  # a cell goes on from the last batch
                for n in SUMS:
                    sums[n][-1][:, -1] = ways[n](sums[n][-1][:, -1], made[n][:, 0])
                own, made = own[1:], {n: made[n][:, 1:] for n in SUMS}
            if len(own):
                cells.append(own)
                for n in SUMS:
                    sums[n].append(made[n])
        if not cells:
            return
        matrix = np.concatenate(cells).tobytes()
        sums = {n: np.concatenate(v, 1) for n, v in sums.items()}
        for task in range(tasks):
            rows = [(task, -1, part, matrix, *(sums[n][0].tobytes() if random else None for n in SUMS))]
            if not random:
                rows += [(task, t, part, None, *(sums[n][t].tobytes() for n in SUMS)) for t in range(task, count, tasks)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i < 3 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], fields)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def subtree(tree: int) -> pa.RecordBatch:
            nonlocal x, ranked
            if x is None:  # the task's first tree
                x = np.concatenate([np.frombuffer(m).reshape(-1, width) for m in matrix])
                ranked = None if random else Ranked.of(x)
            known = {n: np.concatenate([np.frombuffer(r[n]) for r in held]) for n in SUMS}
            used = known["w"] > 0
            path = int(draw(seed, tree))
            made = grow_cells(x[used], *(known[n][used] for n in SUMS), path, random,
                              ranked and ranked.chosen(used)) if used.any() else None
            return pa.RecordBatch.from_arrays(
                [pa.array([tree] if made else [], pa.int32()), pa.array([path] if made else [], pa.int64()),
                 *(pa.array([made[n].astype(k).tobytes()] if made else [], pa.binary()) for n, k in KINDS.items())],
                ["tree", "path", *KINDS])

        def of_group() -> Iterator[pa.RecordBatch]:
            if random:
                yield from map(subtree, range(group[0], count, tasks))
            elif group[1] >= 0:
                yield subtree(group[1])

        group, matrix, held, x, ranked = None, [], [], None, None
        for batch in batches:
            for r in batch.to_pylist():
                if group != (r["task"], r["tree"]):
                    if held:
                        yield from of_group()
                    group, held = (r["task"], r["tree"]), []
                    if group[1] < 0:
                        matrix, x = [], None
                held.append(r)
                if r["tree"] < 0:
                    matrix.append(r["x"])
        if held:
            yield from of_group()

    dealt = base.repartition(parts, *names).withColumn("part", F.spark_partition_id()).sortWithinPartitions(
        *names, "number")
    sums = dealt.mapInArrow(summed, schema)
    return sums.repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "tree", "part").mapInArrow(
        grown, "tree int, path long, " + ", ".join(f"{n} binary" for n in KINDS))
