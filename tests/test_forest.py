"""Forests: brute-force growth at a fixed seed, hand-over, depth, repeats."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadflow.operators import forest as H
from roadflow.operators.histboost import PRIME, draw

COLS = ["a", "b", "c"]


def table(n=300, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 9, n), rng.integers(0, 3, n), rng.integers(0, 400, n) / 8
    y = a * 10 + np.where(b == 1, 30, 0) + np.round(c) + rng.integers(0, 5, n)
    return [(i, int(a[i]), int(b[i]), float(c[i]), float(y[i])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a int, b int, c double, y double")


def brute(x, y, w, path, random):
    """Predictor of a tree grown node by node, every cut tried."""
    total, s = w.sum(), (w * y).sum()
    found = (-np.inf, None, None)
    if len(set(y)) > 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            if random:
                cuts = [values[0] + draw(path, 3 + f) / PRIME * (values[-1] - values[0])] if len(values) > 1 else []
            else:
                cuts = [(p + q) / 2 for p, q in zip(values, values[1:])]
            for t in cuts:
                low = x[:, f] <= t
                n_low, s_low = w[low].sum(), (w * y)[low].sum()
                if 0 < n_low < total:
                    score = s_low ** 2 / n_low + (s - s_low) ** 2 / (total - n_low) - s ** 2 / total
                    if score > found[0] + abs(score) * 1e-9:
                        found = (score, f, t)
    if found[1] is None:
        return lambda row: s / total
    _, f, t = found
    low = x[:, f] <= t
    left = brute(x[low], y[low], w[low], draw(path, 1), random)
    right = brute(x[~low], y[~low], w[~low], draw(path, 2), random)
    return lambda row: left(row) if row[f] <= t else right(row)


def predictions(model, df):
    return np.array([r.predicted for r in model.transform(df).orderBy("id").collect()])


@pytest.mark.parametrize("random", [True, False])
def test_forest_equals_brute_force(spark, random):
    rows = table()
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    model = H.fit_forest(frame(spark, rows).repartition(3), H.ForestParams(3, random), COLS, "y", "id")
    got = predictions(model, frame(spark, rows).repartition(2))
    want = np.zeros(len(y))
    for tree in range(3):
        w = np.ones(len(y), int)
        if not random:
            u = draw(tree + 1000, np.arange(len(y)))
            w = sum((u >= int(s * PRIME)).astype(int) for s in H.POISSON)
        used = w > 0
        grown = brute(x[used], y[used], w[used], int(draw(42, tree)), random)
        want += [grown(row) for row in x]
    np.testing.assert_allclose(got, want / 3, rtol=1e-9)


@pytest.mark.parametrize("random", [True, False])
def test_hand_over_by_size(spark, random, monkeypatch):
    rows = table(500, 2)
    params = H.ForestParams(4, random)
    one = predictions(H.fit_forest(frame(spark, rows), params, COLS, "y", "id"), frame(spark, rows))
    monkeypatch.setattr(H, "HANDOVER", 40)
    model = H.fit_forest(frame(spark, rows).repartition(7), params, COLS, "y", "id")
    assert len(model.top) > 20 and model.table.count() > 24
    many = predictions(model, frame(spark, rows))
    y = np.array([r[4] for r in rows])
    if random:  # a threshold is drawn alike wherever its node is split
        np.testing.assert_allclose(one, many, rtol=1e-9)
    else:  # big nodes try quantiles only
        assert np.sqrt(np.mean((many - y) ** 2)) < 1.3 * np.sqrt(np.mean((one - y) ** 2))


def test_leaves_are_pure_below_depth_thirty(spark):
    # each value is four times the last: a best split takes one row off at a time
    rows = [(i, 0, 0, float(i), float(4 ** i)) for i in range(45)]
    x, y = np.array([r[1:4] for r in rows], float), np.array([r[4] for r in rows])
    nodes = H.grow(x, y, np.ones(45, int), 1, False)
    assert H.evaluate(nodes, x).tolist() == y.tolist()
    deep, at = 0, [(0, 0)]
    while at:
        node, depth = at.pop()
        deep = max(deep, depth)
        if nodes["feature"][node] >= 0:
            at += [(nodes["left"][node] + s, depth + 1) for s in (0, 1)]
    assert deep > 30
    model = H.fit_forest(frame(spark, rows), H.ForestParams(2), COLS, "y", "id")
    assert predictions(model, frame(spark, rows)).tolist() == y.tolist()


def test_odd_rows(spark):
    rows = [(1, None, 1, float("nan"), 2.0), (2, 3, 1, 1.0, 4.0), (3, 3, 1, None, None), (4, 3, 1, 2.0, 4.0)]
    model = H.fit_forest(frame(spark, rows), H.ForestParams(3), COLS, "y", "id")
    assert predictions(model, frame(spark, rows)).tolist()[1::2] == [4.0, 4.0]
    empty = H.fit_forest(frame(spark, []), H.ForestParams(3), COLS, "y", "id")
    assert [r.predicted for r in empty.transform(frame(spark, rows)).collect()] == [None] * 4


def test_repeats_are_poisson(spark):
    rows = spark.range(20000).select(H.repeats(F.lit(5).cast("long"), F.col("id")).alias("n"))
    share = {r["n"]: r["count"] / 20000 for r in rows.groupBy("n").count().collect()}
    assert abs(share[0] - 0.3679) < 0.02 and abs(share[1] - 0.3679) < 0.02 and abs(share[2] - 0.1839) < 0.02
