"""Histogram boosting: brute-force splits, both ways of running, draws, odd rows."""

import numpy as np
import pytest

from roadflow.operators import histboost as H


def table(n=600, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.integers(0, 9, n), rng.integers(0, 5, n), rng.integers(0, 40, n) / 4
    y = np.where(a > 5, 40.0, 3.0) * (b + 1) + 2 * c + rng.integers(0, 7, n)
    return [(i, int(a[i]), int(b[i]), float(c[i]), float(y[i])) for i in range(n)]


COLS = ["a", "b", "c"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a int, b int, c double, y double")


def brute_leafwise(x, g, h, leaves, reg, least):
    """Best-first growth with every split of every leaf tried; leaves as sets of rows."""
    def best(rows):
        found = (0.0, None)
        for f in range(x.shape[1]):
            for t in np.unique(x[rows, f])[:-1]:
                low = rows[x[rows, f] <= t]
                high = rows[x[rows, f] > t]
                if h[low].sum() < least or h[high].sum() < least:
                    continue
                gain = sum(g[r].sum() ** 2 / (h[r].sum() + reg) * s for r, s in ((low, 1), (high, 1), (rows, -1)))
                if gain > found[0] * (1 + 1e-9) + 1e-9:
                    found = (gain, (low, high))
        return found

    now = [np.arange(len(x))]
    while len(now) < leaves:
        found = [best(r) for r in now]
        at = max(range(len(now)), key=lambda i: found[i][0])
        if found[at][1] is None:
            break
        now[at:at + 1] = found[at][1]
    return now


@pytest.mark.parametrize("leaves,reg,least", [(3, 0.0, 1), (31, 0.0, 20), (63, 1.0, 2)])
def test_leafwise_tree_equals_brute_force(spark, leaves, reg, least):
    rows = table()
    x, y = np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows])
    model = H.fit_boosted(frame(spark, rows), H.Params(rounds=1, depth=None, leaves=leaves, reg=reg, least_weight=least,
                                                       rate=0.1), COLS, "y", "id")
    got = np.array([r.predicted for r in model.transform(frame(spark, rows)).orderBy("id").collect()])
    want = np.full(len(y), y.mean())
    g = y.mean() - y
    groups = brute_leafwise(x, g, np.ones(len(y)), leaves, reg, least)
    for part in groups:
        want[part] -= 0.1 * g[part].sum() / (len(part) + reg)
    assert len(groups) > 2
    assert (model.trees.feature < 0).sum() == len(groups)
    np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("params", [
    H.Params(rounds=13, depth=4, reg=1.0), H.Params(rounds=12, depth=None, leaves=9, least_weight=5),
    H.Params(rounds=12, depth=3, reg=1.0, rows=0.7, columns=0.7)])
def test_one_task_and_many_tasks_grow_the_same_trees(spark, params, monkeypatch):
    rows = table(500, 5)
    monkeypatch.setattr(H, "CHUNK", 5)
    one = H.fit_boosted(frame(spark, rows).repartition(5), params, COLS, "y", "id")
    monkeypatch.setattr(H, "HANDOVER", 0)
    monkeypatch.setattr(H, "KEEP", 4)
    many = H.fit_boosted(frame(spark, rows[::-1]).repartition(3), params, COLS, "y", "id")
    for name in ("tree", "feature", "bin", "left", "right"):
        assert (getattr(one.trees, name) == getattr(many.trees, name)).all()
    np.testing.assert_allclose(one.trees.value, many.trees.value, rtol=1e-7, atol=1e-9)
    assert len(np.unique(one.trees.tree)) == params.rounds


def test_boosting_learns_and_survives_saving(spark, tmp_path):
    train, test = table(2000, 1), table(500, 2)
    model = H.fit_boosted(frame(spark, train), H.Params(rounds=60, rate=0.2, depth=4, reg=1.0), COLS, "y", "id")
    scored = model.transform(frame(spark, test)).collect()
    error = np.sqrt(np.mean([(r.predicted - r.y) ** 2 for r in scored]))
    assert error < 0.2 * np.std([r.y for r in scored])
    assert sum(model.importances()) == pytest.approx(1) and min(model.importances()) > 0
    model.save(spark, str(tmp_path))
    again = H.BoostedModel.load(spark, str(tmp_path)).transform(frame(spark, test)).collect()
    assert scored == again


def test_odd_rows(spark):
    rows = [(1, None, 1, float("nan"), 2.0), (2, 3, 1, 1.0, 4.0), (3, 3, 1, None, None), (4, 3, 1, 2.0, 4.0)]
    params = H.Params(rounds=3, rate=1.0, depth=2)
    model = H.fit_boosted(frame(spark, rows), params, COLS, "y", "id")
    assert [r.predicted for r in model.transform(frame(spark, rows)).orderBy("id").collect()] == [2.0, 4.0, 4.0, 4.0]
    assert 1 not in model.trees.feature  # a constant never splits
    empty = H.fit_boosted(frame(spark, []), params, COLS, "y", "id")
    assert [r.predicted for r in empty.transform(frame(spark, rows)).collect()] == [None] * 4


def test_draws_are_even_and_differ_between_trees():
    rows = np.arange(20000)
    taken = [H.draw(t, rows) < 0.8 * H.PRIME for t in range(30)]
    assert all(abs(t.mean() - 0.8) < 0.02 for t in taken)
    both = [(taken[i] & taken[j]).mean() for i in range(30) for j in range(i)]
    assert max(abs(b - 0.64) for b in both) < 0.08
    columns = {tuple(H.drawn_columns(t, 18, 0.8)) for t in range(30)}
    assert len(columns) > 20 and all(len(c) == 14 for c in columns)
