"""Best splits by ranks: neighbouring doubles, columns in the same order, rare draws."""

from __future__ import annotations

import numpy as np

from roadflow.operators import forest as Fo


def test_neighbouring_doubles_split():
    x = np.array([[0.1], [np.nextafter(0.1, 1)], [np.nextafter(0.1, 1)]])
    y = np.array([1.0, 2.0, 2.0])
    made = Fo.grow(x, y, np.ones(3, np.int64), 1, False)
    assert len(made["feature"]) == 3 and made["cut"][0] == 0.1
    assert Fo.evaluate(made, x).tolist() == [1.0, 2.0, 2.0]


def test_sorted_and_counted_values_agree():
    r = np.random.default_rng(5)
    node = np.sort(r.integers(0, 7, 300))
    rank, w = r.integers(0, 40, 300), r.integers(1, 4, 300)
    wy = w * r.integers(0, 90, 300)
    counted = Fo.value_sums(node, rank, 40, 7, wy, w)
    sparse = Fo.value_sums(node * 1000, rank, 40, 7000, wy, w)
    assert (counted[0] * 1000 == sparse[0]).all()
    assert all((a == b).all() for a, b in zip(counted[1:], sparse[1:], strict=True))


def test_best_split_is_that_of_all_thresholds():
    r = np.random.default_rng(3)
    x = np.column_stack([r.integers(0, 30, 200), r.normal(size=200), r.integers(0, 2, 200)]).astype(float)
    x = np.column_stack([x, 3 * x[:, 0], np.ones(200)])  # one in the order of the first, one constant
    y, w = r.integers(0, 50, 200).astype(float), r.integers(1, 3, 200)
    best, at = -np.inf, None
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= t
            n, s = w[low].sum(), (w * y)[low].sum()
            score = s ** 2 / n + ((w * y).sum() - s) ** 2 / (w.sum() - n)
            if score > best + 1e-6:
                best, at = score, (f, low)
    made = Fo.grow(x, y, w, 1, False)
    assert made["feature"][0] == at[0]
    assert ((x[:, at[0]] <= made["cut"][0]) == at[1]).all()
