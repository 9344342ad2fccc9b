"""Boosted models on drawn rows of equal bins, and the scorer of many rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_boosting import COLS, frame, table

from roadflow.operators import histboost as H


def test_drawn_rows_of_equal_bins_are_one_cell(spark, monkeypatch):
    # 1,200 rows in at most 200 cells: no job a batch of leaves, whatever the rows
    rows = [(i, *r[1:]) for i, r in enumerate(table(200, 6) * 6)]
    params = H.Params(rounds=7, depth=3, reg=1.0, rows=0.7, columns=0.7)
    monkeypatch.setattr(H, "HANDOVER", 200)
    monkeypatch.setattr(H, "DRAWN_CHUNK", 3)
    with monkeypatch.context() as spread:
        spread.setattr(H, "rounds_over_tasks", lambda *_: pytest.fail("rows left in many tasks"))
        one = H.fit_boosted(frame(spark, rows).repartition(4), params, COLS, "y", "id")
    monkeypatch.setattr(H, "HANDOVER", 0)
    many = H.fit_boosted(frame(spark, rows), params, COLS, "y", "id")
    for name in ("tree", "feature", "bin", "left", "right"):
        assert (getattr(one.trees, name) == getattr(many.trees, name)).all()
    np.testing.assert_allclose(one.trees.value, many.trees.value, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("params", [H.Params(rounds=20, depth=6), H.Params(rounds=9, depth=None, leaves=63),
                                    H.Params(rounds=5, depth=8)])
def test_scorer_equals_the_walk(spark, params):
    rows = table(3000, 8)
    model = H.fit_boosted(frame(spark, rows), params, COLS, "y", "id")
    sizes = [len(e) + 2 for e in model.edges]
    rng = np.random.default_rng(3)
    binned = np.stack([rng.integers(0, n, 20000) for n in sizes], 1)
    scorer = H.Scorer(model.trees, sizes)
    assert scorer.fits == (np.bincount(model.trees.tree[model.trees.feature < 0]).max() <= 64)
    if scorer.fits:
        np.testing.assert_allclose(scorer.predict(binned), model.trees.predict(binned), rtol=1e-9, atol=1e-9)
        assert np.bincount(model.trees.tree[model.trees.feature < 0]).max() > 30


def test_requests_are_dealt_before_they_are_decoded(spark, sf_small):
    from roadflow.sources.requests import requests_from_events
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_task = requests_from_events(spark, sf_small).groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == tasks


def test_equal_rows_are_summed_before_they_are_binned(spark, monkeypatch):
    rows = [(i, *r[1:]) for i, r in enumerate(table(50, 9) * 20)]
    seen, bin_rows = [], H.bin_rows
    monkeypatch.setattr(H, "bin_rows", lambda df, *a: seen.append(df.count()) or bin_rows(df, *a))
    model = H.fit_boosted(frame(spark, rows), H.Params(rounds=2, depth=2), COLS, "y", "id")
    assert seen[0] <= 50
    assert model.trees.weight[model.trees.tree == 0].sum() == 1000
