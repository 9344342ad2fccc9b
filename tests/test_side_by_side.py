"""Fits of the benchmark: beside each other, on one split and one binning, the same models as alone."""

import threading

import pytest
from pyspark.sql import functions as F

from roadflow.operators import histboost as H
from roadflow.operators import models as M
from roadflow.plans import q_models as Q
from roadflow.session import side_by_side

SMALL = {"Gradient Boosting": H.Params(4, 0.1, 2), "LightGBM": H.Params(4, 0.1, None, leaves=5, least_weight=5)}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(Q, "_CACHE", {})
    for name, params in SMALL.items():
        monkeypatch.setitem(M.SPECS, name, M.ModelSpec(name, "BOOST", params))


def test_calls_overlap_and_keep_their_order(spark):
    met = threading.Barrier(3, timeout=60)

    def counted(n):
        met.wait()
        return spark.range(n).agg(F.count(F.lit(1))).first()[0]

    assert side_by_side(spark, [lambda n=n: counted(n) for n in (5, 3, 4)]) == [5, 3, 4]


def test_a_failed_call_is_raised(spark):
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, [lambda: 1, lambda: 1 // 0])


def test_fits_overlap(spark, sf_small, small, monkeypatch):
    met = threading.Barrier(3, timeout=60)
    monkeypatch.setattr(M, "fit_model", lambda train, spec: (met.wait(), spec.name)[1])
    train, _ = Q.split_frames(spark, sf_small)
    names = ["Linear Regression", "Ridge Regression"]
    models, beside = Q.fit_together(spark, sf_small, train, names, lambda rows: met.wait() >= 0)
    assert beside and {n: m for n, (m, _) in models.items()} == {n: n for n in names}


def test_models_share_a_binning_and_equal_those_fitted_alone(spark, sf_small, small, monkeypatch):
    asked = []
    monkeypatch.setattr(H, "fit_edges", lambda *a, of=H.fit_edges: (asked.append(1), of(*a))[1])
    train, test = Q.split_frames(spark, sf_small)
    models, near = Q.fit_together(spark, sf_small, train, list(SMALL), lambda rows: rows.count())
    assert near == train.count() and len(asked) == 1
    for name, params in SMALL.items():
        alone = H.fit_boosted(train, params)
        assert [r[:5] for r in models[name][0].trees.rows()] == [r[:5] for r in alone.trees.rows()]
        assert models[name][1] > 0
    # fitted models are kept
    again, _ = Q.fit_together(spark, sf_small, train, list(SMALL), lambda rows: None)
    assert all(again[n] is models[n] for n in SMALL)


def test_benchmark_scores_keep_their_models(spark, sf_small):
    _, test = Q.split_frames(spark, sf_small)
    fits = [(f"m{i}", "X", lambda df, i=i: df.withColumn("predicted", F.col("traffic_volume") + F.lit(float(i))), 0.5)
            for i in (3, 1, 2)]
    rows = {r.Model: r for r in M.run_benchmark(test, fits).collect()}
    assert set(rows) == {"m1", "m2", "m3"} and all(r.Time == 0.5 for r in rows.values())
    assert rows["m1"].MAE < rows["m2"].MAE < rows["m3"].MAE
