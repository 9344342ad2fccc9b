"""Quantiles, profiles, metrics, confusion reports and k-NN against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadflow.operators import evaluate as Ev
from roadflow.operators import quality as Qy
from roadflow.operators import scaling as Sc
from roadflow.operators.neighbours import knn_predict
from roadflow.operators.scenario import apply_scenario


def test_exact_quantiles_with_ties(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.integers(0, 50, 997), np.full(500, 17)]).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "traffic_volume double")
    q = Qy.exact_quantiles(df, "traffic_volume", (0.1, 0.25, 0.5, 0.75, 0.9)).first()
    want = np.percentile(vals, [10, 25, 50, 75, 90])
    assert list(q) == pytest.approx(list(want))


def test_iqr_bounds(spark):
    # published Q1 / Q3 → bounds -4417 / 10543
    q1, q3 = 1193.0, 4933.0
    assert q1 - 1.5 * (q3 - q1) == -4417.0 and q3 + 1.5 * (q3 - q1) == 10543.0
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "traffic_volume double")
    r = Qy.iqr_outliers(df).first()
    assert (r.q1, r.q3, r.n_outliers) == (2.0, 4.0, 1)


def test_profile_columns(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "x int, y string")
    got = {r.column_name: r for r in Qy.profile_columns(df).collect()}
    assert (got["y"].missing, got["y"].missing_pct, got["y"].n_distinct) == (1, 33.3, 2)
    assert (got["x"].dtype, got["x"].n_distinct) == ("int", 2)


def test_pct_half_even(spark):
    from roadflow.operators.profiles import pct_1dp
    rows = [(c, n) for n in (7, 1000, 10000) for c in range(0, n + 1, max(1, n // 97))]
    df = spark.createDataFrame(rows, "c long, n long")
    for r in df.select("c", "n", pct_1dp("c", "n").alias("p")).collect():
        from decimal import ROUND_HALF_EVEN, Decimal
        want = float((Decimal(r.c) * 100 / Decimal(r.n)).quantize(Decimal("0.1"), rounding=ROUND_HALF_EVEN))
        assert r.p == want


def _preds(spark, pairs, model="m"):
    return spark.createDataFrame([(model, "test", i, None, float(a), float(p)) for i, (a, p) in enumerate(pairs)],
                                 "model string, split string, row_idx long, ts timestamp_ntz, actual double, predicted double")


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 7000, 500).astype(float)
    p = a + rng.normal(0, 400, 500)
    m = Ev.evaluate(_preds(spark, list(zip(a, p))), digits=9, r2_digits=9).first()
    pc = np.clip(p, 0, 10000)
    assert m.MAE == pytest.approx(np.mean(np.abs(a - pc)), rel=1e-9)
    assert m.RMSE == pytest.approx(np.sqrt(np.mean((a - pc) ** 2)), rel=1e-9)
    r2 = 1 - np.sum((a - pc) ** 2) / np.sum((a - a.mean()) ** 2)
    assert m.R2 == pytest.approx(r2, rel=1e-9)
    assert m.MAPE == pytest.approx(np.mean(np.abs((a - pc) / (a + 1e-6))) * 100, rel=1e-9)


def test_r2_degenerate(spark):
    assert Ev.evaluate(_preds(spark, [(5, 5), (5, 5)])).first().R2 == 1.0
    assert Ev.evaluate(_preds(spark, [(5, 5), (5, 6)])).first().R2 == 0.0


def test_class_report_from_published_matrix(spark):
    labels = ["LOW", "MEDIUM", "HIGH", "SEVERE"]
    reps = {"LOW": 500.0, "MEDIUM": 2000.0, "HIGH": 4000.0, "SEVERE": 6000.0}
    matrix = [[1954, 187, 48, 8], [142, 1812, 132, 15], [36, 168, 2612, 249], [12, 29, 193, 2024]]
    pairs = [(reps[labels[i]], reps[labels[j]]) for i in range(4) for j in range(4) for _ in range(matrix[i][j])]
    preds = _preds(spark, pairs)
    rep = {r.level: r for r in Ev.class_report(preds).collect()}
    # 1954 / 2144, 1954 / 2197 and their F1; published as 0.911 / 0.889 / 0.900
    assert (rep["LOW"].precision, rep["LOW"].recall, rep["LOW"].f1) == (0.9114, 0.8894, 0.9003)
    acc = Ev.evaluate(preds).first().ClassAcc
    assert acc == pytest.approx(87.3298, abs=1e-4) and rep["weighted avg"].support == 9621
    conf = {r.actual_level: [r[x] for x in labels] for r in Ev.confusion(preds).collect()}
    assert [conf[x] for x in labels] == matrix


def test_residual_bins(spark):
    preds = _preds(spark, [(2000, 2000 - 1001), (2000, 1000), (2000, 3000), (2000, 7000)])
    got = {r.bin_from: r["count"] for r in Ev.residual_histogram(preds).collect()}
    assert got == {-1000: 1, 1000: 2}


def test_scenario_multipliers(spark):
    base = {"weather_severity": 0.0, "special_event": 0.0, "incident": 0.0, "remote_work": 0.0}
    cases = [("weather_severity", 700), ("special_event", 1400), ("incident", 1200), ("remote_work", 750)]
    rows = []
    for f, _ in cases:
        r = dict(base, **{f: 100.0})
        rows.append((1000.0, r["weather_severity"], r["special_event"], r["incident"], r["remote_work"]))
    df = spark.createDataFrame(rows, "volume_raw double, weather_severity double, special_event double, "
                                     "incident double, remote_work double")
    assert [r.modified for r in apply_scenario(df).collect()] == [c[1] for c in cases]


def test_scaler_constant_and_roundtrip(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    st = Sc.fit_scaler(df, ["x", "c"])
    out = Sc.apply_scaler(df, st, ["x", "c"]).collect()
    assert [r.c for r in out] == [0.0, 0.0, 0.0]
    assert np.std([r.x for r in out]) == pytest.approx(1.0)
    t = spark.createDataFrame([(float(v),) for v in [3, 9, 27]], "traffic_volume double")
    for kind in ("minmax_eps", "minmax", "zscore"):
        s = Sc.fit_target_scale(t, kind=kind)
        back = Sc.unscale_target(Sc.scale_target(t, s), s).collect()
        assert [r.y_unscaled for r in back] == pytest.approx([3, 9, 27])


def test_knn_multi_block_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    tr = rng.integers(0, 4, (300, 3)).astype(float)
    ty = rng.integers(0, 5000, 300).astype(float)
    q = rng.integers(0, 4, (60, 3)).astype(float)
    train = spark.createDataFrame([(i, float(ty[i]), *map(float, tr[i])) for i in range(300)],
                                  "row_idx long, traffic_volume double, a double, b double, c double")
    query = spark.createDataFrame([(i, *map(float, q[i])) for i in range(60)], "row_idx long, a double, b double, c double")
    got = {r.row_idx: r.predicted for r in knn_predict(train, query, ["a", "b", "c"], k=10, block_rows=70).collect()}
    for i in range(60):
        d = ((tr - q[i]) ** 2).sum(1)
        order = np.lexsort((np.arange(300), d))[:10]
        assert got[i] == pytest.approx(ty[order].mean())
