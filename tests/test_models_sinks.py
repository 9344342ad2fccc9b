"""Models on a seasonal synthetic frame; sources and sinks round trips."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.operators import evaluate as Ev
from roadflow.operators import models as M
from roadflow.operators.boosting import fit_adaboost
from roadflow.sources.observations import read_observations
from roadflow.sources.sinks import (leaderboard_frame, load_model, save_model, to_json_records, write_csv,
                                    write_run_config)

COLS = ["hour", "is_weekend", "temp_c"]


@pytest.fixture(scope="module")
def seasonal(spark):
    """Hourly rows: volume is a smooth function of hour and weekend plus a
    hash-based noise term (fixed seed)."""
    df = spark.range(4000).select(
        F.col("id").alias("row_idx"),
        (F.col("id") % 24).cast("int").alias("hour"),
        ((F.floor(F.col("id") / 24) % 7) >= 5).cast("double").alias("is_weekend"),
        (F.sin(F.col("id") / 500.0) * 15).alias("temp_c"))
    noise = (F.abs(F.xxhash64("row_idx", F.lit(42))) % 1000 - 500) / 5.0
    vol = (3000 + 2500 * F.sin((F.col("hour") - 6) / 24.0 * 2 * np.pi)
           - 1200 * F.col("is_weekend") + 10 * F.col("temp_c") + noise)
    df = df.withColumn("traffic_volume", vol).withColumn("split", F.when(F.col("row_idx") < 3200, "train")
                                                           .otherwise("test"))
    return df.withColumn("date_time", F.timestamp_seconds(F.col("row_idx") * 3600).cast("timestamp_ntz")).cache()


def _r2(seasonal, model, name):
    test = seasonal.where("split = 'test'")
    return Ev.evaluate(M.predictions_frame(model, test, name)).first().R2


def test_boosting_beats_linear(spark, seasonal):
    train = seasonal.where("split = 'train'")
    lin = M.fit_model(train, M.SPECS["Linear Regression"], COLS)
    gbt = M.fit_model(train, M.ModelSpec("g", "BOOST", M._gbt(20, 0.3, 5)), COLS)
    r_lin, r_gbt = _r2(seasonal, lin, "lin"), _r2(seasonal, gbt, "gbt")
    assert r_gbt > 0.8 and r_gbt > r_lin


def test_ridge_matches_closed_form(spark, seasonal):
    train = seasonal.where("split = 'train'")
    stats = M.scaler_literals(train, COLS)
    model = M.fit_model(train, M.SPECS["Ridge Regression"], COLS, stats=stats)
    pdf = train.select(*COLS, "traffic_volume").toPandas()
    X = np.column_stack([(pdf[c] - stats[c][0]) / stats[c][1] for c in COLS])
    y = pdf["traffic_volume"].to_numpy()
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(len(COLS)), Xc.T @ yc)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(w, rel=1e-6)


def test_adaboost_runs(spark, seasonal):
    train, test = seasonal.where("split = 'train'"), seasonal.where("split = 'test'")
    model = fit_adaboost(train, COLS, rounds=5)
    out = model.transform(test)
    assert out.where(F.col("predicted").isNull()).count() == 0
    p = out.select(F.lit("a").alias("model"), "split", "row_idx", F.col("date_time").alias("ts"),
                   F.col("traffic_volume").alias("actual"), "predicted")
    assert Ev.evaluate(p).first().R2 > 0.5


def test_importance_and_persistence(spark, seasonal):
    train = seasonal.where("split = 'train'")
    model = M.fit_model(train, M.SPECS["Decision Tree"], COLS)
    imp = M.feature_importance(model, COLS).collect()
    assert imp[0].column == "hour" and sum(r.importance for r in imp) == pytest.approx(1.0, abs=1e-3)
    d = tempfile.mkdtemp()
    vocab = spark.createDataFrame([("Clear", 0.0)], "label string, code double")
    save_model(model, d, {"vocab": vocab})
    loaded, state = load_model(spark, d, ["vocab"])
    a = M.predict(model, train).select("predicted").collect()
    b = M.predict(loaded, train).select("predicted").collect()
    assert a == b and state["vocab"].count() == 1


def test_csv_scan_nulls(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "obs.csv")
    with open(p, "w") as f:
        f.write("holiday,temp,rain_1h,snow_1h,clouds_all,weather_main,weather_description,date_time,traffic_volume\n")
        f.write("None,288.28,0.0,0.0,40,Clouds,scattered clouds,2012-10-02 09:00:00,5545\n")
        f.write("Columbus Day,273.15,0.0,0.0,90,Rain,light rain,2012-10-08 00:00:00,455\n")
    df = read_observations(spark, p)
    rows = df.orderBy("date_time").collect()
    assert rows[0].holiday is None and rows[1].holiday == "Columbus Day"
    assert rows[0].traffic_volume == 5545 and str(rows[0].date_time) == "2012-10-02 09:00:00"
    assert df.columns == S.OBS_COLUMNS


def test_sinks(spark):
    d = tempfile.mkdtemp()
    lb = leaderboard_frame(spark, [("XGBoost", "BOOST", 286.8, 505.4, 0.934, 5.0, 12.0)])
    write_csv(lb, os.path.join(d, "lb"))
    back = spark.read.option("header", True).csv(os.path.join(d, "lb")).first()
    assert back.Model == "XGBoost" and float(back.R2) == 0.934
    js = to_json_records(lb.select("Model", "R2")).first().json
    assert json.loads(js) == {"Model": "XGBoost", "R2": 0.934}
    cfg = spark.createDataFrame([(24, 18, 0.9)], "seq_len int, input_dim int, r2 double")
    write_run_config(cfg, os.path.join(d, "cfg"))
    assert spark.read.json(os.path.join(d, "cfg")).first().seq_len == 24
