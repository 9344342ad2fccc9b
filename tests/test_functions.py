"""Scalar functions against the edge literals (levels, risk, bins, flags...)."""

import math

import pytest
from pyspark.sql import functions as F

from roadflow import schema as S
from roadflow.functions import calendar as C
from roadflow.functions import levels as L
from roadflow.operators import features as Fe


def one_col(spark, values, typ="double"):
    return spark.createDataFrame([(v,) for v in values], f"v {typ}")


def test_level_edges(spark):
    vals = [0.0, 999.0, 1000.0, 2999.0, 3000.0, 4999.0, 5000.0, 9000.0, None]
    got = [r[0] for r in one_col(spark, vals).select(L.level("v")).collect()]
    assert got == ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "SEVERE", "SEVERE", None]


def test_level_color_and_emoji(spark):
    df = one_col(spark, [10.0, 1500.0, 3500.0, 6000.0])
    rows = df.select(L.level_color("v"), L.level_emoji("v"), L.level_emoji("v", short=True)).collect()
    assert [r[0] for r in rows] == list(S.LEVEL_COLORS)
    assert [r[1] for r in rows] == list(S.LEVEL_EMOJI_LONG)
    assert [r[2] for r in rows] == list(S.LEVEL_EMOJI_SHORT)


def test_risk_edges(spark):
    vals = [0, 500, 1000, 3000, 5000, 5764, 7000, 9000]
    got = [r[0] for r in one_col(spark, vals, "bigint").select(L.risk("v")).collect()]
    assert got == [0, 12, 25, 50, 75, 85, 100, 100]


def test_risk_null_and_monotone(spark):
    assert one_col(spark, [None]).select(L.risk("v")).first()[0] is None
    vals = list(range(0, 12000, 37))
    got = [r[0] for r in one_col(spark, vals, "bigint").select(L.risk("v")).collect()]
    assert all(a <= b for a, b in zip(got, got[1:]))


def test_temp_bins(spark):
    vals = [-40.0, -39.9, -10.0, 0.0, 10.0, 30.0, 50.0, 50.1]
    got = [r[0] for r in one_col(spark, vals).select(L.temp_bin("v")).collect()]
    assert got == [None, "-40to-10", "-40to-10", "-10to0", "0to10", "20to30", "30+", None]


def test_flags(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    rows = df.select("h", C.rush_hour("h"), C.night("h"), C.late_night("h")).collect()
    assert [r[0] for r in rows if r[1] == 1.0] == [7, 8, 9, 16, 17, 18]
    assert [r[0] for r in rows if r[2] == 1.0] == [0, 1, 2, 3, 4, 5]
    assert [r[0] for r in rows if r[3]] == [0, 1, 2, 3, 4]
    d = spark.range(7).select(F.col("id").cast("int").alias("d"))
    assert [r[0] for r in d.select("d", C.is_weekend("d")).collect() if r[1] == 1.0] == [5, 6]


def test_cyclic_and_identity(spark):
    df = spark.createDataFrame([(0,), (6,), (12,)], "h int")
    s, c = C.cyclic("h", 24)
    rows = df.select(s, c).collect()
    assert rows[0] == (0.0, 1.0)
    assert rows[1][0] == pytest.approx(1.0) and abs(rows[1][1]) < 1e-12
    m = spark.createDataFrame([(12,)], "m int")
    ms, mc = C.cyclic("m", 12)
    r = m.select(ms, mc).first()
    assert abs(r[0]) < 1e-12 and r[1] == pytest.approx(1.0)
    for r in spark.range(100).select(*C.cyclic("id", 7)).collect():
        assert r[0] ** 2 + r[1] ** 2 == pytest.approx(1.0)


def test_weekday_is_monday_zero(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",)], "t string")  # a Monday
    r = df.select(C.parse_ts("t").alias("ts")).select(F.weekday("ts"), F.hour("ts")).first()
    assert r == (0, 10)


def test_quarter_of_month(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    assert [r[0] for r in df.select(C.quarter_of_month("m")).collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]


def test_holiday_flag(spark):
    df = spark.createDataFrame([(None,), ("None",), ("Labor Day",)], "h string")
    assert [r[0] for r in df.select(C.is_holiday("h")).collect()] == [0.0, 0.0, 1.0]


def test_encoder_unseen_and_sorted(spark):
    train = spark.createDataFrame([(w,) for w in ["Rain", "Clear", "Snow", "Clear"]], "weather_main string")
    vocab = Fe.fit_labels(train)
    assert [(r.label, r.code) for r in vocab.orderBy("code").collect()] == [("Clear", 0.0), ("Rain", 1.0), ("Snow", 2.0)]
    q = spark.createDataFrame([("Snow",), ("Haze",), (None,)], "weather_main string")
    got = Fe.encode_labels(q, vocab, flag="known").collect()
    got = {r.weather_main: (r.weather_enc, r.known) for r in got}
    assert got["Snow"] == (2.0, True) and got["Haze"] == (0.0, False) and got[None] == (0.0, False)


def test_factors(spark):
    df = spark.createDataFrame([(8, 6, 2.0, 0.0), (12, 1, 0.0, 0.0), (3, 2, 0.0, 0.5)],
                               "hour int, dow int, rain double, snow double")
    got = [r[0] for r in df.select(L.factors("hour", "dow", "rain", "snow")).collect()]
    assert got[0] == [S.FACTOR_MORNING, S.FACTOR_WEEKEND, "Rain 2.0mm/h — speeds reduced"]
    assert got[1] == [S.FACTOR_DEFAULT]
    assert got[2] == [S.FACTOR_LATE_NIGHT, "Snow 0.5mm/h — road capacity reduced"]


def test_clamp_fixed_bins_period(spark):
    df = one_col(spark, [-5.0, 250.0, 12000.0])
    assert [r[0] for r in df.select(L.clamp("v", 0.0, 10000.0)).collect()] == [0.0, 250.0, 10000.0]
    b = one_col(spark, [0.0, 499.0, 500.0, 5499.0, 5500.0, 9999.0]).select(L.fixed_bins("v"))
    assert [r[0] for r in b.collect()] == [0, 0, 1, 10, 11, 11]
    h = spark.range(24).select(L.period(F.col("id")))
    names = [r[0] for r in h.collect()]
    assert names[0] == "night" and names[6] == "morning" and names[23] == "late" and None not in names


def test_corr_tag_and_fit_status(spark):
    df = one_col(spark, [-0.5, 0.35, 0.2, 0.1, None])
    assert [r[0] for r in df.select(L.corr_tag("v")).collect()] == ["Negative", "Strong", "Moderate", "Weak", None]
    fs = spark.createDataFrame([(0.786, 0.785, False), (0.998, 0.921, False), (0.975, 0.923, False),
                                (0.961, 0.934, True)], "tr double, te double, best boolean")
    got = [r[0] for r in fs.select(L.fit_status("tr", "te", F.col("best"))).collect()]
    assert got == ["Underfit", "Slight Overfit", "Good", "Best Balance"]


def test_kelvin():
    assert math.isclose(300.0 - S.KELVIN_OFFSET, 26.85)
