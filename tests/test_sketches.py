"""Daily sketches merged over ranges against exact counts and ranks."""

import pytest
from pyspark.sql import functions as F

from roadflow.operators import sketches as Sk


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    return spark.range(40000).select(
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 20 as int))").alias("date_time"),
        F.when(i % 10 != 0, (i * 7919 % 10007).cast("double")).alias("x"), (i % 3000).cast("string").alias("name"),
        F.lit(None).cast("int").alias("none"))


def test_merged_equals_direct_within_the_error(spark, rows, tmp_path):
    cols = ["x", "name", "none"]
    Sk.daily_sketches(rows, cols).write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    assert stored.count() == 20
    for first, last in ((None, None), ("2024-01-05", "2024-01-11"), ("2024-01-03", "2024-01-03")):
        part = rows.where(F.to_date("date_time").between(first or "2024-01-01", last or "2024-12-31")).toPandas()
        got = {r.column_name: r for r in Sk.merged_profile(stored, cols, first, last).collect()}
        assert {r.n for r in got.values()} == {len(part)}
        for c in cols:
            assert got[c].missing == part[c].isna().sum()
            want = part[c].nunique()
            assert abs(got[c].n_distinct - want) <= 3 * 1.04 / 64 * want + 0.5
        x = part["x"].dropna()
        for p, q in zip((0.25, 0.5, 0.75), (got["x"].q1, got["x"].median, got["x"].q3)):
            assert (x < q).mean() <= p + 0.02 and (x <= q).mean() >= p - 0.02
        assert got["name"].median is None and got["none"].median is None


def test_no_rows(spark, rows):
    empty = Sk.daily_sketches(rows.limit(0), ["x"])
    assert empty.count() == 0
    got = Sk.merged_profile(empty, ["x"]).first()
    assert (got.n, got.missing, got.n_distinct, got.median) == (0, 0, 0, None)


def test_null_times_and_nan(spark):
    frame = spark.createDataFrame([(None, float("nan")), (None, 1.0), (None, None)], "date_time timestamp, x double")
    got = Sk.merged_profile(Sk.daily_sketches(frame, ["x"]), ["x"]).first()
    assert (got.n, got.missing, got.median) == (3, 1, 1.0)
