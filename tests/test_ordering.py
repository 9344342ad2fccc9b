"""Row index, splits, sampling and sequences against brute force."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadflow.operators import ordering as O
from roadflow.operators import sequences as Sq


def skewed_frame(spark, n=3000, hot_share=0.34, seed=7):
    """A third of the rows share one timestamp (a hot key)."""
    rng = np.random.default_rng(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        if rng.random() < hot_share:
            t = base
        else:
            t = base + dt.timedelta(minutes=int(rng.integers(0, 50000)))
        rows.append((int(rng.permutation(10 * n)[0]) * 0 + i * 7 % (10 * n), t, int(rng.integers(0, 7000))))
    return spark.createDataFrame(rows, "obs_id long, date_time timestamp_ntz, traffic_volume long")


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_row_index_matches_global_sort(spark, parts):
    df = skewed_frame(spark)
    idx = O.with_row_index(df, ["date_time", "obs_id"], num_partitions=parts)
    got = [r.obs_id for r in idx.orderBy("row_idx").collect()]
    want = [r.obs_id for r in df.orderBy("date_time", "obs_id").collect()]
    assert got == want
    assert sorted(r.row_idx for r in idx.collect()) == list(range(df.count()))


def test_row_index_checkpointed(spark):
    df = skewed_frame(spark, 500)
    idx = O.with_row_index(df, ["date_time", "obs_id"], num_partitions=4, checkpoint=True)
    assert sorted(r.row_idx for r in idx.collect()) == list(range(500))


@pytest.mark.parametrize("n,cuts,sizes", [(100, (0.7, 0.85), [70, 15, 15]), (1, (0.8,), [0, 1]),
                                          (48204, (0.8,), [38563, 9641])])
def test_split_sizes(n, cuts, sizes):
    assert O.split_sizes(n, cuts) == sizes


def test_chrono_split_is_leak_free(spark):
    df = skewed_frame(spark, 1000)
    sp = O.chrono_split(df)
    agg = {r.split: r for r in sp.groupBy("split").agg(F.count("*").alias("n"), F.min("row_idx").alias("lo"),
                                                        F.max("row_idx").alias("hi")).collect()}
    assert agg["train"].n == 800 and agg["test"].n == 200
    assert agg["train"].hi < agg["test"].lo
    three = O.chrono_split(df, cuts=(0.7, 0.85), labels=("train", "val", "test"))
    counts = {r.split: r["count"] for r in three.groupBy("split").count().collect()}
    assert counts == {"train": 700, "val": 150, "test": 150}


def test_random_split_exact_and_reproducible(spark):
    df = skewed_frame(spark, 1001)
    a = O.random_split(df, 0.2, seed=42)
    b = O.random_split(df, 0.2, seed=42)
    ta = sorted(r.obs_id for r in a.where("split = 'test'").collect())
    tb = sorted(r.obs_id for r in b.where("split = 'test'").collect())
    assert ta == tb and len(ta) == O.random_test_size(1001, 0.2) == 201
    c = O.random_split(df, 0.2, seed=7)
    assert sorted(r.obs_id for r in c.where("split = 'test'").collect()) != ta


def test_systematic_sample(spark):
    df = spark.range(105).withColumnRenamed("id", "row_idx")
    got = [r.row_idx for r in O.systematic_sample(df, 20).orderBy("row_idx").collect()]
    assert got == list(range(0, 100, 5))
    small = spark.range(7).withColumnRenamed("id", "row_idx")
    assert [r.row_idx for r in O.systematic_sample(small, 20).orderBy("row_idx").collect()] == list(range(7))


def _series(spark, n):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(i % 13), float(i * 3 % 11), 100 + i)
            for i in range(n)]
    return spark.createDataFrame(rows, "row_idx long, date_time timestamp_ntz, a double, b double, traffic_volume long")


@pytest.mark.parametrize("n,expected", [(0, 0), (24, 0), (25, 1), (100, 76)])
def test_sequence_counts(spark, n, expected):
    df = _series(spark, n) if n else _series(spark, 1).limit(0)
    assert Sq.make_sequences(df, ["a", "b"], s=24, chunk=30).count() == expected


def test_sequences_match_brute_force(spark):
    n, s = 300, 24
    df = _series(spark, n)
    got = {r.row_idx: (r.label, [list(x) for x in r.seq]) for r in Sq.make_sequences(df, ["a", "b"], s=s, chunk=40).collect()}
    assert len(got) == n - s
    for j in range(s, n):
        want_seq = [[float(i % 13), float(i * 3 % 11)] for i in range(j - s, j)]
        assert got[j] == (100.0 + j, want_seq)
    first = min(got)
    assert first == s and got[first][0] == 100.0 + s


def test_sequences_within_split(spark):
    df = _series(spark, 200).withColumn("split", F.when(F.col("row_idx") < 140, "train").otherwise("test"))
    seqs = Sq.make_sequences(df, ["a"], s=24, within="split", chunk=32)
    counts = {r.split: r["count"] for r in seqs.groupBy("split").count().collect()}
    assert counts == {"train": 140 - 24, "test": 60 - 24}


def test_sequence_split(spark):
    seqs = Sq.make_sequences(_series(spark, 124), ["a"], s=24, chunk=50)
    sp = Sq.split_sequences(seqs, 0.8, 24)
    counts = {r.seq_split: r["count"] for r in sp.groupBy("seq_split").count().collect()}
    assert counts == {"train": 80, "test": 20}
