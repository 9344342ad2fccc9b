"""Library options not exercised by the registered queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadflow.operators import quality as Qy
from roadflow.operators.broadcast import bounded_broadcast
from roadflow.operators.neighbours import knn_candidates, knn_index_candidates, knn_predict


def test_profile_columns_approx_distinct(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("x"), F.lit(None).cast("string").alias("y"))
    got = {r.column_name: r for r in Qy.profile_columns(df, exact=False, rsd=0.02).collect()}
    assert abs(got["x"].n_distinct - 5000) < 5000 * 0.08
    assert (got["y"].missing, got["y"].missing_pct, got["y"].n_distinct) == (20000, 100.0, 0)


def test_knn_scaled_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    tr = rng.normal(0, [1, 50, 500], (200, 3))
    ty = rng.integers(0, 5000, 200).astype(float)
    q = rng.normal(0, [1, 50, 500], (40, 3))
    train = spark.createDataFrame([(i, float(ty[i]), *map(float, tr[i])) for i in range(200)],
                                  "row_idx long, traffic_volume double, a double, b double, c double")
    query = spark.createDataFrame([(i, *map(float, q[i])) for i in range(40)], "row_idx long, a double, b double, c double")
    got = {r.row_idx: r.predicted for r in knn_predict(train, query, ["a", "b", "c"], k=5, scale=True).collect()}
    mu, sd = tr.mean(0), tr.std(0)
    zt, zq = (tr - mu) / sd, (q - mu) / sd
    for i in range(40):
        d = ((zt - zq[i]) ** 2).sum(1)
        assert got[i] == pytest.approx(ty[np.lexsort((np.arange(200), d))[:5]].mean())


def test_bounded_broadcast_respects_bound(spark):
    small = spark.range(10)
    big = spark.range(1000)
    j_small = spark.range(100).join(bounded_broadcast(small, max_rows=50), "id")
    j_big = spark.range(100).join(bounded_broadcast(big, max_rows=50), "id")
    assert "ResolvedHint (strategy=broadcast)" in j_small._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in j_big._jdf.queryExecution().analyzed().toString()
    assert j_small.count() == 10 and j_big.count() == 100


def test_knn_index_answers_every_query(spark):
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.integers(0, 6, 3)), float(i % 13)) for i in range(900)]
    train = spark.createDataFrame(rows, "row_idx long, a double, b double, c double, traffic_volume double")
    query = train.where("row_idx % 9 = 0")
    exact = knn_candidates(train, query, ["a", "b", "c"], k=5).groupBy("qid").agg({"dist": "max"}).collect()
    reach = {r[0]: r[1] for r in exact}
    found = knn_index_candidates(train, query, ["a", "b", "c"], k=5).collect()
    assert len(found) == 5 * 100 and {r.qid for r in found} == set(reach)
    assert sum(r.dist <= reach[r.qid] for r in found) >= 0.9 * len(found)
    # too few rows in the cells visited: the exact way, whole results
    few = knn_index_candidates(train.limit(30), query, ["a", "b", "c"], k=25, probes=1)
    assert few.groupBy("qid").count().where("count != 25").count() == 0
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0, 2.0) for i in range(50)], train.schema)
    assert knn_index_candidates(same, same, ["a", "b", "c"], k=5).count() == 250
    assert knn_index_candidates(same.limit(0), query, ["a", "b", "c"], k=5).count() == 0
