"""Nearest neighbours of rows that repeat."""

import numpy as np

from roadflow.operators import neighbours as N

COLS = ["a", "b"]


def rows_of(n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, n), rng.integers(0, 5, n)
    return [(i, float(a[i]), float(b[i]), int(rng.integers(0, 99))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_idx long, a double, b double, traffic_volume long")


def test_exact_searches_equal_vectors_once(spark, monkeypatch):
    train = rows_of(900, 1)
    query = [(5000 + i, *r[1:]) for i, r in enumerate(rows_of(400, 2))]
    seen = {}
    exact = N._exact

    def counted(sites, asked, *rest):
        seen["sites"], seen["asked"] = sites.count(), asked.count()
        return exact(sites, asked, *rest)

    monkeypatch.setattr(N, "_exact", counted)
    got = {(r.qid, r["rank"]): (r.tid, r.dist) for r in N.knn_candidates(frame(spark, train), frame(spark, query), COLS, 7).collect()}
    assert seen == {"sites": 30, "asked": 30}
    assert len(got) == 400 * 7
    for q in query:
        near = sorted(((q[1] - t[1]) ** 2 + (q[2] - t[2]) ** 2, t[0]) for t in train)[:7]
        assert [got[q[0], i + 1] for i in range(7)] == [(t, d) for d, t in near]


def test_index_holds_a_common_vector_once(spark):
    # one vector has nearly all rows: a task would hold them all
    rows = frame(spark, [(i, 1.0, 1.0, i % 5) for i in range(3000)] + [(3000 + i, float(i), 2.0, 1) for i in range(60)])
    sites = N._sites(rows, COLS, 10, "traffic_volume", "row_idx")
    assert sites.count() == 61 and max(len(r["_rows"]) for r in sites.collect()) == 10
    asked = rows.where("row_idx % 100 = 0")
    found = N.knn_index_candidates(rows, asked, COLS, 10)
    first = found.where("qid = 2900").orderBy("rank").collect()
    assert [(r.tid, r.dist) for r in first] == [(i, 0.0) for i in range(10)]
    assert found.count() == asked.count() * 10
