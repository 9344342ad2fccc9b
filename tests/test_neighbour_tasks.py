"""Distances are spread over tasks by their number, not by the bytes of the rows."""

import numpy as np

from roadflow.operators import neighbours as N

COLS = ["a", "b", "c"]


def test_searches_use_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1000, (2000, 3)).astype(float)
    rows = spark.createDataFrame([(i, *map(float, v), i % 7) for i, v in enumerate(x)],
                                 "row_idx long, a double, b double, c double, traffic_volume long")
    kernel = N._topk_kernel

    def marked(cols, k):
        run = kernel(cols, k)

        def task(q, t):
            from pyspark import TaskContext
            return run(q, t).assign(y=float(TaskContext.get().partitionId()))
        return task

    used = []
    ranked = N._ranked

    def counted(*args):
        out = ranked(*args)
        used.append(out.select("y").distinct().count())
        return out

    monkeypatch.setattr(N, "_topk_kernel", marked)
    monkeypatch.setattr(N, "_ranked", counted)
    monkeypatch.setattr(N, "TASK_DISTANCES", 1000, raising=False)
    asked = rows.where("row_idx % 10 = 0")
    got = {(r.qid, r["rank"]): r.tid for r in N.knn_candidates(rows, asked, COLS, 5).collect()}
    for q in range(0, 2000, 10):
        near = np.lexsort((np.arange(2000), np.round(((x - x[q]) ** 2).sum(1), N.DIGITS)))[:5]
        assert [got[q, i + 1] for i in range(5)] == near.tolist()
    assert N.knn_index_candidates(rows, asked, COLS, 5).count() == 1000
    assert min(used) > 4
