"""Components that are stars already take no round, and a round few tasks."""

from __future__ import annotations

import uuid

import pytest

from roadflow.llm.shared import components


@pytest.fixture
def forty_tasks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def tasks_of(spark, run):
    sc, name = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(name, name)
    got = run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds}
    return got, sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s))


def test_stars_take_no_round(spark, forty_tasks):
    stars = [(100 * i + j, 100 * i) for i in range(20) for j in range(1, 30)]
    edges = spark.createDataFrame(stars, "a long, b long").coalesce(2)
    got, tasks = tasks_of(spark, lambda: {r.node: r.root for r in components(edges).collect()})
    assert got == {n: n // 100 * 100 for pair in stars for n in pair}
    assert tasks < 250


def test_chains_and_crowds(spark, forty_tasks):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (7 * i + 3) % 50) for i in range(50)] + [(200, 200)]
    root = {n: n for pair in edges for n in pair if pair[0] != pair[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got, tasks = tasks_of(spark, lambda: {r.node: r.root for r in components(
        spark.createDataFrame(edges, "a long, b long").coalesce(2)).collect()})
    assert got == root
    assert tasks < 2000
