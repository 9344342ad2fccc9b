"""The 64 keys of a fingerprint, which Spark takes for one row, are joined without a broadcast."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from roadflow.llm import simhash


@pytest.fixture
def plans(spark, monkeypatch):
    """The executed plan of every table that simhash materialises, at Spark's own broadcast threshold."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    kept, found, cut = spark.conf.get(name), [], simhash.cut_lineage

    def watched(df):
        made = cut(df)
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(simhash, "cut_lineage", watched)
    spark.conf.set(name, "10485760b")
    yield found
    spark.conf.set(name, kept)


@pytest.fixture
def docs(spark):
    """60 texts of 200 words, each twice, once with a word of its own at the end."""
    words = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.hex(F.xxhash64(F.floor(F.col("id") / 2), i)))
    text = F.concat_ws(" ", words, F.when(F.col("id") % 2 == 1, F.hex(F.xxhash64("id"))))
    return spark.range(120).select(F.col("id").alias("doc_id"), text.alias("text"))


def keyed(plans: list[str]) -> list[str]:
    return [p for p in plans if "explode(" in p]


def test_pipeline_stage_broadcasts_no_key(docs, plans):
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert len(keyed(plans)) == 1 and "BroadcastExchange" not in keyed(plans)[0]
    prints = {r.doc_id: r.fp for r in simhash.with_fingerprint(docs, "text", ["doc_id"]).collect()}
    near = {i for i in range(0, 120, 2) if bin((prints[i] ^ prints[i + 1]) & (1 << 64) - 1).count("1") <= simhash.MAX_BITS}
    assert near and kept == {*range(0, 120, 2), *(i + 1 for i in range(0, 120, 2) if i not in near)}


def test_op3_broadcasts_no_key(docs, plans):
    found = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert len(keyed(plans)) == 1 and "BroadcastExchange" not in keyed(plans)[0]
    for i in range(0, 120, 2):
        near = bin((found[i][0] ^ found[i + 1][0]) & (1 << 64) - 1).count("1") <= simhash.MAX_BITS
        assert found[i][1] == i and found[i + 1][1] == (i if near else i + 1)
