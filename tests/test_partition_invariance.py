"""Results do not depend on the number of shuffle partitions."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["heatmap", "patterns", "summary", "row_index", "random_split", "sequence_counts", "evaluate",
         "class_report", "knn_predict", "scenario_summary"]


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_any_partitioning(spark, name):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("3", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(_rows(E.queries()[name](spark, SF)))
            spark.catalog.clearCache()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
