"""Nulls, bad input, hot values and folders of part files."""

from pyspark.sql import functions as F

from roadflow.functions import levels as L
from roadflow.operators import evaluate as Ev
from roadflow.operators import features as Fe
from roadflow.operators import profiles as P
from roadflow.operators import quality as Qy
from roadflow.operators import scenario as Sc
from roadflow.operators.models import rank_importance
from roadflow.plans.q_features import REQ_COLS, requests
from roadflow.sources.requests import decode_requests
from roadflow.streaming.scoring import request_stream, run_available

SF = "/root/testdata/sf0.001"


def test_clip_and_metrics_keep_nulls(spark):
    preds = spark.createDataFrame([("m", 500.0, None), ("m", 500.0, 400.0), ("m", 900.0, 20000.0)],
                                  "model string, actual double, predicted double")
    assert [r.predicted for r in Ev.clip_predictions(preds).collect()] == [None, 400.0, 10000.0]
    m = Ev.evaluate(preds).first()
    assert (m.n, m.unscored, m.MAE) == (3, 1, (100 + 9100) / 2)


def test_unscored_rows_do_not_move_r2(spark):
    rows = [("m", float(a), float(a) + 1) for a in range(10)]
    base = Ev.evaluate(spark.createDataFrame(rows, "model string, actual double, predicted double")).first()
    more = rows + [("m", 1e6, None)]
    assert Ev.evaluate(spark.createDataFrame(more, "model string, actual double, predicted double")).first().R2 == base.R2


def test_null_prediction_stays_null(spark):
    req = spark.createDataFrame([(1, 8, None), (2, 9, -5.0)], "request_id long, hour int, volume_raw double")
    rows = {r.request_id: r for r in Sc.decorate(req).collect()}
    assert (rows[1].volume, rows[1].level, rows[1].risk) == (None, None, None)
    assert (rows[2].volume, rows[2].level, rows[2].risk) == (0, "LOW", 0)
    zero = {c: F.lit(0.0) for c in ("weather_severity", "special_event", "incident", "remote_work")}
    s = {r.request_id: r for r in Sc.apply_scenario(req.withColumns(zero)).collect()}
    assert (s[1].base, s[1].modified, s[2].base) == (None, None, 0)


def test_bad_request_fields_take_defaults(spark):
    bodies = ['{"hour": 1e12}', '{"hour": "NaN"}', '{"hour": "x", "dow": 3.9}', "not json", '{"hour": "7"}', None]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    got = {r.request_id: (r.hour, r.dow) for r in decode_requests(df).collect()}
    assert got == {0: (8, 0), 1: (8, 0), 2: (8, 3), 3: (8, 0), 4: (7, 0), 5: (8, 0)}


def test_filter_valid_keeps_missing_readings(spark):
    rows = [(1, 280.0, None, 0.0), (2, 0.0, 0.0, 0.0), (3, 280.0, 501.0, None), (4, None, None, None), (5, 280.0, 0.0, 6.0)]
    df = spark.createDataFrame(rows, "id int, temp double, rain_1h double, snow_1h double")
    assert [r.id for r in Fe.filter_valid(df).orderBy("id").collect()] == [1, 4]


def test_overview_with_null_volume_and_empty_table(spark):
    df = spark.createDataFrame([(1, 500), (1, None), (2, 1500), (None, 1500)], "hour int, traffic_volume long")
    o = P.overview(df).first()
    assert (o.hourly_avg, o.peak_hour, o.peak_volume, o.avg_volume, o.total_records) == ([500, 1500], 2, 1500, 1166, 4)
    assert o.congestion_dist == {"LOW": 25.0, "MEDIUM": 50.0}
    assert P.overview(df.limit(0)).first().total_records == 0


def test_one_scan_profiles(spark):
    df = spark.read.parquet(f"{SF}/events.parquet").select(
        F.hour("ts").alias("hour"), F.month("ts").alias("month"), F.weekday("ts").alias("dow"),
        F.lit(0.0).alias("is_weekend"), F.col("event_id").alias("traffic_volume"))
    for plan in (P.overview(df), P.patterns(df), P.ratios(df)):
        assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_quantiles_of_a_hot_value(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("v"))
    values = sorted(i if i % 10 == 0 else 7 for i in range(20_000))
    q = Qy.exact_quantiles(df, "v", (0.25, 0.5, 0.95)).first()

    def want(p):
        pos = p * (len(values) - 1)
        lo = int(pos)
        return values[lo] + (pos - lo) * (values[min(lo + 1, len(values) - 1)] - values[lo])

    assert tuple(q) == (want(0.25), want(0.5), want(0.95))
    empty = Qy.exact_quantiles(df.limit(0), "v", (0.5,)).first()
    assert empty is None or empty[0] is None


def test_profile_columns_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, None)], "x int, y string")
    got = {r.column_name: (r.missing, r.missing_pct, r.n_distinct) for r in Qy.profile_columns(df).collect()}
    assert got == {"x": (0, 0.0, 2), "y": (2, 66.7, 1)}
    assert {r.n_distinct for r in Qy.profile_columns(df, exact=False).collect()} == {2, 1}


def test_float_text_is_the_shortest_name(spark):
    values = [0.0, 0.5, 2.0, 1e-5, 1.25e-7, 0.0001, 0.00025, 0.001, 123456.75, 1e7, 12345678.5, 1e15, 1e16, 1.5e22, -0.0002,
              -3e8, 2.2250738585072014e-308, 1.7976931348623157e308]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", L.float_text("v").alias("t")).collect()
    assert [r.t for r in rows] == [repr(r.v) for r in rows]


def test_importance_is_ranked_before_rounding(spark):
    df = spark.createDataFrame([("a", 0.10001), ("b", 0.10002), ("c", 0.3)], "feature string, importance double")
    assert [r.column for r in rank_importance(df, 2).collect()] == ["c", "b", "a"]


def test_stream_of_a_folder_of_part_files(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    cols = REQ_COLS.split(", ")
    batch = sorted(tuple(r) for r in requests(spark, SF).select(*cols).collect())
    streamed = run_available(request_stream(spark, str(tmp_path)), "folder").select(*cols)
    assert sorted(tuple(r) for r in streamed.collect()) == batch
