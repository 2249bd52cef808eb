from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from metricloom.functions import sketches
from metricloom.functions.timebuckets import since
from metricloom.operators import multilabel
from metricloom.plans import charts, label_store as L, store as S
from metricloom.streaming import metrics as stream_metrics
from tests.conftest import day

COLUMNS = dict(ts="ts", row_id="id", predicted="p", actual="a", confidences="c", model_id="m")
START = datetime(2023, 11, 1, 12)


@pytest.fixture
def whole_plans(spark):
    key = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "4000")
    yield
    spark.conf.set(key, before)


def label_rows(spark, days):
    rows = []
    for d in days:
        for i in range(4):
            p = [x for x, on in (("x", i % 2 == 0), ("y", (d + i) % 3 == 0), ("z", i == 3)) if on]
            rows.append((START + timedelta(days=d), 10 * d + i, p, ["x"] if d % 2 else ["x", "y"], [0.1 * (i + 1)] * len(p)))
    return spark.createDataFrame(rows, "ts timestamp, id long, p array<string>, a array<string>, c array<double>")


def as_set(df):
    return {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()}


def test_listings_from_the_store_equal_those_from_rows(spark, tmp_path):
    path, rows = str(tmp_path / "store"), label_rows(spark, range(60))
    old = rows.filter(F.col("ts") < F.lit(START + timedelta(days=58)))
    L.update(old, path, **COLUMNS)
    # Two new days, and a late row of day 57: the lookback touches it, and the days before are left alone.
    late = spark.createDataFrame([(START + timedelta(days=57), 9999, ["z", "x"], ["z"], [0.9, 0.8])], rows.schema)
    rows = rows.unionByName(late)
    assert L.update(rows, path, as_of=START + timedelta(days=59), lookback_days=2, **COLUMNS) == 1
    store = S.read_store(spark, path)
    both = dict(ts="ts", predicted="p", actual="a")
    confusion = since(multilabel.confusion_per_label(rows, **both), "ts", 30)
    assert as_set(charts.label_totals(L.label_frame(store, ["tp", "fp", "fn"]))) == as_set(charts.label_totals(confusion))
    assert as_set(charts.label_error_rates(L.label_frame(store, ["tp", "fp", "fn"]))) == as_set(charts.label_error_rates(confusion))
    values = {"precision": "p", "recall": "r", "f1_score": "f"}
    quality = since(multilabel.precision_recall_f1(rows, **both), "ts", 30)
    assert as_set(charts.label_averages(L.quality_frame(store), values)) == as_set(charts.label_averages(quality, values))
    confidence = since(multilabel.average_confidence(rows, ts="ts", row_id="id", labels="p", confidences="c"), "ts", 30)
    assert as_set(charts.low_confidence_labels(L.label_frame(store, ["avg_confidence"]))) == as_set(charts.low_confidence_labels(confidence))
    pairs = since(multilabel.label_cooccurrence(rows, row_id="id", **both), "ts", 30)
    stored = L.label_frame(store, ["pred_cooccurrence_count", "gt_cooccurrence_count"], dimensions=L.PAIR)
    assert as_set(charts.top_pairs(stored)) == as_set(charts.top_pairs(pairs))
    earlier = L.label_frame(store, ["class_count"], as_of=START + timedelta(days=20), days=10)
    assert {r.ts.date() for r in earlier.collect()} <= {(START + timedelta(days=d)).date() for d in range(10, 21)}
    assert L.label_frame(store, ["no_such_metric"]).count() == 0


def test_only_the_window_is_read(spark, tmp_path, whole_plans):
    path, raw = str(tmp_path / "store"), str(tmp_path / "rows")
    label_rows(spark, range(0, 60, 5)).write.parquet(raw)
    rows = spark.read.parquet(raw)
    L.update(rows, path, **COLUMNS)
    plan = L.label_frame(S.read_store(spark, path), ["tp"])._jdf.queryExecution().executedPlan().toString()
    folders = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "metric_name" in folders and "year" in folders
    assert plan.count("GreaterThanOrEqual(timestamp,2023-11-26") == plan.count("FileScan parquet") >= 2
    recent = S.recent_rows(rows, ts="ts", as_of=START + timedelta(days=59), lookback_seconds=2 * 86400, width="1 day")
    points = L.label_points(recent, **COLUMNS)
    again = points._jdf.queryExecution().executedPlan().toString()
    assert again.count("GreaterThanOrEqual(ts,2023-12-28") == again.count("FileScan parquet") > 0


def test_since_moves_below_the_aggregation(spark, tmp_path, whole_plans):
    path = str(tmp_path / "rows")
    spark.range(100).select(F.timestamp_seconds(F.col("id") * 86400).alias("ts"), "id").write.parquet(path)
    daily = spark.read.parquet(path).groupBy("ts").agg(F.count(F.lit(1)).alias("n"))
    out = since(daily, "ts", 30)
    assert out.count() == 31 and "GreaterThanOrEqual(ts,1970-03-11" in out._jdf.queryExecution().executedPlan().toString()
    assert since(daily.limit(0), "ts", 30).count() == 0 and since(daily, "ts", 1, as_of="1970-01-10").count() == 92


def test_reports_of_both_kinds_come_from_the_same_rows(spark, tmp_path):
    rows = spark.createDataFrame([(day(d), s, float(v) if v % 7 else None) for d in (1, 2) for s in ("a", None) for v in range(50)]
                                 + [(None, "a", 1.0), (day(3), "a", None)], "ts timestamp, s string, v double")
    reports = [S.ReportedMetric("dist", "v", "ts", ("s",), kind="sketch"), S.ReportedMetric("n", "v", "ts", ("s",), aggregate="count"),
               S.ReportedMetric("top", "v", "ts", ("s",), aggregate="max")]
    paths = {k: str(tmp_path / k) for k in ("numeric", "sketch")}
    S.write_reports(S.report_rows(rows, reports, model_id="m", bucket="1 day"), paths)
    numbers = {(r.metric_name, r.timestamp.day, r.dimensions["s"]): r.value for r in S.read_store(spark, paths["numeric"]).collect()}
    read = S.read_store(spark, paths["sketch"], sketch=True).select("timestamp", S.dimension("s").alias("s"), sketches.count("value").alias("n"),
                                                                    sketches.max_item("value").alias("top"))
    found = {(r.timestamp.day, r.s): (r.n, r.top) for r in read.collect()}
    assert set(found) == {(1, "a"), (1, None), (2, "a"), (2, None)} and numbers["n", 3, "a"] == 0
    assert all((numbers["n", *k], numbers["top", *k]) == v for k, v in found.items())
    for bad in (dict(kind="histogram"), dict(aggregate="median"), dict(kind="sketch", aggregate="sum")):
        with pytest.raises(ValueError):
            S.ReportedMetric("x", "v", **bad)
    with pytest.raises(ValueError, match="share"):
        S.report_rows(rows, [reports[0], S.ReportedMetric("y", "v", "ts", aggregate="sum")], model_id="m")
    with pytest.raises(ValueError, match="finished"):
        S.ReportedMetric("x", "v").column()


def test_streamed_reports_follow_late_rows(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    paths = {k: str(tmp_path / k) for k in ("numeric", "sketch")}
    reports = [S.ReportedMetric("dist", "v", dimensions=("s",), kind="sketch"), S.ReportedMetric("n", "v", dimensions=("s",), aggregate="count")]

    def run(rows):
        spark.createDataFrame(rows, "ts timestamp, s string, v double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, s string, v double").parquet(source)
        stream_metrics.start_report_stream(stream, paths, checkpoint, ts="ts", reports=reports, model_id="m", width="1 hour").awaitTermination()
        numbers = S.latest_version(S.read_store(spark, paths["numeric"])).collect()
        held = S.latest_version(S.read_store(spark, paths["sketch"], sketch=True)).select(
            "timestamp", "dimensions", sketches.count("value").alias("n")).collect()
        counts = {(r.timestamp.hour, r.dimensions["s"]): r.value for r in numbers}
        assert counts == {(r.timestamp.hour, r.dimensions["s"]): r.n for r in held}
        return counts

    assert run([(day(1, 9), "a", 1.0), (day(1, 10), "a", 2.0), (day(1, 10), "b", 3.0)]) == {(9, "a"): 1, (10, "a"): 1, (10, "b"): 1}
    # One row late but inside the two hours, one beyond them.
    assert run([(day(1, 10, 30), "a", 5.0), (day(1, 3), "a", 5.0)]) == {(9, "a"): 1, (10, "a"): 2, (10, "b"): 1}
