from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from metricloom.functions import sketches
from metricloom.operators import binary, timeseries
from metricloom.plans import charts, commits, store as S
from metricloom.plans.definitions import Binding, DefinitionRegistry, MetricDefinition, rebind, sql_metric
from metricloom.streaming import metrics as stream_metrics
from tests.conftest import day

POINTS = "model_id string, metric_name string, timestamp timestamp, metric_version int, value double, dimensions map<string,string>"


def test_latest_version_keeps_every_dimension_of_the_newest_run(spark):
    rows = [
        ("m", "x", day(1), 1, 1.0, {"s": "a"}), ("m", "x", day(1), 2, 2.0, {"s": "a"}), ("m", "x", day(1), 2, 3.0, {"s": "b"}),
        ("m", "x", day(2), 1, 4.0, {"s": "a"}), ("n", "x", day(1), 1, 5.0, {}),
    ]
    out = S.latest_version(spark.createDataFrame(rows, POINTS)).collect()
    assert sorted(r["value"] for r in out) == [2.0, 3.0, 4.0, 5.0]
    assert {r["max_version_for_timestamp"] for r in out if r["model_id"] == "m" and r["timestamp"] == day(1)} == {2}


def test_write_is_repeatable_and_versions_grow(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = spark.createDataFrame([(day(1), 1.0, 2.0, "a")], "bucket timestamp, u double, v double, s string")
    reports = [S.ReportedMetric("u", "u", dimensions=("s",)), S.ReportedMetric("v", "v")]
    points = S.to_long(frame, reports, model_id="m")
    assert S.next_version(spark, path) == 0
    for _ in range(2):
        S.write_points(points, path, version=0, run_id="first")
    assert S.read_store(spark, path).count() == 2
    assert S.append_recomputed(points, path) == 1
    rows = {r["metric_name"]: r for r in S.latest_version(S.read_store(spark, path)).collect()}
    assert rows["u"]["dimensions"] == {"s": "a"} and rows["v"]["dimensions"] == {} and rows["v"]["metric_version"] == 1


def test_metric_and_time_filters_prune_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = spark.createDataFrame([(day(1), 1.0, 2.0)], "bucket timestamp, u double, v double")
    S.write_points(S.to_long(frame, [S.ReportedMetric("u", "u"), S.ReportedMetric("v", "v")], model_id="m"), path, version=0)
    chosen = S.select_points(S.read_store(spark, path), ["u"], start=day(1), end=day(2))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "metric_name" in partition_filters and "year" in partition_filters
    assert chosen.count() == 1


def test_gapfill_spine_is_half_open_and_keeps_null_series(spark):
    rows = [(day(2), "a", 1.0), (day(4), None, 2.0)]
    points = spark.createDataFrame(rows, "bucket timestamp, s string, v double")
    out = timeseries.gapfill(points, bucket="bucket", start=day(1), end=day(5), width="1 day", series=["s"], values=["v"])
    got = {(r["s"], r["bucket"].day): r["v"] for r in out.collect()}
    assert len(got) == 8 and got["a", 2] == 1.0 and got[None, 4] == 2.0 and got["a", 3] is None
    carried = {(r["s"], r["bucket"].day): r["v"]
               for r in timeseries.locf(out, bucket="bucket", value="v", series=["s"]).collect()}
    assert carried["a", 1] is None and carried["a", 4] == 1.0


def test_chart_shows_zero_for_gaps(spark):
    df = spark.createDataFrame([("m", "rmse", day(2), 1, 5.0, {})], POINTS)
    out = charts.gapfill_series(df, charts.CHARTS["rmse-over-time"], start=day(1), end=day(4)).collect()
    assert [(r["bucket"].day, r["friendly_name"], r["metric_value"]) for r in out] == [
        (1, "Root Mean Squared Error", 0.0), (2, "Root Mean Squared Error", 5.0), (3, "Root Mean Squared Error", 0.0)]


def test_all_charts_are_known():
    assert len(charts.CHARTS) == 49


def test_sql_metric_binds_columns_and_literals(spark):
    df = spark.createDataFrame([(day(1), "a"), (day(1), "b"), (day(1), "a")], "t timestamp, c string")
    sql = "SELECT count(*) AS n FROM {dataset} WHERE IDENTIFIER(:col) = :value"
    out = sql_metric(spark, sql, datasets={"dataset": df}, columns={"col": "c"}, literals={"value": "a"})
    assert out.first()["n"] == 2
    with pytest.raises(ValueError, match="col=missing"):
        sql_metric(spark, sql, datasets={"dataset": df}, columns={"col": "missing"}, literals={"value": "a"})


def test_rebinding_and_pinned_versions(spark):
    report = [S.ReportedMetric("npv", "npv")]
    old = MetricDefinition("npv", binary.negative_predictive_value, ("ts", "label", "score"), report, {"threshold": 0.5})
    new = MetricDefinition("npv", binary.negative_predictive_value, ("ts", "label", "score"), report, {"threshold": 0.9},
                           version=2)
    registry = DefinitionRegistry()
    registry.register(old)
    registry.register(new)
    assert registry.get("npv").version == 2 and registry.get("npv", 1).literal_args == {"threshold": 0.5}
    with pytest.raises(ValueError):
        registry.register(old)
    with pytest.raises(KeyError):
        registry.get("npv", 3)
    df = spark.createDataFrame([(day(1), 0, 0.2, "x")], "ts timestamp, y int, p double, seg string")
    binding = Binding(old, {"ts": "ts", "label": "label", "score": "score"}, segmentation=("seg",))
    assert rebind(binding, df.schema) is None
    again = rebind(binding, df.schema, {"label": "y", "score": "p"})
    row = again.points(df, model_id="m").first()
    assert row["value"] == 1.0 and row["dimensions"] == {"seg": "x"}
    assert rebind(again, df.drop("seg").schema) is None


def write_batch(spark, path, rows):
    spark.createDataFrame(rows, "ts timestamp, seg string, v double").coalesce(1).write.mode("append").parquet(path)


def test_stream_corrects_late_rows_and_keeps_other_dimensions(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "store", "checkpoint"))

    def run():
        stream = spark.readStream.schema("ts timestamp, seg string, v double").parquet(source)
        aggregated = stream_metrics.windowed(stream, ts="ts", aggregates={"n": F.count(F.lit(1)), "total": F.sum("v")},
                                             group_by=["seg"])
        stream_metrics.start_numeric_stream(aggregated, path, checkpoint, metrics=["n", "total"], model_id="m",
                                            dimensions=["seg"]).awaitTermination()
        rows = S.latest_version(S.read_store(spark, path)).filter("metric_name = 'total'").collect()
        return {(r["timestamp"], r["dimensions"]["seg"]): r["value"] for r in rows}

    at = day(1, 12, 2)
    write_batch(spark, source, [(at, "a", 1.0), (at, "b", 10.0), (day(1, 13), "a", 7.0)])
    bucket = day(1, 12)
    assert run() == {(bucket, "a"): 1.0, (bucket, "b"): 10.0, (day(1, 13), "a"): 7.0}
    # An hour late: corrects its bucket as a new version and leaves segment b as it was.
    write_batch(spark, source, [(at + timedelta(minutes=1), "a", 2.0)])
    assert run()[bucket, "a"] == 3.0 and run()[bucket, "b"] == 10.0
    # The watermark is two hours behind 20:00 by the next batch; noon is then closed.
    write_batch(spark, source, [(day(1, 20), "a", 1.0)])
    run()
    write_batch(spark, source, [(at, "a", 100.0)])
    assert run()[bucket, "a"] == 3.0


def test_writers_with_equal_versions_keep_each_others_points(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = spark.createDataFrame([(day(1), 1.0, 2.0)], "bucket timestamp, u double, v double")
    u, v = (S.to_long(frame, [S.ReportedMetric(n, n)], model_id="m") for n in "uv")
    S.write_points(u, path, version=0)
    S.write_points(v, path, version=0)
    S.write_points(u.withColumn("value", F.lit(5.0)), path, version=0, run_id="zz")
    kept = S.latest_version(S.read_store(spark, path)).collect()
    assert sorted((r["metric_name"], r["value"]) for r in kept) == [("u", 5.0), ("v", 2.0)]
    with pytest.raises(ValueError, match="folder name"):
        S.write_points(u, path, version=0, run_id="a/b")


def test_two_streams_a_batch_run_and_a_restart_share_a_store(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "store")

    def run(metric, checkpoint):
        stream = spark.readStream.schema("ts timestamp, seg string, v double").parquet(source)
        aggregated = stream_metrics.windowed(stream, ts="ts", aggregates={metric: F.sum("v")})
        stream_metrics.start_numeric_stream(aggregated, path, str(tmp_path / checkpoint), metrics=[metric],
                                            model_id="m").awaitTermination()

    def latest():
        return {(r["metric_name"], r["timestamp"]): r["value"] for r in S.latest_version(S.read_store(spark, path)).collect()}

    write_batch(spark, source, [(day(1, 12), "a", 1.0)])
    run("x", "c1")
    run("y", "c2")
    assert latest() == {("x", day(1, 12)): 1.0, ("y", day(1, 12)): 1.0}
    old = spark.createDataFrame([(day(1, 3), 9.0)], "bucket timestamp, x double")
    S.append_recomputed(S.to_long(old, [S.ReportedMetric("x", "x")], model_id="m"), path)
    write_batch(spark, source, [(day(1, 12), "a", 2.0)])
    run("x", "c1")
    run("y", "restarted")
    assert latest() == {("x", day(1, 12)): 3.0, ("y", day(1, 12)): 3.0, ("x", day(1, 3)): 9.0}


def test_sketch_points_merge_to_all_rows(spark):
    df = spark.range(3000).select((F.lit(day(1)) + F.expr("make_interval(0,0,0,0,0,0,id)")).alias("ts"),
                                  F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("s"))
    fine = S.sketch_points(df, ts="ts", value="v", metric_name="v", model_id="m", dimensions=["s"])
    assert fine.count() == 20
    assert fine.agg(sketches.count(sketches.merge("value"))).first()[0] == 3000


def points_of(spark, rows):
    return spark.createDataFrame([("m", "x", at, v, {}) for at, v in rows],
                                 "model_id string, metric_name string, timestamp timestamp, value double, dimensions map<string,string>")


def test_writers_that_pick_the_same_number(spark, tmp_path):
    """Both writers' points are seen, and where they meet the later record wins, whatever the run ids are."""
    for first, second in (("zzz", "aaa"), ("aaa", "zzz")):
        path = str(tmp_path / first)
        chosen = S.next_version(spark, path)
        assert S.next_version(spark, path) == chosen == 0
        S.write_points(points_of(spark, [(day(1), 1.0), (day(2), 1.0)]), path, version=chosen, run_id=first)
        S.write_points(points_of(spark, [(day(2), 2.0), (day(3), 2.0)]), path, version=chosen, run_id=second)
        seen = {r.timestamp: r.value for r in S.latest_version(S.read_store(spark, path)).collect()}
        assert seen == {day(1): 1.0, day(2): 2.0, day(3): 2.0}
        # The first run is repeated: it keeps its place behind the second one.
        S.write_points(points_of(spark, [(day(1), 5.0), (day(2), 5.0)]), path, version=chosen, run_id=first)
        assert {r.timestamp: r.value for r in S.latest_version(S.read_store(spark, path)).collect()} == {
            day(1): 5.0, day(2): 2.0, day(3): 2.0}
    with pytest.raises(ValueError, match="has version 0"):
        S.write_points(points_of(spark, [(day(1), 1.0)]), path, version=3, run_id="zzz")


def test_concurrent_runs_get_different_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "store")
    with ThreadPoolExecutor(8) as pool:
        records = list(pool.map(lambda i: commits.reserve(spark, path, f"run-{i}", None), range(24)))
    assert sorted(r.number for r in records) == sorted(r.version for r in records) == list(range(24))
    assert commits.reserve(spark, path, "run-7", None) == records[7] and S.next_version(spark, path) == 24
    # A chosen version in the past does not set the newest one back.
    assert commits.reserve(spark, path, "old", 3).newest == 23 and commits.reserve(spark, path, "new", None).version == 24


def test_a_lost_writer_does_not_stop_the_log(spark, tmp_path, monkeypatch):
    path = tmp_path / "store"
    assert commits.reserve(spark, str(path), "a", 4).number == 0
    (path / "_commits" / f"{1:012d}").write_text("")
    monkeypatch.setattr(commits, "LOST_SECONDS", 0.2)
    record = commits.reserve(spark, str(path), "b", None)
    assert (record.number, record.version) == (2, 5)


def test_compaction_keeps_what_counts(spark, tmp_path):
    path = str(tmp_path / "store")
    assert S.compact(spark, path) == 0
    for n in range(5):
        S.append_recomputed(points_of(spark, [(day(d), float(10 * n + d)) for d in range(1, 6 - n)]), path)
    before = {r.timestamp: (r.value, r.metric_version) for r in S.latest_version(S.read_store(spark, path)).collect()}
    assert S.compact(spark, path) == 5 and len(commits.run_folders(spark, path)) == 1
    rows = S.read_store(spark, path).collect()
    assert {r.timestamp: (r.value, r.metric_version) for r in rows} == before and len(rows) == 5
    # The next run is newer than all that was compacted.
    version = S.append_recomputed(points_of(spark, [(day(1), -1.0)]), path)
    assert version > 4 and {r.timestamp: r.value for r in S.latest_version(S.read_store(spark, path)).collect()}[day(1)] == -1.0
