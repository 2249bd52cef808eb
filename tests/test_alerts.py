from __future__ import annotations

import csv
import glob
from datetime import datetime

import pytest

from metricloom.operators import alerts
from metricloom.plans import store as S
from metricloom.sources.writers import write_evidence_csv
from tests.conftest import day

POINTS = "metric_name string, timestamp timestamp, value double"
DAY = 86400


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), alerts.RULE_SCHEMA)


def test_window_is_open_at_its_start_and_missing_values_never_fire(spark):
    store = spark.createDataFrame([("x", day(1), 100.0), ("x", day(1, 1), 4.0), ("x", day(2), 6.0), ("x", day(2, 1), 99.0)], POINTS)
    ruleset = rules(
        spark,
        ("mean", "x", "avg", 4.9, "upper", DAY, False), ("floor", "x", "sum", 10.0, "lower", DAY, False),
        ("silent", "y", "avg", 1.0, "lower", DAY, False), ("no-traffic", "y", "sum", 1.0, "lower", DAY, True),
    )
    out = {r["rule_id"]: (r["metric_value"], r["fires"]) for r in alerts.evaluate_rules(store, ruleset, as_of=day(2)).collect()}
    assert out == {"mean": (5.0, True), "floor": (10.0, False), "silent": (None, False), "no-traffic": (0.0, True)}


def series(spark, *values):
    return spark.createDataFrame([(day(i + 1), float(v)) for i, v in enumerate(values) if v is not None],
                                 "t timestamp, v double")


def test_missing_period_ends_a_run(spark):
    out = alerts.consecutive_violations(series(spark, 1, 1, None, 1, 9, 1, 1, 1), bucket="t", value="v", threshold=5.0,
                                        bound="lower", periods=2).collect()
    assert [(r["t"].day, r["run_length"], r["fires"]) for r in out] == [
        (1, 1, False), (2, 2, True), (4, 1, False), (6, 1, False), (7, 2, True), (8, 3, True)]


def test_trailing_average_and_deviation(spark):
    df = series(spark, 10, 12, 8, 10, 40, 1)
    drop = alerts.against_trailing_average(df, bucket="t", value="v", lookback="30 days", below=0.5, above=1.5).collect()
    assert [r["fires"] for r in drop] == [False, False, False, False, True, True] and drop[0]["trailing_avg"] is None
    far = alerts.deviation_from_baseline(df, bucket="t", value="v").collect()
    assert [r["fires"] for r in far] == [False, False, True, False, True, False]


def test_week_change_and_rising_trend(spark):
    change = alerts.period_change(series(spark, 100, 119, 80), bucket="t", value="v").collect()
    assert [r["fires"] for r in change] == [False, False, True]
    rising = alerts.rising_trend(series(spark, *range(1, 9)), bucket="t", value="v").collect()
    assert [r["fires"] for r in rising] == [False] * 6 + [True] * 2


def test_audit_rows_are_text_with_the_earliest_alert(spark, tmp_path):
    store = spark.createDataFrame([("x", day(1, 3), 0.5), ("x", day(2, 3), 0.9)], POINTS)
    ruleset = rules(spark, ("r1", "x", "avg", 0.8, "lower", DAY, False), ("r2", "x", "avg", 0.8, "upper", DAY, False))
    fired = spark.createDataFrame([("r1", "late", day(1, 9)), ("r1", "early", day(1, 7))],
                                  "rule_id string, alert_id string, alert_timestamp timestamp")
    rows = alerts.audit_evidence(store, ruleset, metric_name="x", model_id="m", start="2024-01-01", end="2024-01-03",
                                 generated_at="now", fired=fired)
    write_evidence_csv(rows, str(tmp_path / "audit"))
    (path,) = glob.glob(str(tmp_path / "audit" / "*.csv"))
    with open(path, newline="") as f:
        lines = list(csv.DictReader(f))
    assert tuple(lines[0]) == alerts.EVIDENCE_COLUMNS
    assert [r["date"] for r in lines] == ["2024-01-01"] * 2 + ["2024-01-02"] * 2 + ["2024-01-03"] * 2
    first = next(r for r in lines if r["date"] == "2024-01-01" and r["threshold_operator"] == "<")
    assert (first["metric_value"], first["control_pass"], first["alert_expected"], first["alert_fired"],
            first["alert_id"], first["alert_timestamp"]) == ("0.5", "false", "true", "true", "early", "2024-01-01T07:00:00Z")
    empty = next(r for r in lines if r["date"] == "2024-01-03")
    assert empty["metric_value"] == empty["control_pass"] == "" and empty["alert_fired"] == "false"
    bare = alerts.audit_evidence(store, ruleset, metric_name="y", model_id="m", start="2024-01-01", end="2024-01-02",
                                 generated_at="now").collect()
    assert len(bare) == 2 and bare[0]["threshold"] == "" and bare[0]["alert_fired"] == ""


@pytest.fixture
def whole_plans(spark):
    """Plans that name all their filters."""
    key = "spark.sql.maxMetadataStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "4000")
    yield
    spark.conf.set(key, before)


def test_rules_become_filters_of_the_scan(spark, tmp_path, whole_plans):
    """Only the folders of the rules' metrics and years are read, and row groups only inside the widest window."""
    path = str(tmp_path / "store")
    rows = [("m", name, datetime(year, 6, d), float(year % 100 + d), {}) for name in ("a", "b", "c") for year in (2021, 2022, 2023) for d in (1, 2, 3)]
    points = spark.createDataFrame(rows, "model_id string, metric_name string, timestamp timestamp, value double, dimensions map<string,string>")
    S.write_points(points, path, version=0)
    rules = [alerts.Rule("a-high", "a", "avg", 25.0, "upper", 2 * 86400), alerts.Rule("b-low", "b", "sum", 100.0, "lower", 3600, True),
             alerts.Rule("none", "z", "sum", 1.0, "lower", 60, True)]
    as_of = "2023-06-03 00:00:00"
    plan = alerts.read_for_rules(S.read_store(spark, path), rules, as_of=as_of)._jdf.queryExecution().executedPlan().toString()
    folders, pushed = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")], plan[plan.index("PushedFilters"):]
    assert "metric_name" in folders and "year" in folders
    assert "GreaterThan(timestamp,2023-06-01" in pushed and "LessThanOrEqual(timestamp,2023-06-03" in pushed
    store = S.read_store(spark, path)
    got = {r.rule_id: (r.metric_value, r.fires) for r in alerts.evaluate_stored(store, rules, as_of=as_of).collect()}
    whole = alerts.evaluate_rules(S.latest_version(store), alerts.rule_frame(spark, rules), as_of=as_of)
    assert got == {r.rule_id: (r.metric_value, r.fires) for r in whole.collect()}
    assert got == {"a-high": (25.5, True), "b-low": (26.0, True), "none": (0.0, True)}
    # The joins of the newest versions keep the pruning on both sides.
    both = alerts.evaluate_stored(store, rules, as_of=as_of)._jdf.queryExecution().executedPlan().toString()
    scans = both.count("FileScan parquet")
    assert scans >= 2 and both.count("PushedFilters: [IsNotNull(timestamp), GreaterThan(timestamp,2023-06-01") == scans
    assert alerts.evaluate_stored(store, [], as_of=as_of).count() == 0
    for bad in (("x", "a", "median", 1.0, "upper", 60), ("x", "a", "avg", 1.0, "above", 60), ("x", "a", "avg", 1.0, "upper", 0)):
        with pytest.raises(ValueError):
            alerts.Rule(*bad)
    with pytest.raises(ValueError):
        alerts.read_for_rules(store, rules * 4000, as_of=as_of)


def test_median_shift_reads_its_window_only(spark, tmp_path, whole_plans):
    path = str(tmp_path / "sketches")
    rows = spark.createDataFrame([(datetime(2023, 6, d), float(v)) for d in range(1, 11) for v in range(20 if d < 10 else 40)], "ts timestamp, v double")
    S.write_points(S.sketch_points(rows, ts="ts", value="v", metric_name="v", model_id="m"), path, version=0)
    out = alerts.median_shift(S.read_store(spark, path, sketch=True), metric_name="v", as_of="2023-06-10 00:00:00", baseline="5 days")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(timestamp,2023-06-04" in plan and "year" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    row = out.first()
    assert (row.recent_median, row.baseline_median, row.fires) == (19.0, 9.0, True)
