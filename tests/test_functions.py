from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.functions import labels, numeric, sketches, timebuckets
from metricloom.session import scratch_path


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("width, expected", [
    ("5 minutes", datetime(2024, 1, 4, 13, 35)),
    ("1 hour", datetime(2024, 1, 4, 13)),
    ("6 hours", datetime(2024, 1, 4, 12)),
    ("1 day", datetime(2024, 1, 4)),
    ("1 week", datetime(2024, 1, 1)),
    ("2 weeks", datetime(2024, 1, 1)),
    ("1 month", datetime(2024, 1, 1)),
    ("1 year", datetime(2024, 1, 1)),
])
def test_bucket_start(spark, width, expected):
    ts = F.lit("2024-01-04 13:37:11").cast("timestamp")
    assert one(spark, timebuckets.bucket_start(ts, width)) == expected


def test_week_windows_start_on_monday_like_batch_buckets(spark):
    df = spark.sql("SELECT timestamp'2024-01-04 13:37:11' AS ts")
    size, slide, offset = timebuckets.window_args("1 week")
    assert df.select(F.window("ts", size, slide, offset).start).first()[0] == datetime(2024, 1, 1)


def test_unknown_width_is_refused():
    with pytest.raises(ValueError):
        timebuckets.parse_width("3 fortnights")


def test_since_counts_back_from_the_newest_row(spark):
    df = spark.sql("SELECT timestamp'2024-01-31 10:00:00' AS ts UNION ALL SELECT timestamp'2024-01-01 00:00:00' "
                   "UNION ALL SELECT timestamp'2023-12-31 23:59:59'")
    assert timebuckets.since(df, "ts", 30).count() == 2
    assert timebuckets.since(df, "ts", 30, as_of="2024-03-01").count() == 1


def test_optional_filter_needs_both_bounds(spark):
    df = spark.sql("SELECT timestamp'2024-01-31' AS ts UNION ALL SELECT timestamp'2023-01-01'")
    assert timebuckets.between(df, "ts", start="2024-01-01").count() == 2
    assert timebuckets.between(df, "ts", "2024-01-01", "2024-12-31").count() == 1


def test_clamped_bins(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (4.99,), (10.0,), (99.0,), (None,)], "v double")
    bins = [r[0] for r in df.select(numeric.clamped_bin(F.col("v"), F.lit(0.0), F.lit(10.0), 10)).collect()]
    assert bins == [1, 1, 5, 10, 10, 1]
    constant = numeric.clamped_bin(F.lit(3.0), F.lit(3.0), F.lit(3.0), 10)
    assert one(spark, constant) == 1


def test_guarded_ratios(spark):
    assert one(spark, numeric.ratio_or_zero(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, numeric.ratio_or_null(F.lit(1.0), F.lit(0.0))) is None


def test_label_sets_drop_null_empty_and_repeated_labels(spark):
    df = spark.createDataFrame([(["b", "a", None, "", "b"], [0.5, None, 0.1, 0.2, 0.9]), (None, None)],
                               "l array<string>, c array<double>")
    rows = df.select(labels.named_labels("l"), labels.label_count("l"), labels.label_pairs("l")).collect()
    assert rows[0][0] == ["b", "a"] and rows[0][1] == 5
    assert [tuple(p) for p in rows[0][2]] == [("a", "b")]
    assert rows[1][0] == [] and rows[1][1] == 0 and rows[1][2] == []
    scored = labels.explode_confidences(df.select(labels.scored_labels("l", "c").alias("s")), [], "s")
    assert sorted(map(tuple, scored.collect())) == [("a", 0.0), ("b", 0.5)]


def test_second_scored_occurrence_counts_when_the_first_has_no_confidence(spark):
    df = spark.createDataFrame([(["a", "a"], [None, 0.7])], "l array<string>, c array<double>")
    scored = labels.explode_confidences(df.select(labels.scored_labels("l", "c").alias("s")), [], "s")
    assert [tuple(r) for r in scored.collect()] == [("a", 0.7)]


def test_sketch_rank_error_and_merge(spark):
    df = spark.range(20000).select((F.col("id") * 1.0).alias("v"), (F.col("id") % 7).alias("g"))
    parts = df.groupBy("g").agg(sketches.build("v").alias("s"))
    row = parts.agg(sketches.merge("s").alias("s")).select(
        sketches.count("s"), sketches.quantile("s", 0.5), sketches.min_item("s"), sketches.max_item("s"),
        sketches.pmf("s", [5000.0, 10000.0, 15000.0]),
    ).first()
    assert row[0] == 20000 and row[2] == 0.0 and row[3] == 19999.0
    assert abs(row[1] - 10000) < 20000 * 0.03
    assert np.allclose(row[4], 0.25, atol=0.03) and abs(sum(row[4]) - 1) < 1e-9


class FakeSession:
    """A session with one setting, as the real one only takes it at start."""

    def __init__(self, root, master):
        self.conf = {"spark.checkpoint.dir": root} if root else {}
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return self.conf


def test_scratch_path_follows_the_session_setting():
    assert scratch_path(FakeSession("/shared/root/", "yarn"), "x").startswith("/shared/root/x-")
    with pytest.raises(RuntimeError):
        scratch_path(FakeSession(None, "yarn"), "x")
    assert "metricloom-" in scratch_path(FakeSession(None, "local[2]"), "x")
