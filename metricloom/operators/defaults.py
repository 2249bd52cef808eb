"""Default aggregations every model gets: counts, sums and sketches in 5-minute buckets.

All of them are mergeable, so wider intervals are roll-ups of these rows; rates are
derived only after the roll-up. ``segments`` become dimensions of the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions import sketches
from metricloom.functions.timebuckets import bucket_start

WIDTH = "5 minutes"


def _series(df: DataFrame, ts: str, bucket: str, keys: Sequence, **values: Column) -> DataFrame:
    rows = df.filter(F.col(ts).isNotNull())
    return rows.groupBy(bucket_start(ts, bucket).alias("bucket"), *keys).agg(
        *[c.alias(name) for name, c in values.items()]
    )


def inference_count(df: DataFrame, *, ts: str, bucket: str = WIDTH, segments: Sequence[str] = ()) -> DataFrame:
    return _series(df, ts, bucket, segments, inference_count=F.count(F.lit(1)))


def null_count(df: DataFrame, *, ts: str, column: str, bucket: str = WIDTH,
               segments: Sequence[str] = ()) -> DataFrame:
    return _series(df, ts, bucket, segments, null_count=F.count_if(F.col(column).isNull()))


def category_count(df: DataFrame, *, ts: str, column: str, bucket: str = WIDTH,
                   segments: Sequence[str] = ()) -> DataFrame:
    return _series(df, ts, bucket, [*segments, F.col(column).alias("category")], category_count=F.count(F.lit(1)))


def numeric_distribution(df: DataFrame, *, ts: str, column: str, bucket: str = WIDTH, segments: Sequence[str] = (),
                         with_sketch: bool = False) -> DataFrame:
    """Count, min, max, mean and deviation, optionally with the mergeable sketch itself."""
    v = F.col(column).cast("double")
    values = {
        "n": F.count(v), "min_value": F.min(v), "max_value": F.max(v),
        "avg_value": F.avg(v), "stddev_value": F.stddev_samp(v),
    }
    if with_sketch:
        values["sketch"] = sketches.build(v)
    return _series(df, ts, bucket, segments, **values)


def numeric_sum(df: DataFrame, *, ts: str, column: str, bucket: str = WIDTH,
                segments: Sequence[str] = ()) -> DataFrame:
    return _series(df, ts, bucket, segments, numeric_sum=F.sum(F.col(column).cast("double")))


def count_by_class(df: DataFrame, *, ts: str, label: str, bucket: str = WIDTH,
                   segments: Sequence[str] = ()) -> DataFrame:
    return _series(df, ts, bucket, [*segments, F.col(label).cast("string").alias("label")],
                   class_count=F.count(F.lit(1)))


def count_by_threshold(df: DataFrame, *, ts: str, score: str, threshold: float, true_label: str, false_label: str,
                       bucket: str = WIDTH, segments: Sequence[str] = ()) -> DataFrame:
    label = F.when(F.col(score) >= threshold, F.lit(true_label)).when(F.col(score) < threshold, F.lit(false_label))
    return _series(df.filter(F.col(score).isNotNull()), ts, bucket, [*segments, label.alias("label")],
                   class_count=F.count(F.lit(1)))


def flagged_count(df: DataFrame, *, ts: str, condition: Column, name: str, bucket: str = WIDTH,
                  segments: Sequence[str] = ()) -> DataFrame:
    """Rows of already scored data that meet a condition: hallucinations, PII hits, failed claims, tool errors."""
    return _series(df, ts, bucket, segments, **{name: F.count_if(condition)})


def result_count(df: DataFrame, *, ts: str, results: Sequence[str], name: str = "inference_count",
                 bucket: str = WIDTH) -> DataFrame:
    """Rows per outcome column(s): pass/fail of prompts and responses, rule results, evaluator verdicts."""
    return _series(df, ts, bucket, results, **{name: F.count(F.lit(1))})


def token_count(df: DataFrame, *, ts: str, tokens: str, bucket: str = WIDTH,
                segments: Sequence[str] = ()) -> DataFrame:
    return _series(df, ts, bucket, segments, token_count=F.sum(F.col(tokens).cast("double")))


def trace_count(df: DataFrame, *, ts: str, trace_id: str, bucket: str = WIDTH,
                segments: Sequence[str] = ()) -> DataFrame:
    return _series(df, ts, bucket, segments, trace_count=F.count_distinct(trace_id))


def score_sketch(df: DataFrame, *, ts: str, score: str, bucket: str = WIDTH,
                 segments: Sequence[str] = ()) -> DataFrame:
    """Distribution of a score (toxicity, PII, rule latency, hallucination intensity) by dimension."""
    rows = df.filter(F.col(score).isNotNull())
    return _series(rows, ts, bucket, segments, value=sketches.build(score))
