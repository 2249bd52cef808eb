"""Daily label metrics kept in the store, and label listings over their last days.

``update`` computes the day and label values of all rows, or of the days that a lookback window touches, and
appends them as one run. A listing over the last 30 days then reads 30 days of a few metric folders, however long the
history of raw rows or points is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.numeric import ratio_or_null
from metricloom.operators import multilabel
from metricloom.plans.store import (
    ReportedMetric, append_recomputed, dimension, latest_version, recent_rows, select_points, to_long,
)

SERIES, PAIR = ("series",), ("label_1", "label_2")
DAY_SECONDS = 86_400


def label_points(rows: DataFrame, *, ts: str, row_id: str, predicted: str, actual: str, confidences: str, model_id: str) -> DataFrame:
    """Store rows of the day and label values: tp, fp, fn, class_count, coverage_ratio, avg_confidence and pair counts."""
    one, both = {"ts": ts, "labels": predicted}, {"ts": ts, "predicted": predicted, "actual": actual}
    frames = [
        (multilabel.confusion_per_label(rows, **both), ("tp", "fp", "fn"), SERIES),
        (multilabel.class_count(rows, **one), ("class_count",), SERIES),
        (multilabel.coverage_ratio(rows, row_id=row_id, **one), ("coverage_ratio",), SERIES),
        (multilabel.average_confidence(rows, row_id=row_id, confidences=confidences, **one), ("avg_confidence",), SERIES),
        (multilabel.label_cooccurrence(rows, row_id=row_id, **both), ("pred_cooccurrence_count", "gt_cooccurrence_count"), PAIR),
    ]
    points = None
    for frame, names, dims in frames:
        reports = [ReportedMetric(n, n, timestamp="ts", dimensions=dims) for n in names]
        each = to_long(frame, reports, model_id=model_id)
        points = each if points is None else points.unionByName(each)
    return points


def update(rows: DataFrame, path: str, *, ts: str, as_of=None, lookback_days: int | None = None, **columns) -> int:
    """Append the values of all days, or of those from ``lookback_days`` before ``as_of`` on; returns the version.

    A day's values are computed from all its rows, so whole days are replaced and late rows count.
    """
    if lookback_days is not None:
        rows = recent_rows(rows, ts=ts, as_of=as_of, lookback_seconds=lookback_days * DAY_SECONDS, width="1 day")
    return append_recomputed(label_points(rows, ts=ts, **columns), path)


def last_days(store: DataFrame, names: Sequence[str], *, days: int = 30, as_of=None) -> DataFrame:
    """The newest versions of the named metrics from ``days`` before ``as_of`` on.

    ``as_of`` defaults to the newest point of these metrics, found from their time column alone. The bounds are literals
    of the scan, which keeps the years and row groups outside the window unread.
    """
    if as_of is None:
        as_of = select_points(store, names).agg(F.max("timestamp")).first()[0]
        if as_of is None:
            return latest_version(store.filter(F.lit(False)))
    day = F.lit(as_of).cast("timestamp").cast("date")
    start, end = F.date_sub(day, days).cast("timestamp"), F.date_add(day, 1).cast("timestamp")
    return latest_version(_between(select_points(store, names), start, end))


def _between(store: DataFrame, start: Column, end: Column) -> DataFrame:
    inside = store.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    return inside.filter(F.col("year").between(F.year(start), F.year(end))) if "year" in store.columns else inside


def label_frame(store: DataFrame, names: Sequence[str], *, days: int = 30, as_of=None, dimensions: Sequence[str] = SERIES) -> DataFrame:
    """``ts``, the dimensions and one column for each metric: the frame that the listings of ``charts`` take."""
    points = last_days(store, names, days=days, as_of=as_of)
    return points.groupBy(F.col("timestamp").alias("ts"), *[dimension(d).alias(d) for d in dimensions]).agg(
        *[F.max(F.when(F.col("metric_name") == n, F.col("value"))).alias(n) for n in names])


def quality_frame(store: DataFrame, *, days: int = 30, as_of=None) -> DataFrame:
    """``ts, series, precision, recall, f1_score`` from the stored counts."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return label_frame(store, ("tp", "fp", "fn"), days=days, as_of=as_of).select(
        "ts", "series", ratio_or_null(tp, tp + fp).alias("precision"), ratio_or_null(tp, tp + fn).alias("recall"),
        ratio_or_null(2 * tp, 2 * tp + fp + fn).alias("f1_score"))
