"""ROC and precision-recall curves with one point per distinct score.

Tied scores share a threshold, so they share a curve point. Counts are collapsed
per (bucket, score) before anything is sorted, and the running counts are taken
in score blocks (see ``ordered``), so a hot bucket spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.numeric import ratio_or_null, ratio_or_zero
from metricloom.functions.timebuckets import bucket_start
from metricloom.operators.ordered import running_totals


def _threshold_points(df: DataFrame, ts: str, label: str, score: str, bucket: str, group_by: Sequence[str]):
    counts = (
        df.filter(F.col(ts).isNotNull())
        .groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by, F.col(score).cast("double").alias("threshold"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    return running_totals(counts, ["bucket", *group_by], "threshold", ["pos", "neg", "n"], descending=True)


def roc_points(df: DataFrame, *, ts: str, label: str, score: str, bucket: str = "1 day",
               group_by: Sequence[str] = ()) -> DataFrame:
    points = _threshold_points(df, ts, label, score, bucket, group_by)
    return points.select(
        "bucket", *group_by, "threshold",
        ratio_or_zero("cum_pos", "total_pos").alias("tpr"),
        ratio_or_zero("cum_neg", "total_neg").alias("fpr"),
    )


def pr_points(df: DataFrame, *, ts: str, label: str, score: str, bucket: str = "1 day",
              group_by: Sequence[str] = ()) -> DataFrame:
    points = _threshold_points(df, ts, label, score, bucket, group_by)
    return points.select(
        "bucket", *group_by, "threshold",
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        ratio_or_zero("cum_pos", "total_pos").alias("recall"),
    )


def curve_discrimination(df: DataFrame, *, ts: str, label: str, score: str, bucket: str = "1 day",
                         group_by: Sequence[str] = ()) -> DataFrame:
    """auc_roc, gini_coefficient, ks_statistic and its alias ks_score per bucket.

    The curve runs from (0,0) through the points to (1,1). The point before each
    one is its running counts without its own rows, so no LAG is needed.
    """
    points = _threshold_points(df, ts, label, score, bucket, group_by)
    tpr, fpr = ratio_or_zero("cum_pos", "total_pos"), ratio_or_zero("cum_neg", "total_neg")
    tpr_before = ratio_or_zero(F.col("cum_pos") - F.col("pos"), "total_pos")
    fpr_before = ratio_or_zero(F.col("cum_neg") - F.col("neg"), "total_neg")
    areas = points.groupBy("bucket", *group_by).agg(
        F.sum((fpr - fpr_before) * (tpr + tpr_before) / 2).alias("_area"),
        F.max(F.abs(tpr - fpr)).alias("ks_statistic"),
        # Where the last threshold leaves the curve: (1,1) unless a class is missing.
        F.max(tpr).alias("_last_tpr"),
        F.max(fpr).alias("_last_fpr"),
    )
    auc = F.col("_area") + (1 - F.col("_last_fpr")) * (1 + F.col("_last_tpr")) / 2
    return areas.select(
        "bucket", *group_by,
        auc.alias("auc_roc"),
        (2 * auc - 1).alias("gini_coefficient"),
        "ks_statistic",
        F.col("ks_statistic").alias("ks_score"),
    ).orderBy("bucket", *group_by)


def auc_relative_decrease(df: DataFrame, *, baseline_auc: float, group_by: Sequence[str] = (), **args) -> DataFrame:
    """Percentage by which the bucket's AUC fell below a fixed baseline."""
    base = F.lit(float(baseline_auc))
    return curve_discrimination(df, group_by=group_by, **args).select(
        "bucket", *group_by,
        F.col("auc_roc").alias("current_auc"),
        (ratio_or_null(base - F.col("auc_roc"), base) * 100).alias("auc_relative_decrease"),
    )


def precision_recall_areas(df: DataFrame, *, ts: str, label: str, score: str, bucket: str = "1 day",
                           group_by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area (starting at recall 0, precision 1) and step-wise average precision."""
    points = _threshold_points(df, ts, label, score, bucket, group_by)
    recall = ratio_or_zero("cum_pos", "total_pos")
    precision = F.col("cum_pos") / F.col("cum_n")
    seen_before = F.col("cum_n") - F.col("n")
    recall_before = ratio_or_zero(F.col("cum_pos") - F.col("pos"), "total_pos")
    precision_before = F.when(seen_before > 0, (F.col("cum_pos") - F.col("pos")) / seen_before).otherwise(F.lit(1.0))
    step = recall - recall_before
    return (
        points.groupBy("bucket", *group_by)
        .agg(
            F.sum(step * (precision + precision_before) / 2).alias("auprc"),
            F.sum(step * precision).alias("average_precision"),
        )
        .orderBy("bucket", *group_by)
    )
