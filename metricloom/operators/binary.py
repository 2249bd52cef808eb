"""Threshold metrics of binary classifiers: one scan, one partial aggregation per metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.numeric import flag, ratio_or_null, ratio_or_zero
from metricloom.functions.timebuckets import bucket_start
from metricloom.operators.common import bucketed


def confusion_counts(df: DataFrame, *, ts: str, label: str, score: str, threshold: float = 0.5,
                     bucket: str = "1 day", group_by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn per bucket; rows with a NULL score or label count nowhere."""
    positive, negative = F.col(label) == 1, F.col(label) == 0
    hit, miss = F.col(score) >= threshold, F.col(score) < threshold
    return df.groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by).agg(
        F.count_if(positive & hit).cast("double").alias("tp"),
        F.count_if(negative & hit).cast("double").alias("fp"),
        F.count_if(negative & miss).cast("double").alias("tn"),
        F.count_if(positive & miss).cast("double").alias("fn"),
    )


def confusion_from_labels(df: DataFrame, *, ts: str, label: str, prediction: str, true_label=1, false_label=0,
                          bucket: str = "1 day", group_by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn from predicted labels of any type (numbers, booleans, strings)."""
    truth, guess = F.col(label), F.col(prediction)
    true_value, false_value = F.lit(true_label), F.lit(false_label)
    return df.groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by).agg(
        F.count_if((truth == true_value) & (guess == true_value)).cast("double").alias("tp"),
        F.count_if((truth == false_value) & (guess == true_value)).cast("double").alias("fp"),
        F.count_if((truth == false_value) & (guess == false_value)).cast("double").alias("tn"),
        F.count_if((truth == true_value) & (guess == false_value)).cast("double").alias("fn"),
    )


def detection_acceptance_profile(df: DataFrame, *, group_by: Sequence[str] = (), **args) -> DataFrame:
    counts = confusion_counts(df, group_by=group_by, **args)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    recall = ratio_or_zero(tp, tp + fn)
    return counts.select(
        "bucket", *group_by,
        recall.alias("capture_rate"),
        ratio_or_zero(tp, total).alias("correct_detection_rate"),
        recall.alias("true_positive_rate"),
        recall.alias("true_detection_rate"),
        ratio_or_zero(tp, tp + fp).alias("precision"),
        ratio_or_zero(tn, total).alias("correct_acceptance_rate"),
        ratio_or_zero(tp + tn, total).alias("valid_detection_rate"),
    ).orderBy("bucket", *group_by)


def negative_predictive_value(df: DataFrame, *, group_by: Sequence[str] = (), **args) -> DataFrame:
    counts = confusion_counts(df, group_by=group_by, **args)
    return counts.select(
        "bucket", *group_by,
        ratio_or_null("tn", F.col("tn") + F.col("fn")).alias("npv"),
        ratio_or_null("tn", F.col("tn") + F.col("fp")).alias("specificity"),
    ).orderBy("bucket", *group_by)


def positive_class_error_profile(df: DataFrame, *, group_by: Sequence[str] = (), **args) -> DataFrame:
    """Error shares per bucket; the last column is the share over all buckets of the result."""
    counts = confusion_counts(df, group_by=group_by, **args)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    # One row, so the broadcast has a fixed size; a window over everything would use one task.
    overall = counts.agg(ratio_or_zero(F.sum(fp), F.sum(total)).alias("total_false_positive_rate"))
    return (
        counts.crossJoin(F.broadcast(overall))
        .select(
            "bucket", *group_by,
            ratio_or_zero(fp, fp + tn).alias("adjusted_false_positive_rate"),
            ratio_or_zero(tp + fn, total).alias("bad_case_rate"),
            ratio_or_zero(fp, total).alias("false_positive_ratio"),
            ratio_or_zero(tp + tn, total).alias("valid_detection_rate"),
            F.greatest(ratio_or_zero(fp - fn, total), F.lit(0.0)).alias("overprediction_rate"),
            F.greatest(ratio_or_zero(fn - fp, total), F.lit(0.0)).alias("underprediction_rate"),
            "total_false_positive_rate",
        )
        .orderBy("bucket", *group_by)
    )


def subgroup_rate_comparison(df: DataFrame, *, ts: str, label: str, score: str, group: str, group_a, group_b,
                             threshold: float = 0.5, bucket: str = "1 day",
                             group_by: Sequence[str] = ()) -> DataFrame:
    """Signed gap of selection rates and relative gap of bad rates between two groups."""
    in_a, in_b = F.col(group) == F.lit(group_a), F.col(group) == F.lit(group_b)
    selected, bad = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by).agg(
        *[
            F.count_if(member & condition).cast("double").alias(f"{what}_{side}")
            for side, member in (("a", in_a), ("b", in_b))
            for what, condition in (("n", F.lit(True)), ("selected", selected), ("bad", bad))
        ]
    )
    rates = counts.select(
        "bucket", *group_by,
        (ratio_or_zero("selected_a", "n_a") - ratio_or_zero("selected_b", "n_b")).alias("rate_difference"),
        ratio_or_zero("bad_a", "n_a").alias("_bad_a"),
        ratio_or_zero("bad_b", "n_b").alias("_bad_b"),
    )
    return rates.select(
        "bucket", *group_by, "rate_difference",
        ratio_or_zero(F.col("_bad_a") - F.col("_bad_b"), "_bad_b").alias("relative_bad_rate_difference"),
    ).orderBy("bucket", *group_by)


def gini_impurity(df: DataFrame, *, ts: str, score: str, threshold: float = 0.5, bucket: str = "1 day",
                  group_by: Sequence[str] = ()) -> DataFrame:
    """Impurity of the predicted classes; not the Gini coefficient of the ROC curve."""
    share = F.count_if(F.col(score) >= threshold) / F.count(F.lit(1))
    counts = df.groupBy(bucket_start(ts, bucket).alias("ts"), *group_by).agg(share.alias("_p"))
    p = F.col("_p")
    return counts.select("ts", *group_by, (1 - (p * p + (1 - p) * (1 - p))).alias("gini_impurity")).orderBy(
        "ts", *group_by
    )


def classification_rates(df: DataFrame, *, group_by: Sequence[str] = (), **args) -> DataFrame:
    """Counts with accuracy, precision, recall, F1 and the four confusion rates; zero denominators give NULL."""
    counts = confusion_counts(df, group_by=group_by, **args)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    accuracy = ratio_or_null(tp + tn, total)
    return counts.select(
        "bucket", *group_by, "tp", "fp", "tn", "fn",
        accuracy.alias("accuracy"),
        accuracy.alias("agreement_rate"),
        ratio_or_null(tp, tp + fp).alias("precision"),
        ratio_or_null(tp, tp + fn).alias("recall"),
        ratio_or_null(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        ratio_or_null(fp, fp + tn).alias("false_positive_rate"),
        ratio_or_null(fn, tp + fn).alias("false_negative_rate"),
        ratio_or_null(tn, fp + tn).alias("true_negative_rate"),
        (ratio_or_null(fn, total) * 100).alias("false_negative_pct"),
    ).orderBy("bucket", *group_by)


def percentage_accuracy(df: DataFrame, *, ts: str, label: str, prediction: str, bucket: str = "1 day",
                        group_by: Sequence[str] = ()) -> DataFrame:
    kept = df.dropna(subset=[ts, label, prediction])
    rows = bucketed(kept, ts, bucket, {"_ok": flag(F.col(prediction) == F.col(label))}, group_by, name="ts")
    return (
        rows.groupBy("ts", *group_by)
        .agg(
            (F.avg("_ok") * 100).alias("percentage_accuracy"),
            F.sum("_ok").cast("long").alias("correct_predictions_count"),
            F.count(F.lit(1)).alias("total_predictions_count"),
        )
        .withColumn(
            "accuracy_check", F.col("correct_predictions_count") / F.col("total_predictions_count") * 100
        )
        .orderBy("ts", *group_by)
    )


def accuracy_by(df: DataFrame, keys: Sequence, *, label: str, prediction: str) -> DataFrame:
    """Accuracy percentage and volume for any grouping; a NULL comparison counts as wrong."""
    return df.groupBy(*keys).agg(
        (F.avg(flag(F.col(prediction) == F.col(label))) * 100).alias("accuracy"),
        F.count(F.lit(1)).alias("volume"),
    )


def class_confusion(df: DataFrame, *, ts: str, truth: str, prediction: str, target, bucket: str = "1 day",
                    group_by: Sequence[str] = ()) -> DataFrame:
    """One class against the rest for a multi-class model."""
    is_true, is_guess = F.col(truth) == F.lit(target), F.col(prediction) == F.lit(target)
    return df.groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by).agg(
        F.count_if(is_true & is_guess).cast("double").alias("tp"),
        F.count_if(~is_true & is_guess).cast("double").alias("fp"),
        F.count_if(is_true & ~is_guess).cast("double").alias("fn"),
        F.count_if(~is_true & ~is_guess).cast("double").alias("tn"),
    ).orderBy("bucket", *group_by)
