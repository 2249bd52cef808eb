"""Log loss and calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.numeric import clip
from metricloom.functions.timebuckets import bucket_start
from metricloom.operators.common import bucketed
from metricloom.operators.ordered import weighted_tiles

EPSILON = 1e-15


def sample_log_loss(label: Column, prob: Column, epsilon: float = EPSILON) -> Column:
    """Loss of one prediction; every label other than 1 is treated as negative."""
    p = clip(prob, epsilon, 1.0 - epsilon)
    return F.when(label == 1, -F.ln(p)).otherwise(-F.ln(1.0 - p))


def log_loss(df: DataFrame, *, ts: str, label: str, prob: str, epsilon: float = EPSILON, bucket: str = "1 day",
             group_by: Sequence[str] = ()) -> DataFrame:
    kept = df.dropna(subset=[ts, label, prob]).filter(F.col(prob).between(0.0, 1.0))
    rows = bucketed(kept, ts, bucket, {"_p": F.col(prob).cast("double"), "_y": F.col(label).cast("int")},
                    group_by, name="ts")
    return (
        rows.groupBy("ts", *group_by)
        .agg(
            F.avg(sample_log_loss(F.col("_y"), F.col("_p"), epsilon)).alias("log_loss"),
            F.count(F.lit(1)).alias("total_predictions"),
            F.avg("_p").alias("avg_predicted_probability"),
            F.count_if(F.col("_y") == 1).alias("positive_class_count"),
            F.count_if(F.col("_y") == 0).alias("negative_class_count"),
        )
        .orderBy("ts", *group_by)
    )


def multiclass_log_loss(df: DataFrame, *, ts: str, truth: str, prob_columns: Mapping[object, str],
                        epsilon: float = EPSILON, bucket: str = "1 day", group_by: Sequence[str] = ()) -> DataFrame:
    """Mean of -ln(probability of the true class); classes without a column are left out of the mean."""
    loss = None
    for value, column in prob_columns.items():
        term = -F.ln(F.greatest(F.lit(epsilon), F.col(column).cast("double")))
        hit = F.col(truth) == F.lit(value)
        loss = F.when(hit, term) if loss is None else loss.when(hit, term)
    return (
        df.groupBy(bucket_start(ts, bucket).alias("ts"), *group_by)
        .agg(F.avg(loss).alias("log_loss"))
        .orderBy("ts", *group_by)
    )


def random_guess_baseline(df: DataFrame, *, label: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Entropy of the positive rate: the log loss of always guessing that rate."""
    rates = df.groupBy(*group_by).agg(F.avg(F.col(label).cast("double")).alias("class_balance"))
    p = F.col("class_balance")
    # A single class has no entropy; LN(0) would make it NULL.
    entropy = F.when((p > 0) & (p < 1), -(p * F.ln(p) + (1 - p) * F.ln(1 - p)))
    return rates.select(*group_by, "class_balance", entropy.alias("random_guess_log_loss"))


def calibration_bins(df: DataFrame, *, label: str, prob: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Mean prediction against observed rate in bins of 0.1; ``group_by`` a version compares models."""
    p = F.col(prob).cast("double")
    return (
        df.groupBy(*group_by, (F.floor(p * 10) / 10.0).alias("prob_bin_start"))
        .agg(
            F.avg(p).alias("avg_pred"),
            F.avg(F.col(label).cast("double")).alias("actual_rate"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("calibration_error", F.col("avg_pred") - F.col("actual_rate"))
        .orderBy(*group_by, "prob_bin_start")
    )


def calibration_deciles(df: DataFrame, *, label: str, prob: str, tiles: int = 10, epsilon: float = EPSILON,
                        group_by: Sequence[str] = ()) -> DataFrame:
    """Equal-count bins along the probability; ties are split by label, so the split is repeatable."""
    counts = df.groupBy(
        *group_by, F.col(prob).cast("double").alias("_p"), F.col(label).cast("double").alias("_y")
    ).agg(F.count(F.lit(1)).alias("n"))
    tiled = weighted_tiles(counts, group_by, "_p", "n", tiles, tie_break=["_y"])
    p, y, n = F.col("_p"), F.col("_y"), F.col("n")
    loss = F.when(y == 1, -F.ln(F.greatest(F.lit(epsilon), p))).otherwise(-F.ln(F.greatest(F.lit(epsilon), 1 - p)))

    def mean(value: Column) -> Column:
        weight = F.when(value.isNotNull(), n)
        return F.sum(value * n) / F.nullif(F.sum(weight), F.lit(0))

    return (
        tiled.groupBy(*group_by, F.col("tile").alias("decile"))
        .agg(
            mean(p).alias("avg_predicted_prob"),
            mean(y).alias("observed_rate"),
            F.sum("n").alias("sample_size"),
            mean(loss).alias("decile_log_loss"),
        )
        .orderBy(*group_by, "decile")
    )
