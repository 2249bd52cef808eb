"""Completeness, validity and distribution checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.numeric import band, flag
from metricloom.functions.timebuckets import bucket_start
from metricloom.operators.common import bucketed


def completeness(df: DataFrame, *, ts: str, required: Sequence[str], bucket: str = "1 day",
                 group_by: Sequence[str] = ()) -> DataFrame:
    """Share and number of rows with every required column filled."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    rows = bucketed(df, ts, bucket, {"_ok": flag(complete)}, group_by)
    return rows.groupBy("bucket", *group_by).agg(
        (F.avg("_ok") * 100).alias("completeness_pct"),
        (F.count(F.lit(1)) - F.sum("_ok")).alias("incomplete_row_count"),
    ).orderBy("bucket", *group_by)


def null_rates(df: DataFrame, *, ts: str, columns: Sequence[str], bucket: str = "1 day",
               group_by: Sequence[str] = ()) -> DataFrame:
    """NULL percentage per column as one series each, from a single aggregation."""
    rows = df.filter(F.col(ts).isNotNull())
    wide = rows.groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by).agg(
        *[(F.avg(flag(F.col(c).isNull())) * 100).alias(f"_null_{i}") for i, c in enumerate(columns)]
    )
    series = F.array(*[
        F.struct(F.lit(c).alias("series"), F.col(f"_null_{i}").alias("rate")) for i, c in enumerate(columns)
    ])
    return (
        wide.select("bucket", *group_by, F.explode(series).alias("_s"))
        .select("bucket", *group_by, F.col("_s.series").alias("series"), F.col("_s.rate").alias("null_rate_pct"))
        .orderBy("bucket", *group_by, "series")
    )


def validity_report(df: DataFrame, *, ts: str, label: str, prob: str) -> DataFrame:
    p = F.col(prob)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(ts).alias("non_null_timestamps"),
        F.count(prob).alias("non_null_probs"),
        F.count(label).alias("non_null_labels"),
        F.count_if(p.between(0, 1)).alias("valid_probs"),
        F.min(p).alias("min_prob"),
        F.max(p).alias("max_prob"),
        F.min(ts).alias("earliest_ts"),
        F.max(ts).alias("latest_ts"),
    )


def regression_validity_report(df: DataFrame, *, ts: str, prediction: str, actual: str,
                               min_actual: float = 0.0001) -> DataFrame:
    a = F.col(actual)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count(ts).alias("non_null_timestamps"),
        F.count(prediction).alias("non_null_predictions"),
        F.count(actual).alias("non_null_actuals"),
        F.count_if(a != 0).alias("non_zero_actuals"),
        F.count_if(F.abs(a) > min_actual).alias("actuals_above_threshold"),
        F.min(ts).alias("earliest_timestamp"),
        F.max(ts).alias("latest_timestamp"),
    )


def value_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """min, max, avg and sample deviation of each column over rows where all of them are filled."""
    rows = df.dropna(subset=list(columns))
    stats = (("min", F.min), ("max", F.max), ("avg", F.avg), ("stddev", F.stddev_samp))
    return rows.agg(*[f(F.col(c).cast("double")).alias(f"{name}_{c}") for c in columns for name, f in stats])


def label_distribution(df: DataFrame, *, label: str) -> DataFrame:
    """Count and percentage of every label; the total is a one-row broadcast, not a global window."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return (
        counts.crossJoin(F.broadcast(total))
        .select("label", "n", F.round(F.col("n") / F.col("_total") * 100, 2).alias("percentage"))
        .orderBy("label")
    )


def label_mismatch(df: DataFrame, *, prediction: str, actual: str) -> DataFrame:
    """Distinct values of the predicted and the actual label column."""
    both = F.array(
        F.struct(F.col(prediction).cast("string").alias("label"), F.lit("predicted").alias("source")),
        F.struct(F.col(actual).cast("string").alias("label"), F.lit("actual").alias("source")),
    )
    return df.select(F.explode(both).alias("_v")).select("_v.label", "_v.source").distinct().orderBy("source", "label")


def period_distribution(df: DataFrame, *, ts: str, value: str, cuts: Sequence[tuple[float, str]], otherwise: str,
                        reference_start, reference_end) -> DataFrame:
    """Share of fixed value ranges within the reference and the current period."""
    rows = df.dropna(subset=[ts, value])
    counts = rows.groupBy(
        _period(ts, reference_start, reference_end).alias("period"),
        band(F.col(value).cast("double"), cuts, otherwise).alias("bin"),
    ).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("period")) * 100
    return counts.select("period", "bin", "n", F.round(share, 2).alias("pct")).orderBy("period", "bin")


def _period(ts: str, start, end):
    in_reference = (F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp"))
    return F.when(in_reference, "Reference").otherwise("Current")


def period_statistics(df: DataFrame, *, ts: str, value: str, reference_start, reference_end) -> DataFrame:
    """n, min, max, mean and deviation of a column per period; rows before the reference count in neither."""
    start = F.lit(reference_start).cast("timestamp")
    rows = df.dropna(subset=[ts, value]).filter(F.col(ts) >= start)
    v = F.col(value).cast("double")
    return rows.groupBy(_period(ts, reference_start, reference_end).alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        F.avg(v).alias("avg_value"), F.stddev_samp(v).alias("stddev_value"),
    ).orderBy("period")


def extreme_probabilities(df: DataFrame, *, prob: str) -> DataFrame:
    p = F.col(prob)
    return df.agg(
        F.count_if(p == 0.0).alias("prob_exactly_zero"),
        F.count_if(p == 1.0).alias("prob_exactly_one"),
        F.count_if(p < 0.01).alias("prob_very_low"),
        F.count_if(p > 0.99).alias("prob_very_high"),
        F.count(F.lit(1)).alias("total"),
    )
