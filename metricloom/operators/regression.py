"""Error metrics of regression models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.numeric import band, flag, ratio_or_null
from metricloom.operators.common import bucketed, prediction_pairs
from metricloom.operators.ordered import exact_quantiles
from metricloom.session import written


def _error() -> Column:
    return F.col("prediction") - F.col("actual")


def _relative_error() -> Column:
    return _error() / F.col("actual")


def rmse(df: DataFrame, *, ts: str, prediction: str, actual: str, bucket: str = "1 day",
         group_by: Sequence[str] = ()) -> DataFrame:
    rows = prediction_pairs(df, ts=ts, prediction=prediction, actual=actual, bucket=bucket, group_by=group_by)
    return rows.groupBy("ts", *group_by).agg(F.sqrt(F.avg(_error() * _error())).alias("rmse")).orderBy("ts", *group_by)


def mae_mse(df: DataFrame, *, ts: str, prediction: str, actual: str, bucket: str = "5 minutes",
            group_by: Sequence[str] = ()) -> DataFrame:
    """Mergeable parts (absolute and squared error sums, count) with the means derived from them."""
    rows = prediction_pairs(df, ts=ts, prediction=prediction, actual=actual, bucket=bucket, group_by=group_by)
    sums = rows.groupBy("ts", *group_by).agg(
        F.sum(F.abs(_error())).alias("absolute_error_sum"),
        F.sum(_error() * _error()).alias("squared_error_sum"),
        F.count(F.lit(1)).alias("error_count"),
    )
    return sums.withColumns({
        "mae": F.col("absolute_error_sum") / F.col("error_count"),
        "mse": F.col("squared_error_sum") / F.col("error_count"),
    }).orderBy("ts", *group_by)


def cumulative_error(df: DataFrame, *, ts: str, prediction: str, actual: str, bucket: str = "1 day",
                     group_by: Sequence[str] = ()) -> DataFrame:
    """Running signed error; the window runs over one row per bucket."""
    rows = prediction_pairs(df, ts=ts, prediction=prediction, actual=actual, bucket=bucket, group_by=group_by)
    daily = rows.groupBy("ts", *group_by).agg(F.sum(_error()).alias("_net"))
    history = Window.partitionBy(*group_by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("ts", *group_by, F.sum("_net").over(history).alias("cumulative_error")).orderBy("ts", *group_by)


def end_of_term_error(df: DataFrame, *, ts: str, prediction: str, actual: str, term_boundary: str = "month",
                      bucket: str = "1 day", group_by: Sequence[str] = ()) -> DataFrame:
    """One row per inference on the last day of each month, quarter or year; other boundaries give none."""
    rows = prediction_pairs(df, ts=ts, prediction=prediction, actual=actual, bucket=bucket, group_by=group_by)
    months = {"month": 1, "quarter": 3, "year": 12}.get(term_boundary)
    if months is None:
        at_end = F.lit(False)
    else:
        next_term = F.add_months(F.date_trunc(term_boundary, F.col("ts")).cast("date"), months)
        at_end = F.col("ts") == F.date_sub(next_term, 1).cast("timestamp")
    return rows.filter(at_end).select("ts", *group_by, F.abs(_error()).alias("end_of_term_error"))


def absolute_error(df: DataFrame, *, ts: str, prediction: str, actual: str, group_by: Sequence[str] = ()) -> DataFrame:
    return _per_inference(df, ts, prediction, actual, group_by).select("ts", *group_by, "absolute_error")


def forecast_error(df: DataFrame, *, ts: str, prediction: str, actual: str, group_by: Sequence[str] = ()) -> DataFrame:
    return _per_inference(df, ts, prediction, actual, group_by).select("ts", *group_by, "forecast_error")


def absolute_percentage_error(df: DataFrame, *, ts: str, prediction: str, actual: str,
                              group_by: Sequence[str] = ()) -> DataFrame:
    return _per_inference(df, ts, prediction, actual, group_by).select("ts", *group_by, "absolute_percentage_error")


def _per_inference(df: DataFrame, ts: str, prediction: str, actual: str, group_by: Sequence[str]) -> DataFrame:
    """Row-level errors at the raw timestamp: a narrow map, left unsorted for the sketch sink."""
    rows = df.filter(F.col(ts).isNotNull()).select(
        F.col(ts).cast("timestamp").alias("ts"), *group_by,
        F.col(prediction).cast("double").alias("prediction"), F.col(actual).cast("double").alias("actual"),
    )
    return rows.select("ts", *group_by, *_error_columns())


def _error_columns() -> list[Column]:
    relative = F.when(F.col("actual") != 0, F.abs(_relative_error()) * 100)
    return [
        F.abs(_error()).alias("absolute_error"),
        _error().alias("forecast_error"),
        relative.alias("absolute_percentage_error"),
    ]


def error_profile(df: DataFrame, *, ts: str, prediction: str, actual: str, bucket: str = "1 day",
                  group_by: Sequence[str] = ()) -> DataFrame:
    """All three row-level errors, stamped with their bucket; nothing is filtered."""
    rows = bucketed(
        df, ts, bucket,
        {"prediction": F.col(prediction).cast("double"), "actual": F.col(actual).cast("double")},
        group_by, name="ts", drop_null_ts=False,
    )
    return rows.select("ts", *group_by, *_error_columns())


def maximum_errors(df: DataFrame, *, ts: str, prediction: str, actual: str, bucket: str = "1 day",
                   group_by: Sequence[str] = ()) -> DataFrame:
    rows = prediction_pairs(df, ts=ts, prediction=prediction, actual=actual, bucket=bucket, group_by=group_by)
    return rows.groupBy("ts", *group_by).agg(
        F.max(F.abs(_error())).alias("max_error"),
        F.max(F.when(F.col("actual") != 0, F.abs(_relative_error()) * 100)).alias("max_relative_error"),
    ).orderBy("ts", *group_by)


def mean_absolute_deviation(df: DataFrame, *, ts: str, prediction: str, bucket: str = "1 day",
                            group_by: Sequence[str] = (), with_spread: bool = False) -> DataFrame:
    """Spread of the predictions around their own bucket mean.

    The means are a partial aggregation, written as one row per bucket: their size is known, so they are broadcast to the
    rows below Spark's limit, and beyond it a hot bucket's rows are split by the skew join. A window over the
    bucket would pull all its rows into one task.
    """
    keys = ["ts", *group_by]
    kept = df.dropna(subset=[ts] if with_spread else [ts, prediction])
    rows = bucketed(kept, ts, bucket, {"prediction": F.col(prediction).cast("double")}, group_by, name="ts")
    means = rows.groupBy(*keys).agg(F.avg("prediction").alias("_mean"), F.stddev_samp("prediction").alias("std_dev"))
    means = written(means.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_mean", "std_dev"), "bucket-means")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = rows.join(means, on).groupBy(*keys).agg(
        F.avg(F.abs(F.col("prediction") - F.col("_mean"))).alias("mad"), F.max("std_dev").alias("std_dev")
    )
    if not with_spread:
        return out.select(*keys, "mad").orderBy(*keys)
    return out.withColumn("mad_to_std_ratio", ratio_or_null("mad", "std_dev")).orderBy(*keys)


def normalized_mad(df: DataFrame, *, ts: str, prediction: str, actual: str, bucket: str = "1 day",
                   group_by: Sequence[str] = ()) -> DataFrame:
    rows = prediction_pairs(df, ts=ts, prediction=prediction, actual=actual, bucket=bucket, group_by=group_by)
    return rows.groupBy("ts", *group_by).agg(
        ratio_or_null(F.avg(F.abs(_error())), F.avg(F.abs("actual"))).alias("normalized_mad")
    ).orderBy("ts", *group_by)


def mape_against_normalized_mad(df: DataFrame, *, ts: str, prediction: str, actual: str, bucket: str = "1 day",
                                group_by: Sequence[str] = ()) -> DataFrame:
    rows = bucketed(
        df.filter(F.col(actual) != 0), ts, bucket,
        {"prediction": F.col(prediction).cast("double"), "actual": F.col(actual).cast("double")}, group_by, name="ts",
    )
    return rows.groupBy("ts", *group_by).agg(
        (F.avg(F.abs(_relative_error())) * 100).alias("mape"),
        (ratio_or_null(F.avg(F.abs(_error())), F.avg(F.abs("actual"))) * 100).alias("normalized_mad_pct"),
    ).withColumn("mape_vs_nmad_diff", F.col("mape") - F.col("normalized_mad_pct")).orderBy("ts", *group_by)


def percentage_errors(df: DataFrame, *, ts: str, prediction: str, actual: str, bucket: str = "1 day",
                      group_by: Sequence[str] = ()) -> DataFrame:
    """mape, exact median (mdape) and signed deviation ratio, from one pass over value counts."""
    keys = ["ts", *group_by]
    rows = prediction_pairs(df, ts=ts, prediction=prediction, actual=actual, bucket=bucket, group_by=group_by,
                            nonzero=True)
    rows = rows.select(*keys, (F.abs(_relative_error()) * 100).alias("ape"), _relative_error().alias("signed"))
    out = exact_quantiles(rows, keys, "ape", {"mdape": 0.5}, sums={"_ape": "ape", "_signed": "signed"})
    return out.select(
        *keys, (F.col("_ape") / F.col("n")).alias("mape"), "mdape",
        (F.col("_signed") / F.col("n")).alias("deviation_ratio"),
    ).orderBy(*keys)


def trailing_twelve_months_error(df: DataFrame, *, ts: str, prediction: str, actual: str, bucket: str = "1 day",
                                 group_by: Sequence[str] = ()) -> DataFrame:
    """Mean of the last 365 daily errors that exist (rows, not calendar days)."""
    rows = prediction_pairs(df, ts=ts, prediction=prediction, actual=actual, bucket=bucket, group_by=group_by)
    daily = rows.groupBy("ts", *group_by).agg(F.avg(F.abs(_error())).alias("_mae"))
    year = Window.partitionBy(*group_by).orderBy("ts").rowsBetween(-364, 0)
    return daily.select("ts", *group_by, F.avg("_mae").over(year).alias("ttm_error")).orderBy("ts", *group_by)


def wmape(df: DataFrame, *, ts: str, prediction: str, actual: str, bucket: str = "1 day",
          group_by: Sequence[str] = ()) -> DataFrame:
    rows = prediction_pairs(df, ts=ts, prediction=prediction, actual=actual, bucket=bucket, group_by=group_by)
    return rows.groupBy("ts", *group_by).agg(
        (ratio_or_null(F.sum(F.abs(_error())), F.sum(F.abs("actual"))) * 100).alias("wmape")
    ).orderBy("ts", *group_by)


def wmape_by_segment(df: DataFrame, *, prediction: str, actual: str, segment: str) -> DataFrame:
    p, a = F.col(prediction).cast("double"), F.col(actual).cast("double")
    return df.groupBy(F.col(segment).alias("segment")).agg(
        (ratio_or_null(F.sum(F.abs(p - a)), F.sum(F.abs(a))) * 100).alias("wmape"),
        F.count(F.lit(1)).alias("prediction_count"),
        F.sum(F.abs(a)).alias("total_volume"),
        F.avg(F.abs(a)).alias("avg_volume"),
    ).orderBy(F.desc("total_volume"))


def core_accuracy(df: DataFrame, *, ts: str, prediction: str, actual: str, threshold: float = 0.10,
                  min_actual: float = 0.0001, bucket: str = "1 day", group_by: Sequence[str] = ()) -> DataFrame:
    """Share of predictions within ``threshold`` of the truth; zero and tiny actuals are left out."""
    rows = prediction_pairs(df, ts=ts, prediction=prediction, actual=actual, bucket=bucket, group_by=group_by,
                            nonzero=True, min_actual=min_actual)
    relative = F.abs(_relative_error())
    return rows.groupBy("ts", *group_by).agg(
        F.avg(flag(relative <= threshold)).alias("core_accuracy_rate"),
        F.count_if(relative <= threshold).alias("accurate_predictions_count"),
        F.count(F.lit(1)).alias("total_predictions_count"),
        F.avg(relative).alias("avg_percentage_error"),
    ).orderBy("ts", *group_by)


def extreme_valuation(df: DataFrame, *, ts: str, prediction: str, actual: str, direction: str,
                      threshold: float = 0.20, min_actual: float = 0.0001, bucket: str = "1 day",
                      group_by: Sequence[str] = ()) -> DataFrame:
    """Rate of predictions far over or under the truth; tiny actuals never count but stay in the total."""
    if direction not in ("over", "under"):
        raise ValueError("direction is 'over' or 'under'")
    rows = prediction_pairs(df, ts=ts, prediction=prediction, actual=actual, bucket=bucket, group_by=group_by,
                            nonzero=True)
    gap = _error() if direction == "over" else -_error()
    magnitude = F.abs("actual")
    extreme = (magnitude > min_actual) & (gap / magnitude > threshold)
    name = f"extreme_{direction}valuation"
    return rows.groupBy("ts", *group_by).agg(
        F.avg(flag(extreme)).alias(f"{name}_rate"),
        F.count_if(extreme).alias(f"{name}_count"),
        F.count(F.lit(1)).alias("total_predictions"),
    ).orderBy("ts", *group_by)


# Upper edge and name of each error band.
ERROR_BANDS = ((0.05, "0-5% (Excellent)"), (0.10, "5-10% (Good)"), (0.20, "10-20% (Fair)"), (0.50, "20-50% (Poor)"))
WORST_BAND = ">50% (Very Poor)"


def error_bands(df: DataFrame, *, prediction: str, actual: str, min_actual: float = 0.0001) -> DataFrame:
    p, a = F.col(prediction).cast("double"), F.col(actual).cast("double")
    kept = df.filter((a != 0) & (F.abs(a) > min_actual))
    counts = kept.groupBy(band(F.abs((p - a) / a), ERROR_BANDS, WORST_BAND, inclusive=True).alias("error_bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = counts.agg(F.sum("n").alias("_total"))
    rank = F.array_position(F.lit([name for _, name in ERROR_BANDS]), F.col("error_bucket"))
    return (
        counts.crossJoin(F.broadcast(total))
        .select("error_bucket", "n", F.round(F.col("n") / F.col("_total") * 100, 1).alias("percentage"))
        .orderBy(F.when(rank > 0, rank).otherwise(len(ERROR_BANDS) + 1))
    )


def error_percentiles(df: DataFrame, *, prediction: str, actual: str) -> DataFrame:
    p, a = F.col(prediction).cast("double"), F.col(actual).cast("double")
    rows = df.filter(a != 0).select(F.abs((p - a) / a).alias("e"))
    points = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}
    out = exact_quantiles(rows, [], "e", points)
    return out.select(*[(F.col(name) * 100).alias(f"{name}_error_pct") for name in points])


def bias_assessment(df: DataFrame, *, prediction: str, actual: str, min_actual: float = 0.0001) -> DataFrame:
    p, a = F.col(prediction).cast("double"), F.col(actual).cast("double")
    out = df.filter((a != 0) & (F.abs(a) > min_actual)).agg(
        F.count_if(p > a).alias("overestimates"),
        F.count_if(p < a).alias("underestimates"),
        F.count_if(p == a).alias("exact_matches"),
        F.avg((p - a) / a).alias("avg_relative_error"),
    )
    mean = F.col("avg_relative_error")
    return out.withColumn(
        "bias_assessment",
        F.when(mean > 0.05, "Systematic Overestimation")
        .when(mean < -0.05, "Systematic Underestimation")
        .otherwise("Balanced"),
    )


def overvaluation_advice(df: DataFrame, *, prediction: str, actual: str) -> DataFrame:
    p, a = F.col(prediction).cast("double"), F.col(actual).cast("double")
    rows = df.filter(a != 0).select(((p - a) / F.abs(a)).alias("e"))
    edge = exact_quantiles(rows, [], "e", {"p95": 0.95}, sums={"_sum": "e"})
    top = rows.agg(F.max("e").alias("_max"))
    return edge.crossJoin(F.broadcast(top)).select(
        (F.col("_max") * 100).alias("max_overvaluation_pct"),
        (F.col("p95") * 100).alias("p95_overvaluation_pct"),
        (F.col("_sum") / F.col("n") * 100).alias("avg_error_pct"),
    )


def undervaluation_advice(df: DataFrame, *, prediction: str, actual: str) -> DataFrame:
    """Only undervalued rows; the column named max holds the smallest gap, as the definition has it."""
    p, a = F.col(prediction).cast("double"), F.col(actual).cast("double")
    rows = df.filter((a != 0) & (a - p > 0)).select(((p - a) / F.abs(a)).alias("e"))
    edge = exact_quantiles(rows, [], "e", {"p5": 0.05}, sums={"_sum": "e"})
    least = rows.agg(F.min(-F.col("e")).alias("_min"))
    return edge.crossJoin(F.broadcast(least)).select(
        (F.col("_min") * 100).alias("max_undervaluation_pct"),
        (F.col("p5") * 100).alias("p5_undervaluation_pct"),
        (-F.col("_sum") / F.col("n") * 100).alias("avg_undervaluation_pct"),
    )
