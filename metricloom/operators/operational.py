"""Operational formulas: volumes, ratios, lifts, latency, cost."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.numeric import ratio_or_null
from metricloom.functions.timebuckets import bucket_start
from metricloom.operators.ordered import group_key
from metricloom.session import written


def average_daily_rate(df: DataFrame, *, ts: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Events per calendar day between the first and the last event, both days included."""
    day = F.col(ts).cast("date")
    return df.groupBy(*group_by).agg(
        (F.count(ts) / (F.datediff(F.max(day), F.min(day)) + 1)).alias("average_daily_rate")
    )


def event_ratio(df: DataFrame, *, numerator: Column, denominator: Column, name: str, scale: float = 1.0,
                keys: Sequence = ()) -> DataFrame:
    """Ratio of two conditional counts: click-through, contact rate, score utilisation, error rates."""
    return df.groupBy(*keys).agg((ratio_or_null(F.count_if(numerator), F.count_if(denominator)) * scale).alias(name))


def distinct_ratio(df: DataFrame, *, condition: Column, subject: str, name: str, keys: Sequence = ()) -> DataFrame:
    """Share of distinct subjects that meet the condition: customers who contacted over customers served."""
    return df.groupBy(*keys).agg(
        ratio_or_null(F.count_distinct(F.when(condition, F.col(subject))), F.count_distinct(subject)).alias(name)
    )


def days_to_closing(df: DataFrame, *, opened: str, closed: str, group_by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_by).agg(
        F.avg(F.datediff(F.col(closed).cast("date"), F.col(opened).cast("date"))).alias("days_to_closing")
    )


def lift(df: DataFrame, *, value: Column, treated: Column, name: str, how: str = "sum",
         keys: Sequence = ()) -> DataFrame:
    """Percentage change of a sum or mean of the treated rows against all other rows."""
    agg = {"sum": F.sum, "avg": F.avg}[how]
    out = df.groupBy(*keys).agg(
        agg(F.when(treated, value)).alias("_t"), agg(F.when(~treated, value)).alias("_c")
    )
    kept = [c for c in out.columns if c not in ("_t", "_c")]
    return out.select(*kept, (ratio_or_null(F.col("_t") - F.col("_c"), "_c") * 100).alias(name))


def points_to_double_odds(df: DataFrame, *, score: str, label: str, steps: int = 10,
                          group_by: Sequence[str] = ()) -> DataFrame:
    """ln 2 over the score's coefficient in a logistic fit on all rows, with a flag that tells whether the fit settled.

    The rows are read once and collapsed to counts of (group, score), which are written; the at most ``steps`` Newton
    steps read those. A step is one aggregation over standardised scores and ends in a written table of one row per group,
    so the planner knows its size: it is broadcast below Spark's limit, and otherwise a hot group's
    counts are split by the skew join. Steps stop when every fit has settled. Classes
    that a score separates, a single class or a constant score have no finite fit: the slope
    is NULL and ``converged`` false. Rows without a score or a 0/1 label take no part.
    """
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    rows = df.filter(s.isNotNull() & ~F.isnan(s) & y.isin(0.0, 1.0)).select(group_key(group_by).alias("_key"), s.alias("_s"), y.alias("_y"))
    counts = written(rows.groupBy("_key", "_s").agg(F.sum("_y").alias("_ones"), F.count(F.lit(1)).cast("double").alias("_n")), "odds-counts")
    ones, n = F.sum("_ones"), F.sum("_n")
    # Centred on the group's smallest score first: scores of a narrow range far from 0 keep their variance.
    least = counts.groupBy("_key").agg(F.min("_s").alias("_least"))
    off = F.col("_s") - F.col("_least")
    start = counts.join(least, "_key").groupBy("_key").agg(
        F.any_value("_least").alias("_least"), (F.sum(off * F.col("_n")) / n).alias("_off"), (F.sum(off * off * F.col("_n")) / n).alias("_square"),
        F.ln(F.nullif(ones, F.lit(0.0)) / F.nullif(n - ones, F.lit(0.0))).alias("_b0"))
    spread = F.col("_square") - F.col("_off") * F.col("_off")
    fit = written(start.select(
        "_key", (F.col("_least") + F.col("_off")).alias("_mean"), F.sqrt(F.when(spread > 0, spread)).alias("_sd"), "_b0",
        F.lit(0.0).alias("_b1"), F.lit(None).cast("double").alias("_move")), "odds-fit")
    z = (F.col("_s") - F.col("_mean")) / F.col("_sd")
    p = 1 / (1 + F.exp(-(F.col("_b0") + F.col("_b1") * z)))
    miss, weight = F.col("_ones") - p * F.col("_n"), p * (1 - p) * F.col("_n")
    for _ in range(steps):
        sums = counts.join(fit.drop("_move"), "_key").groupBy("_key").agg(
            *[F.any_value(c).alias(c) for c in ("_mean", "_sd", "_b0", "_b1")],
            F.sum(miss).alias("_g0"), F.sum(miss * z).alias("_g1"),
            F.sum(weight).alias("_h00"), F.sum(weight * z).alias("_h01"), F.sum(weight * z * z).alias("_h11"),
        )
        det = F.nullif(F.col("_h00") * F.col("_h11") - F.col("_h01") * F.col("_h01"), F.lit(0.0))
        d0 = (F.col("_h11") * F.col("_g0") - F.col("_h01") * F.col("_g1")) / det
        d1 = (F.col("_h00") * F.col("_g1") - F.col("_h01") * F.col("_g0")) / det
        fit = written(sums.select("_key", "_mean", "_sd", (F.col("_b0") + d0).alias("_b0"), (F.col("_b1") + d1).alias("_b1"),
                                  F.greatest(F.abs(d0), F.abs(d1)).alias("_move")), "odds-fit")
        if fit.filter("_move >= 1e-10").isEmpty():
            break
    settled = F.coalesce(F.col("_move") < 1e-8, F.lit(False))
    slope = F.when(settled, F.col("_b1") / F.col("_sd"))
    keys = [F.col(f"_key.{c}").alias(c) for c in group_by]
    return fit.select(*keys, slope.alias("log_odds_slope"),
                      (F.lit(math.log(2)) / F.nullif(slope, F.lit(0.0))).alias("points_to_double_odds"),
                      settled.alias("converged"))


def volume(df: DataFrame, *, ts: str, bucket: str = "1 day", name: str = "volume",
           group_by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by).agg(F.count(F.lit(1)).alias(name))


def cost(df: DataFrame, *, ts: str, units: Column, rate: float, bucket: str = "1 day",
         group_by: Sequence[str] = ()) -> DataFrame:
    """Used units (tokens, compute seconds) times a rate."""
    return df.groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by).agg((F.sum(units) * rate).alias("cost"))


def latency_ms(df: DataFrame, *, ts: str, started: str, finished: str, bucket: str = "1 day",
               group_by: Sequence[str] = ()) -> DataFrame:
    took = (F.unix_micros(F.col(finished).cast("timestamp")) - F.unix_micros(F.col(started).cast("timestamp"))) / 1000.0
    return df.groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by).agg(F.avg(took).alias("latency_ms"))


def http_errors(df: DataFrame, *, ts: str, status: str, bucket: str = "1 day",
                group_by: Sequence[str] = ()) -> DataFrame:
    """Counts of non-2xx and of 4xx/5xx answers with their percentages, kept apart so they can be rolled up."""
    code = F.col(status)
    out = df.groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by).agg(
        F.count_if((code < 200) | (code >= 300)).alias("failed_calls"),
        F.count_if(code >= 400).alias("http_errors"),
        F.count(F.lit(1)).alias("total_calls"),
    )
    return out.withColumns({
        "api_error_rate": F.col("failed_calls") / F.col("total_calls") * 100,
        "http_error_rate": F.col("http_errors") / F.col("total_calls") * 100,
    })
