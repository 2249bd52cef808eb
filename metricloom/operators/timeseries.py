"""Operators over bucketed series: gap filling, carrying forward, roll-ups, trends and period comparison.

Their inputs are metric points, not inference rows: one row per series and bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.timebuckets import bucket_start, parse_width


def trailing_sums(df: DataFrame, keys: Sequence[str], at: str, sums: Mapping[str, str], *, span: int) -> DataFrame:
    """Add, per row, the sums over the rows of its series in the ``span`` seconds before it, itself excluded.

    A sliding RANGE frame re-adds its whole content for each row. Here every row
    enters the running sum one second after its own time and leaves it once it is
    older than ``span``, so one pass over sorted rows is enough. Meant for counts:
    entering and leaving cancel exactly only for whole numbers.
    """
    t = F.unix_seconds(F.col(at).cast("timestamp"))
    columns = df.columns

    def mark(position: Column, is_row: bool, sign: int) -> Column:
        changes = [(F.coalesce(F.col(c), F.lit(0)).cast("long") * sign).alias(out) for out, c in sums.items()]
        return F.struct(position.alias("position"), F.lit(is_row).alias("is_row"), *changes)

    marks = F.array(mark(t, True, 0), mark(t + 1, False, 1), mark(t + span + 1, False, -1))
    events = df.select("*", F.explode(marks).alias("_mark"))
    so_far = (
        Window.partitionBy(*keys)
        .orderBy("_mark.position")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = events.select(*columns, "_mark.is_row", *[F.sum(f"_mark.{out}").over(so_far).alias(out) for out in sums])
    return totals.filter("is_row").drop("is_row")


def bucket_spine(spark, start, end, width: str, name: str = "bucket") -> DataFrame:
    """Every bucket from the one holding ``start`` up to, not including, ``end``."""
    n, unit = parse_width(width)
    first = bucket_start(F.lit(start).cast("timestamp"), width)
    last = F.lit(end).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    every = F.expr(f"INTERVAL {n * 3} MONTH" if unit == "quarter" else f"INTERVAL {n} {unit.upper()}")
    return spark.range(1).select(F.explode(F.sequence(first, last, every)).alias(name))


def gapfill(points: DataFrame, *, bucket: str, start, end, width: str, series: Sequence[str] = (),
            values: Sequence[str]) -> DataFrame:
    """Add the missing buckets of every series, with NULL values.

    ``points`` has one row per (bucket, series). Spine rows are appended and the
    group is taken again, which keeps NULL series apart without a null-safe join.
    """
    spine = bucket_spine(points.sparkSession, start, end, width, bucket)
    full = spine.crossJoin(points.select(*series).distinct()) if series else spine
    empty = full.select(
        bucket, *series, *[F.lit(None).cast(points.schema[v].dataType).alias(v) for v in values]
    )
    return (
        points.select(bucket, *series, *values)
        .unionByName(empty)
        .groupBy(bucket, *series)
        .agg(*[F.max(v).alias(v) for v in values])
    )


def locf(points: DataFrame, *, bucket: str, value: str, series: Sequence[str] = ()) -> DataFrame:
    """Carry the last value forward; leading gaps stay NULL."""
    so_far = Window.partitionBy(*series).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn(value, F.last(value, ignorenulls=True).over(so_far))


def rollup(store: DataFrame, *, width: str, ts: str = "timestamp", value: str = "value",
           series: Sequence = (), how: str = "sum", name: str = "total") -> DataFrame:
    """Roll finer points up to wider buckets; counts are summed, rates derived afterwards."""
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[how]
    return store.groupBy(bucket_start(ts, width).alias("bucket"), *series).agg(agg(value).alias(name))


def derived_rate(store: DataFrame, *, numerator: str, denominator: str, width: str = "1 day",
                 name: str = "rate", series: Sequence = ()) -> DataFrame:
    """Ratio of two summed metrics per bucket, 0 on a zero denominator; both metrics in one aggregation."""
    metric, value = F.col("metric_name"), F.col("value")
    sums = (
        store.filter(metric.isin(numerator, denominator))
        .groupBy(bucket_start("timestamp", width).alias("bucket"), *series)
        .agg(
            F.sum(F.when(metric == numerator, value)).alias("_num"),
            F.sum(F.when(metric == denominator, value)).alias("_den"),
            F.count_if(metric == numerator).alias("_has_num"),
            F.count_if(metric == denominator).alias("_has_den"),
        )
        .filter((F.col("_has_num") > 0) & (F.col("_has_den") > 0))
    )
    keys = [c for c in sums.columns if not c.startswith("_")]
    rate = F.when(F.col("_den") == 0, F.lit(0.0)).otherwise(F.col("_num") / F.col("_den"))
    return sums.select(*keys, rate.alias(name)).orderBy(F.desc("bucket"))


def trend(points: DataFrame, *, bucket: str, value: str, series: Sequence[str] = (), window: int = 7) -> DataFrame:
    """Previous value, change and rolling mean of the last ``window`` points."""
    order = Window.partitionBy(*series).orderBy(bucket)
    before = F.lag(value, 1).over(order)
    return points.select(
        bucket, *series, value,
        before.alias("previous"),
        (F.col(value) - before).alias("change"),
        F.avg(value).over(order.rowsBetween(-(window - 1), 0)).alias("rolling_avg"),
    )


def compare_periods(store: DataFrame, *, series: Sequence, first: tuple, second: tuple, ts: str = "timestamp",
                    value: str = "value") -> DataFrame:
    """Mean of two periods per series with change and percent change; both periods in one scan.

    Series missing from either period are left out.
    """
    when = F.col(ts)
    lit = [F.lit(t).cast("timestamp") for t in (*first, *second)]
    in_first, in_second = when.between(lit[0], lit[1]), when.between(lit[2], lit[3])
    means = (
        store.filter(in_first | in_second)
        .groupBy(*series)
        .agg(
            F.avg(F.when(in_first, F.col(value))).alias("first_period"),
            F.avg(F.when(in_second, F.col(value))).alias("second_period"),
            F.count_if(in_first).alias("_n1"),
            F.count_if(in_second).alias("_n2"),
        )
        .filter((F.col("_n1") > 0) & (F.col("_n2") > 0))
        .drop("_n1", "_n2")
    )
    change = F.col("second_period") - F.col("first_period")
    percent = F.when(F.col("first_period") > 0, change / F.col("first_period") * 100)
    return means.withColumns({"change": change, "percent_change": percent}).orderBy(F.desc(F.abs("change")))


def baseline_drift(store: DataFrame, *, series: Sequence, baseline: tuple, current: tuple,
                   report_above: float = 0.05, significant_above: float = 0.1) -> DataFrame:
    """Absolute change of a stored metric against a baseline period; small changes are not listed."""
    both = compare_periods(store, series=series, first=baseline, second=current)
    drift = F.abs(F.col("second_period") - F.col("first_period"))
    keys = [c for c in both.columns if c not in ("first_period", "second_period", "change", "percent_change")]
    return (
        both.select(
            *keys,
            F.col("first_period").alias("baseline_value"),
            F.col("second_period").alias("current_value"),
            drift.alias("drift"),
        )
        .filter(F.col("drift") > report_above)
        .withColumn(
            "drift_status",
            F.when(F.col("drift") > significant_above, "SIGNIFICANT DRIFT")
            .when(F.col("drift") > report_above, "MODERATE DRIFT")
            .otherwise("STABLE"),
        )
        .orderBy(F.desc("drift"))
    )
