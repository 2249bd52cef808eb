"""Alert rules over the metric store, and the audit rows that document them.

Rules are rows, so all rules are evaluated in one join instead of one query each:
``rule_id, metric_name, aggregate ('avg'|'sum'), threshold, bound ('upper'|'lower'),
window_seconds, missing_as_zero``.

``Rule`` objects are compiled to filters of the scan first: metric folders, years and time bounds are literals, so
only the newest stretch of the named metrics is read, however long the history is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.functions import sketches
from metricloom.functions.timebuckets import bucket_start, width_seconds
from metricloom.plans.store import latest_version

RULE_SCHEMA = (
    "rule_id string, metric_name string, aggregate string, threshold double, bound string, "
    "window_seconds long, missing_as_zero boolean"
)
EVIDENCE_COLUMNS = (
    "date", "metric_name", "metric_value", "threshold", "threshold_operator", "control_pass", "alert_expected",
    "alert_fired", "alert_id", "alert_timestamp", "model_id", "evidence_generated_at",
)


#: Rules that one evaluation compiles; their literals travel in the plan.
MOST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """One rule; the fields are the columns of ``RULE_SCHEMA``."""

    rule_id: str
    metric_name: str
    aggregate: Literal["avg", "sum"]
    threshold: float
    bound: Literal["upper", "lower"]
    window_seconds: int
    missing_as_zero: bool = False

    def __post_init__(self) -> None:
        if self.aggregate not in ("avg", "sum") or self.bound not in ("upper", "lower") or self.window_seconds <= 0:
            raise ValueError(f"not a rule: {self}")


def rule_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([astuple(r) for r in rules], RULE_SCHEMA)


def within(store: DataFrame, as_of, seconds: int) -> Column:
    """(as_of - seconds, as_of] as bounds of the scan; years are bounded too if the store has them as folders."""
    now = F.lit(as_of).cast("timestamp")
    first = F.timestamp_micros(F.unix_micros(now) - seconds * 1_000_000)
    inside = (F.col("timestamp") > first) & (F.col("timestamp") <= now)
    return inside & F.col("year").between(F.year(first), F.year(now)) if "year" in store.columns else inside


def read_for_rules(store: DataFrame, rules: Sequence[Rule], *, as_of) -> DataFrame:
    """The rows of ``store``, all versions, that some rule looks at.

    Rules of one window length share one condition. The widest window and the names of all metrics stand beside the
    conditions, so that folders are pruned by simple filters.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MOST_RULES}; evaluate them in parts")
    if not rules:
        return store.filter(F.lit(False))
    names: dict[int, list[str]] = {}
    for r in rules:
        names.setdefault(r.window_seconds, []).append(r.metric_name)
    each = F.lit(False)
    for seconds, metrics in sorted(names.items()):
        each = each | (F.col("metric_name").isin(*sorted(set(metrics))) & within(store, as_of, seconds))
    widest = F.col("metric_name").isin(*sorted({r.metric_name for r in rules})) & within(store, as_of, max(names))
    return store.filter(widest).filter(each)


def evaluate_stored(store: DataFrame, rules: Sequence[Rule], *, as_of) -> DataFrame:
    """``evaluate_rules`` over the newest versions of a stored store, reading what the rules need."""
    points = latest_version(read_for_rules(store, rules, as_of=as_of))
    return evaluate_rules(points, rule_frame(store.sparkSession, rules), as_of=as_of)


def violated(value: Column, threshold: Column, bound: Column) -> Column:
    """Past the threshold in the direction of the bound; NULL when there is no value."""
    return F.when(bound == "upper", value > threshold).otherwise(value < threshold)



def evaluate_rules(store: DataFrame, rules: DataFrame, *, as_of) -> DataFrame:
    """Value of every rule over (as_of - window, as_of] and whether it fires; rules without data stay."""
    now = F.lit(as_of).cast("timestamp")
    points = store.select(F.col("metric_name").alias("_metric"), F.col("timestamp").alias("_ts"), "value")
    in_window = (
        (F.col("metric_name") == F.col("_metric"))
        & (F.col("_ts") <= now)
        & (F.unix_micros(F.col("_ts")) > F.unix_micros(now) - F.col("window_seconds") * 1000000)
    )
    # Points meet the rules before anything is grouped, so a metric with many points is summed in parts;
    # only the one value per rule is joined back to keep rules without data.
    found = rules.join(points, in_window).groupBy("rule_id").agg(F.sum("value").alias("_sum"), F.avg("value").alias("_avg"))
    values = rules.join(found, "rule_id", "left")
    raw = F.when(F.col("aggregate") == "sum", F.col("_sum")).otherwise(F.col("_avg"))
    value = F.when(F.col("missing_as_zero"), F.coalesce(raw, F.lit(0.0))).otherwise(raw)
    fires = F.coalesce(violated(F.col("metric_value"), F.col("threshold"), F.col("bound")), F.lit(False))
    return (
        values.select("rule_id", "metric_name", "threshold", "bound", value.alias("metric_value"))
        .withColumn("fires", fires)
        .orderBy("rule_id")
    )


def evaluate_rules_over_time(store: DataFrame, rules: DataFrame, *, period: str = "1 day") -> DataFrame:
    """Every rule evaluated on every period that has data."""
    points = store.join(rules, "metric_name")
    values = points.groupBy("rule_id", "metric_name", "threshold", "bound", "aggregate",
                            bucket_start("timestamp", period).alias("period")).agg(
        F.sum("value").alias("_sum"), F.avg("value").alias("_avg"))
    value = F.when(F.col("aggregate") == "sum", F.col("_sum")).otherwise(F.col("_avg"))
    return values.select(
        "rule_id", "metric_name", "period", "threshold", "bound", value.alias("metric_value"),
        F.coalesce(violated(value, F.col("threshold"), F.col("bound")), F.lit(False)).alias("fires"),
    )


def low_volume(points: DataFrame, spine: DataFrame, *, bucket: str, value: str, floor: float) -> DataFrame:
    """Buckets of the spine whose total is below ``floor``; a missing bucket counts 0."""
    totals = points.groupBy(bucket).agg(F.sum(value).alias("_sum"))
    return (
        spine.join(totals, bucket, "left")
        .select(bucket, F.coalesce("_sum", F.lit(0.0)).alias("total"))
        .withColumn("fires", F.col("total") < floor)
        .orderBy(bucket)
    )


def against_trailing_average(points: DataFrame, *, bucket: str, value: str, lookback: str,
                             series: Sequence[str] = (), below: float | None = None,
                             above: float | None = None) -> DataFrame:
    """Value against the mean of the ``lookback`` before it: fires under ``below`` x or over ``above`` x the mean."""
    earlier = _earlier(bucket, lookback, series)
    out = points.select(bucket, *series, value, F.avg(value).over(earlier).alias("trailing_avg"))
    fires = F.lit(False)
    if below is not None:
        fires = fires | (F.col(value) < F.col("trailing_avg") * below)
    if above is not None:
        fires = fires | (F.col(value) > F.col("trailing_avg") * above)
    return out.withColumn("fires", F.coalesce(fires, F.lit(False))).orderBy(bucket, *series)


def _earlier(bucket: str, lookback: str, series: Sequence[str]):
    return (
        Window.partitionBy(*series)
        .orderBy(F.unix_seconds(F.col(bucket)))
        .rangeBetween(-width_seconds(lookback), -1)
    )


def deviation_from_baseline(points: DataFrame, *, bucket: str, value: str, lookback: str = "30 days",
                            sigmas: float = 2.0, series: Sequence[str] = ()) -> DataFrame:
    """Distance from the trailing mean in sample deviations; fires beyond ``sigmas``."""
    earlier = _earlier(bucket, lookback, series)
    out = points.select(
        bucket, *series, value,
        F.avg(value).over(earlier).alias("baseline_mean"),
        F.stddev_samp(value).over(earlier).alias("baseline_std"),
    )
    fires = F.abs(F.col(value) - F.col("baseline_mean")) > sigmas * F.col("baseline_std")
    return out.withColumn("fires", F.coalesce(fires, F.lit(False))).orderBy(bucket, *series)


def consecutive_violations(points: DataFrame, *, bucket: str, value: str, threshold: float, bound: str,
                           periods: int = 2, period: str = "1 day", series: Sequence[str] = ()) -> DataFrame:
    """Runs of violating periods; the run fires once it is ``periods`` long. A missing period ends a run."""
    bad = points.filter(violated(F.col(value), F.lit(threshold), F.lit(bound)))
    step = width_seconds(period)
    number = F.row_number().over(Window.partitionBy(*series).orderBy(bucket))
    island = F.floor(F.unix_seconds(F.col(bucket)) / step) - number
    runs = bad.select(bucket, *series, value, island.alias("_island"))
    length = F.row_number().over(Window.partitionBy(*series, "_island").orderBy(bucket))
    return runs.withColumn("run_length", length).drop("_island").withColumn(
        "fires", F.col("run_length") >= periods
    ).orderBy(bucket, *series)


def period_change(points: DataFrame, *, bucket: str, value: str, limit_pct: float = 20.0,
                  series: Sequence[str] = ()) -> DataFrame:
    """Percent change against the previous point; fires beyond ``limit_pct`` either way."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(bucket))
    out = points.select(bucket, *series, value, before.alias("previous")).withColumn(
        "change_pct", (F.col(value) - F.col("previous")) / F.nullif(F.col("previous"), F.lit(0.0)) * 100
    )
    return out.withColumn("fires", F.coalesce(F.abs("change_pct") >= limit_pct, F.lit(False))).orderBy(bucket, *series)


def rising_trend(points: DataFrame, *, bucket: str, value: str, periods: int = 7,
                 series: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope per day over the last ``periods`` points; fires when a full window rises."""
    recent = Window.partitionBy(*series).orderBy(bucket).rowsBetween(-(periods - 1), 0)
    day = F.unix_seconds(F.col(bucket)) / 86400.0
    out = points.select(
        bucket, *series, value,
        F.regr_slope(F.col(value), day).over(recent).alias("slope"),
        F.count(value).over(recent).alias("_n"),
    )
    fires = F.coalesce((F.col("slope") > 0) & (F.col("_n") == periods), F.lit(False))
    return out.withColumn("fires", fires).drop("_n").orderBy(bucket, *series)


def median_shift(sketch_store: DataFrame, *, metric_name: str, as_of, recent: str = "1 day",
                 baseline: str = "30 days", limit: float = 0.15) -> DataFrame:
    """Sketch median of the newest period against the median of the baseline before it."""
    newest = width_seconds(recent)
    rows = sketch_store.filter(F.col("metric_name") == metric_name).filter(within(sketch_store, as_of, newest + width_seconds(baseline)))
    is_recent = F.col("timestamp") > F.timestamp_micros(F.unix_micros(F.lit(as_of).cast("timestamp")) - newest * 1_000_000)
    merged = rows.groupBy(is_recent.alias("recent")).agg(
        sketches.quantile(sketches.merge("value"), 0.5).alias("median")
    )
    medians = merged.agg(
        F.max(F.when(F.col("recent"), F.col("median"))).alias("recent_median"),
        F.max(F.when(~F.col("recent"), F.col("median"))).alias("baseline_median"),
    )
    shift = F.abs(F.col("recent_median") - F.col("baseline_median")) / F.nullif(F.abs("baseline_median"), F.lit(0.0))
    return medians.withColumn("shift", shift).withColumn("fires", F.coalesce(F.col("shift") > limit, F.lit(False)))


def audit_evidence(store: DataFrame, rules: DataFrame, *, metric_name: str, model_id: str, start, end,
                   generated_at: str, fired: DataFrame | None = None) -> DataFrame:
    """One row per day of [start, end] and rule of the metric, all columns text, absent values empty.

    A metric without rules still gets one row per day. ``fired`` has rule_id,
    alert_id and alert_timestamp; without it the alert columns stay empty.
    """
    spark = store.sparkSession
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    own = rules.filter(F.col("metric_name") == metric_name).drop("metric_name")
    grid = days.join(own, F.lit(True), "left")

    first = F.lit(start).cast("timestamp")
    points = store.filter(
        (F.col("metric_name") == metric_name)
        & (F.col("timestamp") >= first)
        & (F.col("timestamp") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    )
    daily = points.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.sum("value").alias("_sum"), F.avg("value").alias("_avg")
    )
    raw = F.when(F.col("aggregate") == "sum", F.col("_sum")).otherwise(F.col("_avg"))
    raw = F.when(F.col("missing_as_zero"), F.coalesce(raw, F.lit(0.0))).otherwise(raw)
    rows = grid.join(daily, "day", "left").withColumn("_value", F.when(F.col("rule_id").isNotNull(), raw))

    alert_fired = alert_id = alert_time = F.lit(None).cast("string")
    if fired is not None:
        earliest = fired.groupBy("rule_id", F.to_date("alert_timestamp").alias("day")).agg(
            F.min(F.struct("alert_timestamp", "alert_id")).alias("_first")
        )
        rows = rows.join(earliest, ["rule_id", "day"], "left")
        alert_fired = F.when(F.col("rule_id").isNotNull(), F.col("_first").isNotNull().cast("string"))
        alert_id = F.col("_first.alert_id")
        alert_time = F.date_format("_first.alert_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    broken = violated(F.col("_value"), F.col("threshold"), F.col("bound"))
    operator = F.when(F.col("bound") == "upper", ">").when(F.col("bound") == "lower", "<")
    texts = {
        "date": F.date_format("day", "yyyy-MM-dd"),
        "metric_name": F.lit(metric_name),
        "metric_value": F.col("_value").cast("string"),
        "threshold": F.col("threshold").cast("string"),
        "threshold_operator": operator,
        "control_pass": (~broken).cast("string"),
        "alert_expected": broken.cast("string"),
        "alert_fired": alert_fired,
        "alert_id": alert_id,
        "alert_timestamp": alert_time,
        "model_id": F.lit(model_id),
        "evidence_generated_at": F.lit(generated_at),
    }
    return rows.select(
        *[F.coalesce(texts[c], F.lit("")).alias(c) for c in EVIDENCE_COLUMNS]
    ).orderBy("date", "metric_name")
