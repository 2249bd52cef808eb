"""Registered queries: alert rules and audit evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog import points as P
from metricloom.catalog.dashboards import DAY, over, spine_sql
from metricloom.catalog.plumbing import band_sql
from metricloom.catalog.registry import register
from metricloom.functions.timebuckets import bucket_start
from metricloom.operators import alerts, regression, sketch_checks, timeseries
from metricloom.catalog import views
from metricloom.plans import charts, store as S
from metricloom.session import scratch_path
from metricloom.sources import readers, writers

AS_OF = "2024-01-26 12:00:00"
DAY_SECONDS = 86400
# (rule_id, metric_name, aggregate, threshold, bound, window_seconds, missing_as_zero)
RULES = [
    ("accuracy-low", "valid_detection_rate", "avg", 0.85, "lower", 3 * DAY_SECONDS, False),
    ("bad-cases-high", "bad_case_rate", "avg", 0.30, "upper", 7 * DAY_SECONDS, False),
    ("false-positives-high", "false_positive_ratio", "avg", 0.50, "upper", 7 * DAY_SECONDS, False),
    ("no-traffic", "inference_count", "sum", 1.0, "lower", 3600, True),
    ("low-traffic", "inference_count", "sum", 500.0, "lower", DAY_SECONDS, True),
    ("no-such-metric", "unknown_metric", "avg", 1.0, "lower", DAY_SECONDS, False),
    ("no-such-volume", "unknown_volume", "sum", 1.0, "lower", DAY_SECONDS, True),
]
RULES_SQL = "(VALUES " + ", ".join(
    f"('{r[0]}', '{r[1]}', '{r[2]}', {r[3]}, '{r[4]}', {r[5]}, {str(r[6]).lower()})" for r in RULES
) + ") rules(rule_id, metric_name, aggregate, threshold, bound, window_seconds, missing_as_zero)"
RULE_SOURCES = ["detection", "errors", "volume"]


def rules(spark):
    return spark.createDataFrame(RULES, alerts.RULE_SCHEMA)


def rule_store(spark, d):
    return S.latest_version(P.store(spark, d, RULE_SOURCES))


CROSSED = "CASE bound WHEN 'upper' THEN metric_value > threshold ELSE metric_value < threshold END"


FIRES = over(RULE_SOURCES, f"""SELECT *, coalesce({CROSSED}, false) AS fires FROM (
  SELECT rule_id, r.metric_name, threshold, bound, CASE WHEN missing_as_zero THEN coalesce(v, 0) ELSE v END AS metric_value
  FROM (SELECT r.*, CASE r.aggregate WHEN 'sum' THEN (SELECT sum(value) FROM latest l WHERE l.metric_name = r.metric_name
      AND timestamp <= TIMESTAMP '{AS_OF}' AND timestamp > TIMESTAMP '{AS_OF}' - to_seconds(window_seconds))
    ELSE (SELECT avg(value) FROM latest l WHERE l.metric_name = r.metric_name
      AND timestamp <= TIMESTAMP '{AS_OF}' AND timestamp > TIMESTAMP '{AS_OF}' - to_seconds(window_seconds)) END AS v
    FROM {RULES_SQL.replace('rules(', 'r(')}) r)""")
FIRES_OUT = "rule_id:s metric_name:s threshold:6 bound:s metric_value:6 fires:b"


@register("alert_rules", "E1 E2 J10", FIRES_OUT, FIRES)
def _(spark, d):
    return alerts.evaluate_rules(rule_store(spark, d), rules(spark), as_of=AS_OF)


@register("alert_rules_from_store", "E1 E2 S7 S9", FIRES_OUT, FIRES)
def _(spark, d):
    path = scratch_path(spark, "alert-store")
    points = P.store(spark, d, RULE_SOURCES)
    for version in (1, 2):
        S.write_points(points.filter(F.col("metric_version") == version).drop("metric_version"), path, version=version)
    return alerts.evaluate_stored(S.read_store(spark, path), [alerts.Rule(*r) for r in RULES], as_of=AS_OF)


@register("alert_rules_over_time", "E1", "rule_id:s metric_name:s period:t threshold:6 bound:s metric_value:6 fires:b", over(
    RULE_SOURCES, f"""SELECT *, coalesce({CROSSED}, false) AS fires FROM (
  SELECT rule_id, metric_name, {DAY} AS period, threshold, bound,
    CASE aggregate WHEN 'sum' THEN sum(value) ELSE avg(value) END AS metric_value
  FROM latest JOIN {RULES_SQL} USING (metric_name) GROUP BY rule_id, metric_name, period, threshold, bound, aggregate)"""))
def _(spark, d):
    return alerts.evaluate_rules_over_time(rule_store(spark, d), rules(spark))


@register("alert_low_volume_hours", "E2 T1", "bucket:t total:4 fires:b", over(["volume"], f"""
SELECT bucket, coalesce(v, 0) AS total, coalesce(v, 0) < 12 AS fires FROM {spine_sql(P.JANUARY, '1 hour')}
LEFT JOIN (SELECT date_trunc('hour', timestamp) AS bucket, sum(value) AS v FROM latest GROUP BY 1) USING (bucket)"""))
def _(spark, d):
    hourly = timeseries.rollup(S.latest_version(P.store(spark, d, ["volume"])), width="1 hour")
    spine = timeseries.bucket_spine(spark, *P.JANUARY, "1 hour")
    return alerts.low_volume(hourly, spine, bucket="bucket", value="total", floor=12)


def hourly_volume(spark, d):
    return timeseries.rollup(S.latest_version(P.store(spark, d, ["volume"])), width="1 hour")


HOURLY = "SELECT date_trunc('hour', timestamp) AS bucket, sum(value) AS total FROM latest GROUP BY 1"


@register("alert_volume_against_day_before", "E3 W8", "bucket:t total:4 trailing_avg:6 fires:b", over(["volume"], f"""
SELECT *, coalesce(total < trailing_avg * 0.5, false) AS fires FROM (SELECT *, avg(total) OVER (ORDER BY bucket
  RANGE BETWEEN INTERVAL '24 hours' PRECEDING AND INTERVAL '1 second' PRECEDING) AS trailing_avg FROM ({HOURLY}))"""))
def _(spark, d):
    return alerts.against_trailing_average(hourly_volume(spark, d), bucket="bucket", value="total",
                                           lookback="24 hours", below=0.5)


MAE = ("SELECT date_trunc('day', ts) AS ts, avg(abs(prediction - actual)) AS mae FROM inf_regression GROUP BY 1")


def daily_mae(spark, d):
    return regression.mae_mse(views.regression(spark, d), ts="ts", prediction="prediction", actual="actual",
                              bucket="1 day").select("ts", "mae")


def trailing(expression: str) -> str:
    return f"{expression} OVER (ORDER BY ts RANGE BETWEEN INTERVAL '30 days' PRECEDING AND INTERVAL '1 second' PRECEDING)"


@register("alert_error_against_month", "E3 W8", "ts:t mae:4 trailing_avg:4 fires:b",
          f"SELECT *, coalesce(mae > trailing_avg * 1.5, false) AS fires FROM "
          f"(SELECT *, {trailing('avg(mae)')} AS trailing_avg FROM ({MAE}))")
def _(spark, d):
    return alerts.against_trailing_average(daily_mae(spark, d), bucket="ts", value="mae", lookback="30 days", above=1.5)


@register("alert_error_deviation", "E4 W8 A3", "ts:t mae:4 baseline_mean:4 baseline_std:3 fires:b",
          f"SELECT *, coalesce(abs(mae - baseline_mean) > 2 * baseline_std, false) AS fires FROM (SELECT *, "
          f"{trailing('avg(mae)')} AS baseline_mean, {trailing('stddev_samp(mae)')} AS baseline_std FROM ({MAE}))")
def _(spark, d):
    return alerts.deviation_from_baseline(daily_mae(spark, d), bucket="ts", value="mae")


@register("alert_consecutive_errors", "E5 W5", "ts:t mae:4 run_length:i fires:b", f"""
SELECT ts, mae, row_number() OVER (PARTITION BY island ORDER BY ts) AS run_length, run_length >= 2 AS fires FROM (
  SELECT *, ts - row_number() OVER (ORDER BY ts) * INTERVAL '1 day' AS island FROM ({MAE}) WHERE mae > 1500)""")
def _(spark, d):
    return alerts.consecutive_violations(daily_mae(spark, d), bucket="ts", value="mae", threshold=1500.0, bound="upper")


WEEKLY = "SELECT date_trunc('week', timestamp) AS bucket, sum(value) AS total FROM latest GROUP BY 1"


@register("alert_week_over_week", "E6 W3", "bucket:t total:4 previous:4 change_pct:6 fires:b", over(["volume"], f"""
SELECT *, coalesce(abs(change_pct) >= 20, false) AS fires FROM (
  SELECT *, lag(total) OVER (ORDER BY bucket) AS previous, (total / nullif(previous, 0) - 1) * 100 AS change_pct
  FROM ({WEEKLY}))"""))
def _(spark, d):
    weekly = timeseries.rollup(S.latest_version(P.store(spark, d, ["volume"])), width="1 week")
    return alerts.period_change(weekly, bucket="bucket", value="total")


FPR = f"SELECT {DAY} AS bucket, avg(value) AS total FROM latest WHERE metric_name = 'false_positive_ratio' GROUP BY 1"


@register("alert_rising_trend", "E6", "bucket:t total:6 slope:6 fires:b", over(["errors"], f"""
SELECT bucket, total, slope, slope > 0 AND n = 7 AS fires FROM (
  SELECT *, count(*) OVER w AS n, CASE WHEN count(*) OVER w > 1 THEN regr_slope(total, epoch(bucket) / 86400) OVER w END AS slope FROM ({FPR})
  WINDOW w AS (ORDER BY bucket ROWS 6 PRECEDING))""").replace("slope > 0 AND n = 7", "coalesce(slope > 0 AND n = 7, false)"))
def _(spark, d):
    daily = charts.rollup_by_dimensions(P.store(spark, d, ["errors"]), "false_positive_ratio", [], how="avg")
    return alerts.rising_trend(daily, bucket="bucket", value="total")


SHIFT_BANDS = band_sql("vs", {"median": 0.5})


@register("alert_sketch_median_shift", "E7 K2 K3", "recent_low:6 recent_high:6 baseline_low:6 baseline_high:6 held:b must_fire:b agrees:b", f"""
SELECT *, TRUE AS held, baseline_low > 0 AND (recent_low > 1.15 * baseline_high OR recent_high < 0.85 * baseline_low) AS must_fire, TRUE AS agrees
FROM (SELECT max(median_low) FILTER (recent) AS recent_low, max(median_high) FILTER (recent) AS recent_high,
        max(median_low) FILTER (NOT recent) AS baseline_low, max(median_high) FILTER (NOT recent) AS baseline_high
      FROM (SELECT recent, {SHIFT_BANDS} FROM (
        SELECT slot > TIMESTAMP '2024-01-29 00:00:00' AS recent, list(amount ORDER BY amount) AS vs, count(*) AS n
        FROM (SELECT time_bucket(INTERVAL '5 minutes', ts) AS slot, amount FROM inf_binary WHERE amount IS NOT NULL)
        WHERE slot <= TIMESTAMP '2024-01-30 00:00:00' AND slot > TIMESTAMP '2023-12-30 00:00:00' GROUP BY 1)))""")
def _(spark, d):
    rows = views.binary(spark, d)
    sketched = S.sketch_points(rows, ts="ts", value="amount", metric_name="amount", model_id=P.MODEL)
    answer = alerts.median_shift(sketched, metric_name="amount", as_of="2024-01-30 00:00:00")
    slot = bucket_start("ts", "5 minutes")
    inside = rows.filter((slot <= F.lit("2024-01-30").cast("timestamp")) & (slot > F.lit("2023-12-30").cast("timestamp")))
    sides = inside.select((slot > F.lit("2024-01-29").cast("timestamp")).alias("recent"), "amount")
    bands = sketch_checks.quantile_bands(sides, ["recent"], "amount", {"median": 0.5})
    # One row with both bands, beside the one row of the alert.
    row = bands.agg(*[F.max(F.when(F.col("recent") == side, F.col(f"median_{end}"))).alias(f"{name}_{end}")
                      for name, side in (("recent", True), ("baseline", False)) for end in ("low", "high")]).crossJoin(answer)
    up, down = F.col("recent_low") > 1.15 * F.col("baseline_high"), F.col("recent_high") < 0.85 * F.col("baseline_low")
    cannot = (F.col("recent_low") >= 0.85 * F.col("baseline_high")) & (F.col("recent_high") <= 1.15 * F.col("baseline_low"))
    must = (F.col("baseline_low") > 0) & (up | down)
    held = F.col("recent_median").between(F.col("recent_low"), F.col("recent_high")) & F.col("baseline_median").between(
        F.col("baseline_low"), F.col("baseline_high"))
    return row.select("recent_low", "recent_high", "baseline_low", "baseline_high", held.alias("held"), must.alias("must_fire"),
                      (F.when(must, F.col("fires")).when((F.col("baseline_low") > 0) & cannot, ~F.col("fires")).otherwise(True)).alias("agrees"))


FIRED = f"""
SELECT rule_id, period + INTERVAL '{{}} hours' AS alert_timestamp, rule_id || '-{{}}-' || strftime(period, '%d') AS alert_id
FROM (SELECT rule_id, {DAY} AS period, avg(value) AS v, any_value(threshold) AS t FROM latest JOIN {RULES_SQL}
  USING (metric_name) WHERE rule_id = 'accuracy-low' GROUP BY ALL) WHERE v < t"""


# The value's text is compared as a number: engines print the last digits of a double differently.
EVIDENCE_OUT = " ".join(f"{c}:6" if c == "metric_value" else f"{c}:s" for c in alerts.EVIDENCE_COLUMNS)


def with_numeric_value(evidence):
    return evidence.withColumn("metric_value", F.expr("try_cast(metric_value AS double)"))


EVIDENCE = over(
    RULE_SOURCES, f"""
SELECT strftime(day, '%Y-%m-%d') AS date, 'valid_detection_rate' AS metric_name, v AS metric_value, '0.85' AS threshold, '<' AS threshold_operator,
  CASE WHEN v IS NULL THEN '' WHEN v < 0.85 THEN 'false' ELSE 'true' END AS control_pass,
  CASE WHEN v IS NULL THEN '' WHEN v < 0.85 THEN 'true' ELSE 'false' END AS alert_expected,
  CASE WHEN f.rule_id IS NULL THEN 'false' ELSE 'true' END AS alert_fired, coalesce(f.alert_id, '') AS alert_id,
  coalesce(strftime(f.alert_timestamp, '%Y-%m-%dT%H:%M:%SZ'), '') AS alert_timestamp, '{P.MODEL}' AS model_id,
  '2024-02-01T00:00:00Z' AS evidence_generated_at
FROM (SELECT unnest(range(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-03', INTERVAL '1 day')) AS day)
LEFT JOIN (SELECT {DAY} AS day, avg(value) AS v FROM latest WHERE metric_name = 'valid_detection_rate' GROUP BY 1) USING (day)
LEFT JOIN ({FIRED.format(6, 'first')}) f ON date_trunc('day', f.alert_timestamp) = day""")


def evidence(spark, d):
    rows, ruleset = rule_store(spark, d), rules(spark)
    fired = alerts.evaluate_rules_over_time(rows, ruleset).filter(
        F.col("fires") & (F.col("rule_id") == "accuracy-low")
    )
    # Two alerts per day; the earlier one is the evidence.
    day = F.date_format("period", "dd")
    both = F.array(*[
        F.struct(
            (F.col("period") + F.expr(f"INTERVAL {hours} HOURS")).alias("alert_timestamp"),
            F.concat("rule_id", F.lit(f"-{which}-"), day).alias("alert_id"),
        )
        for hours, which in ((9, "second"), (6, "first"))
    ])
    fired = fired.select("rule_id", F.explode(both).alias("_a")).select("rule_id", "_a.*")
    return alerts.audit_evidence(
        rows, ruleset, metric_name="valid_detection_rate", model_id=P.MODEL, start="2023-12-30", end="2024-02-02",
        generated_at="2024-02-01T00:00:00Z", fired=fired,
    )


@register("audit_evidence", "E8 J3", EVIDENCE_OUT, EVIDENCE)
def _(spark, d):
    return with_numeric_value(evidence(spark, d))


@register("audit_evidence_file", "E8 S10", EVIDENCE_OUT, EVIDENCE)
def _(spark, d):
    path = scratch_path(spark, "evidence")
    writers.write_evidence_csv(evidence(spark, d), path)
    schema = ", ".join(f"{c} string" for c in alerts.EVIDENCE_COLUMNS)
    return with_numeric_value(readers.read_csv(spark, path, schema).na.fill(""))


@register("audit_evidence_without_rules", "E8", EVIDENCE_OUT, over(
    ["volume"], f"""SELECT strftime(day, '%Y-%m-%d') AS date, 'auc_roc' AS metric_name, NULL AS metric_value, '' AS threshold,
  '' AS threshold_operator, '' AS control_pass, '' AS alert_expected, '' AS alert_fired, '' AS alert_id, '' AS alert_timestamp,
  '{P.MODEL}' AS model_id, '2024-02-01T00:00:00Z' AS evidence_generated_at
FROM (SELECT unnest(range((SELECT min(timestamp)::DATE::TIMESTAMP FROM latest), TIMESTAMP '2024-02-03', INTERVAL '1 day')) AS day)"""))
def _(spark, d):
    return with_numeric_value(alerts.audit_evidence(
        rule_store(spark, d), rules(spark), metric_name="auc_roc", model_id=P.MODEL, start="2024-01-01", end="2024-02-02",
        generated_at="2024-02-01T00:00:00Z"))
