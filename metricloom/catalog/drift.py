"""Registered queries: drift and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog import views
from metricloom.catalog.registry import register
from metricloom.operators import drift, quality

SPLIT = "2024-01-15"
START = "2024-01-01"


def clamped(bins: int = 10) -> str:
    return f"least({bins}, greatest(1, CAST(floor((amount - lo) / nullif(hi - lo, 0) * {bins}) AS INT) + 1))"


def psi_sum(current: str, reference: str) -> str:
    p, q = f"greatest({current}, 1e-6)", f"greatest(coalesce({reference}, 0), 1e-6)"
    return f"sum(({p} - {q}) * ln({p} / {q}))"


REFERENCE = f"(SELECT * FROM inf_binary WHERE ts < TIMESTAMP '{SPLIT}')"
CURRENT = f"(SELECT * FROM inf_binary WHERE ts >= TIMESTAMP '{SPLIT}')"


def binned_psi(keys: str, cur: str = CURRENT) -> str:
    names = keys.replace(" AS ", "|").split("|")[-1]
    return f"""
WITH b AS (SELECT min(amount) AS lo, max(amount) AS hi FROM {REFERENCE}),
r AS (SELECT {clamped()} AS bin, count(*) / sum(count(*)) OVER () AS q FROM {REFERENCE}, b GROUP BY 1),
c AS (SELECT {keys}, {clamped()} AS bin, count(*) AS n FROM {cur}, b GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY {names}) AS p FROM c)"""

DAILY_BINS = binned_psi("date_trunc('day', ts) AS bucket")


def split(spark, d):
    rows = views.binary(spark, d)
    cut = F.lit(SPLIT).cast("timestamp")
    return rows.filter(F.col("ts") >= cut), rows.filter(F.col("ts") < cut)


@register("psi_against_reference", "B25 J3 X6 W11", "bucket:t psi_against_reference:6",
          f"{DAILY_BINS} "
          f"SELECT bucket, {psi_sum('p', 'q')} AS psi_against_reference FROM s LEFT JOIN r USING (bin) GROUP BY 1")
def _(spark, d):
    current, reference = split(spark, d)
    return drift.psi_against_reference(current, reference, ts="ts", feature="amount")


@register("psi_categorical", "B26 D14 J3 W11 F1", "bucket:t psi_against_reference:6", f"""
WITH r AS (SELECT segment, count(*) / sum(count(*)) OVER () AS q FROM {REFERENCE} GROUP BY 1),
c AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, segment, count(*) AS n FROM {CURRENT} GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY bucket) AS p FROM c)
SELECT bucket, {psi_sum('p', 'q')} AS psi_against_reference FROM s LEFT JOIN r USING (segment) GROUP BY 1""")
def _(spark, d):
    current, reference = split(spark, d)
    return drift.psi_categorical(current, reference, ts="ts", feature="segment")


def trailing_sql(bin_sql: str, width: str, lookback: str) -> str:
    return f"""
WITH g AS (SELECT min(amount) AS lo, max(amount) AS hi FROM inf_binary),
e AS (SELECT time_bucket(INTERVAL '{width}', ts) AS bucket, {bin_sql} AS bin, count(*) AS n
      FROM inf_binary, g GROUP BY ALL),
c AS (SELECT *, n / sum(n) OVER (PARTITION BY bucket) AS p FROM e),
t AS (SELECT bucket, sum(n) AS n FROM e GROUP BY 1),
ref AS (SELECT c.bucket, c.bin, c.p,
    (SELECT sum(e.n) FROM e WHERE e.bin = c.bin AND e.bucket < c.bucket AND e.bucket >= c.bucket - INTERVAL '{lookback}')
    / (SELECT sum(t.n) FROM t WHERE t.bucket < c.bucket AND t.bucket >= c.bucket - INTERVAL '{lookback}') AS q FROM c)
SELECT bucket, {psi_sum('p', 'q')} AS psi_vs_30d_baseline FROM ref GROUP BY 1"""


WIDTH_BUCKET = "CASE WHEN amount >= hi THEN 11 ELSE CAST(floor(10 * (amount - lo) / (hi - lo)) AS INT) + 1 END"


@register("psi_trailing_30_days", "B27 D14 J9 J10 W8 X5 A7", "bucket:t psi_vs_30d_baseline:6",
          trailing_sql(WIDTH_BUCKET, "5 minutes", "30 days"))
def _(spark, d):
    return drift.psi_trailing(views.binary(spark, d), ts="ts", feature="amount")


@register("psi_trailing_7_days_hourly", "B27 J10", "bucket:t psi_vs_30d_baseline:6",
          trailing_sql(WIDTH_BUCKET, "1 hour", "7 days"))
def _(spark, d):
    return drift.psi_trailing(views.binary(spark, d), ts="ts", feature="amount", bucket="1 hour", lookback="7 days")


@register("psi_trailing_categorical", "D14 B26 J10", "bucket:t psi_vs_30d_baseline:6",
          trailing_sql("segment", "5 minutes", "30 days"))
def _(spark, d):
    return drift.psi_trailing(views.binary(spark, d), ts="ts", feature="segment", categorical=True)


DRIFT = f"""{DAILY_BINS},
missing AS (SELECT (SELECT min(bucket) FROM s) AS bucket, sum((1e-6 - q) * ln(1e-6 / q)) AS x FROM r
            WHERE bin NOT IN (SELECT bin FROM s)),
present AS (SELECT bucket, {psi_sum('p', 'q')} AS x FROM s LEFT JOIN r USING (bin) GROUP BY 1)
SELECT bucket AS ts, present.x + coalesce(missing.x, 0) AS drift_score, 'amount' AS monitored_column
FROM present LEFT JOIN missing USING (bucket)"""


def frame_drift(spark, d):
    return drift.drift_score(views.binary(spark, d), ts="ts", feature="amount", reference_start=START,
                             reference_end=SPLIT)


register("drift_score", "B28 J11 L8 J5", "ts:t drift_score:6 monitored_column:s", DRIFT)(frame_drift)


@register("drift_score_of_k", "B28", "ts:t drift_score:6 monitored_column:s",
          DRIFT.replace("amount", "k"))
def _(spark, d):
    return drift.drift_score(views.binary(spark, d), ts="ts", feature="k", reference_start=START, reference_end=SPLIT)

# --- Quality ---

COMPLETENESS = """
SELECT date_trunc('day', ts) AS bucket, avg(CAST(quality IS NOT NULL AND toxic IS NOT NULL AND lang IS NOT NULL AS INT))
  * 100 AS completeness_pct, count(*) FILTER (quality IS NULL OR toxic IS NULL OR lang IS NULL) AS incomplete_row_count
FROM inf_documents GROUP BY 1"""


def frame_completeness(spark, d):
    return quality.completeness(views.documents(spark, d), ts="ts", required=["quality", "toxic", "lang"])


register("completeness", "Q1 F2", "bucket:t completeness_pct:6 incomplete_row_count:i", COMPLETENESS)(frame_completeness)


@register("null_rates", "Q2 L4", "bucket:t series:s null_rate_pct:6", "SELECT bucket, series, null_rate_pct FROM ("
          "SELECT date_trunc('day', ts) AS bucket, unnest(['quality', 'lang']) AS series, "
          "unnest([(1 - count(quality) / count(*)) * 100, (1 - count(lang) / count(*)) * 100]) AS null_rate_pct "
          "FROM inf_documents GROUP BY 1)")
def _(spark, d):
    return quality.null_rates(views.documents(spark, d), ts="ts", columns=["quality", "lang"])


@register("validity_report", "Q3 A1 A2 A5", "total_rows:i non_null_timestamps:i non_null_probs:i non_null_labels:i "
          "valid_probs:i min_prob:6 max_prob:6 earliest_ts:t latest_ts:t", """
SELECT count(*) AS total_rows, count(ts) AS non_null_timestamps, count(amount) AS non_null_probs,
  count(label) AS non_null_labels, count(*) FILTER (amount BETWEEN 0 AND 1) AS valid_probs, min(amount) AS min_prob,
  max(amount) AS max_prob, min(ts) AS earliest_ts, max(ts) AS latest_ts FROM inf_binary""")
def _(spark, d):
    return quality.validity_report(views.binary(spark, d), ts="ts", label="label", prob="amount")


@register("regression_validity_report", "Q3 A5", "total_rows:i non_null_timestamps:i non_null_predictions:i "
          "non_null_actuals:i non_zero_actuals:i actuals_above_threshold:i earliest_timestamp:t latest_timestamp:t", """
SELECT count(*) AS total_rows, count(ts) AS non_null_timestamps, count(prediction) AS non_null_predictions,
  count(actual) AS non_null_actuals, count(*) FILTER (actual <> 0) AS non_zero_actuals,
  count(*) FILTER (abs(actual) > 0.0001) AS actuals_above_threshold, min(ts) AS earliest_timestamp,
  max(ts) AS latest_timestamp FROM inf_regression""")
def _(spark, d):
    return quality.regression_validity_report(views.regression(spark, d), ts="ts", prediction="prediction",
                                              actual="actual")


@register("value_ranges", "Q3 A2 A3", "min_prediction:4 max_prediction:4 avg_prediction:4 stddev_prediction:4 "
          "min_actual:4 max_actual:4 avg_actual:4 stddev_actual:4", "SELECT " + ", ".join(
              f"{f}({c}) AS {n}_{c}" for c in ("prediction", "actual")
              for n, f in (("min", "min"), ("max", "max"), ("avg", "avg"), ("stddev", "stddev_samp")))
          + " FROM inf_regression WHERE actual <> 0")
def _(spark, d):
    return quality.value_ranges(views.regression(spark, d).filter("actual <> 0"), ["prediction", "actual"])


@register("label_distribution", "Q4 W10 X3", "label:i n:i percentage:2",
          "SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS percentage FROM inf_binary GROUP BY 1")
def _(spark, d):
    return quality.label_distribution(views.binary(spark, d), label="label")


@register("label_mismatch", "Q5 A7 L4", "label:s source:s",
          "SELECT DISTINCT prediction AS label, 'predicted' AS source FROM inf_multiclass "
          "UNION ALL SELECT DISTINCT truth, 'actual' FROM inf_multiclass")
def _(spark, d):
    return quality.label_mismatch(views.multiclass(spark, d), prediction="prediction", actual="truth")


PERIOD = f"CASE WHEN ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{SPLIT}' THEN 'Reference' ELSE 'Current' END AS period"
# Ranges of the monitored amount.
AMOUNT_CUTS = ((10.0, "0-10"), (50.0, "10-50"), (100.0, "50-100"))


@register("period_distribution", "Q6 X18 W11", "period:s bin:s n:i pct:2", f"""
SELECT period, bin, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY period) * 100 AS pct FROM (
  SELECT {PERIOD}, CASE {' '.join(f"WHEN amount < {c} THEN '{n}'" for c, n in AMOUNT_CUTS)} ELSE '100+' END AS bin
  FROM inf_binary) GROUP BY 1, 2""")
def _(spark, d):
    return quality.period_distribution(views.binary(spark, d), ts="ts", value="amount", cuts=AMOUNT_CUTS,
                                       otherwise="100+", reference_start=START, reference_end=SPLIT)


@register("period_statistics", "Q7 A3", "period:s n:i min_value:6 max_value:6 avg_value:6 stddev_value:6",
          f"SELECT {PERIOD}, count(*) AS n, min(amount) AS min_value, max(amount) AS max_value, "
          f"avg(amount) AS avg_value, stddev_samp(amount) AS stddev_value FROM inf_binary GROUP BY 1")
def _(spark, d):
    return quality.period_statistics(views.binary(spark, d), ts="ts", value="amount", reference_start=START,
                                     reference_end=SPLIT)


@register("extreme_probabilities", "Q8 A5", "prob_exactly_zero:i prob_exactly_one:i prob_very_low:i prob_very_high:i total:i",
          """
SELECT count(*) FILTER (score = 0) AS prob_exactly_zero, count(*) FILTER (score = 1) AS prob_exactly_one,
  count(*) FILTER (score < 0.01) AS prob_very_low, count(*) FILTER (score > 0.99) AS prob_very_high,
  count(*) AS total FROM inf_binary""")
def _(spark, d):
    return quality.extreme_probabilities(views.binary(spark, d), prob="score")
