"""Registered queries: binary and multi-class classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog import views
from metricloom.catalog.registry import register
from metricloom.operators import binary, curves, probability, rank

SCORED = dict(ts="ts", label="label", score="score")
AT_HALF = dict(**SCORED, threshold=0.5)
BASELINE_AUC = 0.6

CONFUSION = """
SELECT {keys}, CAST(count(*) FILTER (label = 1 AND score >= 0.5) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (label = 0 AND score >= 0.5) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (label = 0 AND score < 0.5) AS DOUBLE) AS tn,
  CAST(count(*) FILTER (label = 1 AND score < 0.5) AS DOUBLE) AS fn
FROM inf_binary GROUP BY ALL"""
DAILY = CONFUSION.format(keys="date_trunc('day', ts) AS bucket")


def ratio0(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN ({num}) / ({den}) ELSE 0 END"


def ratio_null(num: str, den: str) -> str:
    return f"({num}) / nullif({den}, 0)"


ROC_POINTS = f"""
SELECT bucket, score AS threshold, {ratio0('cp', 'np')} AS tpr, {ratio0('cn', 'nn')} AS fpr FROM (
  SELECT bucket, score, sum(pos) OVER up AS cp, sum(neg) OVER up AS cn,
    sum(pos) OVER (PARTITION BY bucket) AS np, sum(neg) OVER (PARTITION BY bucket) AS nn
  FROM (SELECT date_trunc('day', ts) AS bucket, score, sum(CAST(label = 1 AS INT)) AS pos,
          sum(CAST(label = 0 AS INT)) AS neg FROM inf_binary GROUP BY ALL)
  WINDOW up AS (PARTITION BY bucket ORDER BY score DESC))"""

AUC = f"""
SELECT bucket, sum((fpr - coalesce(before_f, fpr)) * (tpr + coalesce(before_t, tpr)) / 2) AS auc_roc,
  max(abs(tpr - fpr)) AS ks FROM (
  SELECT *, lag(fpr) OVER along AS before_f, lag(tpr) OVER along AS before_t FROM (
    SELECT bucket, fpr, tpr FROM ({ROC_POINTS})
    UNION ALL SELECT DISTINCT date_trunc('day', ts), e, e FROM inf_binary, (VALUES (0.0), (1.0)) v(e))
  WINDOW along AS (PARTITION BY bucket ORDER BY fpr, tpr)) GROUP BY bucket"""

PR_POINTS = f"""
SELECT bucket, score AS threshold, cp / c AS precision, {ratio0('cp', 'np')} AS recall FROM (
  SELECT bucket, score, sum(pos) OVER up AS cp, sum(n) OVER up AS c, sum(pos) OVER (PARTITION BY bucket) AS np
  FROM (SELECT date_trunc('day', ts) AS bucket, score, sum(CAST(label = 1 AS INT)) AS pos, count(*) AS n
        FROM inf_binary GROUP BY ALL)
  WINDOW up AS (PARTITION BY bucket ORDER BY score DESC))"""


@register("roc_auc_ks", "B1 B2 B3 W1 W3 L4 J1", "bucket:t auc_roc:6 gini_coefficient:6 ks_statistic:6 ks_score:6",
          f"SELECT bucket, auc_roc, 2 * auc_roc - 1 AS gini_coefficient, ks AS ks_statistic, ks AS ks_score FROM ({AUC})")
def _(spark, d):
    return curves.curve_discrimination(views.binary(spark, d), **SCORED)


@register("auc_relative_decrease", "B4 X1", "bucket:t current_auc:6 auc_relative_decrease:6",
          f"SELECT bucket, auc_roc AS current_auc, ({BASELINE_AUC} - auc_roc) / {BASELINE_AUC} * 100 "
          f"AS auc_relative_decrease FROM ({AUC})")
def _(spark, d):
    return curves.auc_relative_decrease(views.binary(spark, d), baseline_auc=BASELINE_AUC, **SCORED)


@register("precision_recall_areas", "B5 B6 W3", "bucket:t auprc:6 average_precision:6", f"""
SELECT bucket, sum((recall - coalesce(r0, recall)) * (precision + coalesce(p0, precision)) / 2) AS auprc,
  sum((recall - coalesce(r0, 0)) * precision) AS average_precision FROM (
  SELECT *, lag(recall) OVER along AS r0, lag(precision) OVER along AS p0 FROM (
    SELECT bucket, recall, precision FROM ({PR_POINTS})
    UNION ALL SELECT DISTINCT date_trunc('day', ts), 0.0, 1.0 FROM inf_binary)
  WINDOW along AS (PARTITION BY bucket ORDER BY recall, precision DESC)) GROUP BY bucket""")
def _(spark, d):
    return curves.precision_recall_areas(views.binary(spark, d), **SCORED)


@register("roc_points", "B7 W1", "bucket:t threshold:9 tpr:6 fpr:6", ROC_POINTS)
def _(spark, d):
    return curves.roc_points(views.binary(spark, d), **SCORED)


@register("pr_points", "B8 W1", "bucket:t threshold:9 precision:6 recall:6", PR_POINTS)
def _(spark, d):
    return curves.pr_points(views.binary(spark, d), **SCORED)


@register("roc_auc_ks_by_segment_week", "B1 U5 F1", "bucket:t segment:s auc_roc:6 ks_statistic:6",
          f"SELECT bucket[1] AS bucket, bucket[2] AS segment, auc_roc, ks AS ks_statistic FROM ("
          + AUC.replace("date_trunc('day', ts)", "[CAST(date_trunc('week', ts) AS VARCHAR), segment]") + ")")
def _(spark, d):
    return curves.curve_discrimination(views.binary(spark, d), bucket="1 week", group_by=["segment"], **SCORED)


@register("confusion_counts", "B9 D8 A4 A5 F5 G1", "bucket:t tp:i fp:i tn:i fn:i", DAILY)
def _(spark, d):
    return binary.confusion_counts(views.binary(spark, d), **AT_HALF)


@register("detection_acceptance_profile", "B10 L7",
          "bucket:t capture_rate:6 correct_detection_rate:6 true_positive_rate:6 true_detection_rate:6 precision:6 "
          "correct_acceptance_rate:6 valid_detection_rate:6",
          f"""SELECT bucket, {ratio0('tp', 'tp + fn')} AS capture_rate, {ratio0('tp', 'tp + fp + tn + fn')}
  AS correct_detection_rate, capture_rate AS true_positive_rate, capture_rate AS true_detection_rate,
  {ratio0('tp', 'tp + fp')} AS precision, {ratio0('tn', 'tp + fp + tn + fn')} AS correct_acceptance_rate,
  {ratio0('tp + tn', 'tp + fp + tn + fn')} AS valid_detection_rate FROM ({DAILY})""")
def _(spark, d):
    return binary.detection_acceptance_profile(views.binary(spark, d), **AT_HALF)


@register("negative_predictive_value", "B11 F13", "bucket:t npv:6 specificity:6",
          f"SELECT bucket, {ratio_null('tn', 'tn + fn')} AS npv, {ratio_null('tn', 'tn + fp')} AS specificity FROM ({DAILY})")
def _(spark, d):
    return binary.negative_predictive_value(views.binary(spark, d), **AT_HALF)


@register("positive_class_error_profile", "B12 W10 J5 X4",
          "bucket:t adjusted_false_positive_rate:6 bad_case_rate:6 false_positive_ratio:6 valid_detection_rate:6 "
          "overprediction_rate:6 underprediction_rate:6 total_false_positive_rate:6",
          f"""SELECT bucket, {ratio0('fp', 'fp + tn')} AS adjusted_false_positive_rate,
  (tp + fn) / n AS bad_case_rate, fp / n AS false_positive_ratio, (tp + tn) / n AS valid_detection_rate,
  greatest((fp - fn) / n, 0) AS overprediction_rate, greatest((fn - fp) / n, 0) AS underprediction_rate,
  sum(fp) OVER () / sum(n) OVER () AS total_false_positive_rate
FROM (SELECT *, tp + fp + tn + fn AS n FROM ({DAILY}))""")
def _(spark, d):
    return binary.positive_class_error_profile(views.binary(spark, d), **AT_HALF)


@register("subgroup_rate_comparison", "B13", "bucket:t rate_difference:6 relative_bad_rate_difference:6", f"""
SELECT bucket, sel_a - sel_b AS rate_difference, CASE WHEN bad_b <> 0 THEN (bad_a - bad_b) / bad_b ELSE 0 END
  AS relative_bad_rate_difference FROM (
  SELECT date_trunc('day', ts) AS bucket,
    {', '.join(f"coalesce(avg(CAST({c} AS INT)) FILTER (grp = '{v}'), 0) AS {n}_{s}"
               for n, c in (('sel', 'score >= 0.5'), ('bad', 'label = 1')) for s, v in (('a', '0'), ('b', '1')))}
  FROM inf_binary GROUP BY 1)""")
def _(spark, d):
    return binary.subgroup_rate_comparison(views.binary(spark, d), group="grp", group_a="0", group_b="1", **AT_HALF)


@register("gini_impurity", "B14", "ts:t gini_impurity:6",
          "SELECT ts, 1 - (p ** 2 + (1 - p) ** 2) AS gini_impurity FROM "
          "(SELECT date_trunc('day', ts) AS ts, avg(CAST(score >= 0.5 AS INT)) AS p FROM inf_binary GROUP BY 1)")
def _(spark, d):
    return binary.gini_impurity(views.binary(spark, d), ts="ts", score="score")


RANK_OUT = ("bucket:t spearman_rank_correlation_coefficient:6 spearman_rho:6 "
            "kendall_rank_correlation_coefficient:6 kendall_tau:6")


@register("rank_association", "B15 B16 W4 W5 J6", RANK_OUT, """
WITH r AS (SELECT date_trunc('day', ts) AS bucket, score AS x, k AS y, row_id FROM inf_binary),
ranks AS (SELECT bucket, CAST(rank() OVER (PARTITION BY bucket ORDER BY x) AS DOUBLE) AS a,
            CAST(rank() OVER (PARTITION BY bucket ORDER BY y) AS DOUBLE) AS b FROM r),
rho AS (SELECT bucket, coalesce(corr(a, b), 0) AS rho FROM ranks GROUP BY 1),
tau AS (SELECT bucket, sum(sign(l.x - m.x) * sign(l.y - m.y)) AS s,
          sum(abs(sign(l.x - m.x) * sign(l.y - m.y))) AS t
        FROM r l JOIN r m USING (bucket) WHERE l.row_id < m.row_id GROUP BY 1)
SELECT bucket, rho AS spearman_rank_correlation_coefficient, rho AS spearman_rho,
  CASE WHEN coalesce(t, 0) = 0 THEN 0 ELSE s / t END AS kendall_rank_correlation_coefficient,
  kendall_rank_correlation_coefficient AS kendall_tau FROM rho LEFT JOIN tau USING (bucket)""")
def _(spark, d):
    return rank.rank_association(views.binary(spark, d), ts="ts", x="score", y="k")


LOSS = "CASE WHEN label = 1 THEN -ln(greatest(1e-15, least(1 - 1e-15, score))) " \
       "ELSE -ln(1 - greatest(1e-15, least(1 - 1e-15, score))) END"


@register("log_loss", "B17 F4 X2 X4", "ts:t log_loss:6 total_predictions:i avg_predicted_probability:6 "
          "positive_class_count:i negative_class_count:i", f"""
SELECT date_trunc('day', ts) AS ts, avg({LOSS}) AS log_loss, count(*) AS total_predictions,
  avg(score) AS avg_predicted_probability, count(*) FILTER (label = 1) AS positive_class_count,
  count(*) FILTER (label = 0) AS negative_class_count FROM inf_binary WHERE score BETWEEN 0 AND 1 GROUP BY 1""")
def _(spark, d):
    return probability.log_loss(views.binary(spark, d), ts="ts", label="label", prob="score")


@register("multiclass_log_loss", "B18", "ts:t log_loss:6", f"""
SELECT date_trunc('day', ts) AS ts, avg(-ln(greatest(1e-15, CASE truth
  {' '.join(f"WHEN '{p}' THEN prob_{i}" for i, p in enumerate(views.PRIORITIES))} END))) AS log_loss
FROM inf_multiclass GROUP BY 1""")
def _(spark, d):
    probs = {p: f"prob_{i}" for i, p in enumerate(views.PRIORITIES)}
    return probability.multiclass_log_loss(views.multiclass(spark, d), ts="ts", truth="truth", prob_columns=probs)


@register("random_guess_baseline", "B19", "class_balance:6 random_guess_log_loss:6",
          "SELECT p AS class_balance, -(p * ln(p) + (1 - p) * ln(1 - p)) AS random_guess_log_loss "
          "FROM (SELECT avg(label) AS p FROM inf_binary)")
def _(spark, d):
    return probability.random_guess_baseline(views.binary(spark, d), label="label")


CALIBRATION = """
SELECT {keys} floor(score * 10) / 10.0 AS prob_bin_start, avg(score) AS avg_pred, avg(label) AS actual_rate,
  count(*) AS n, avg(score) - avg(label) AS calibration_error FROM inf_binary GROUP BY ALL"""


@register("calibration_bins", "B20 X3", "prob_bin_start:6 avg_pred:6 actual_rate:6 calibration_error:6 n:i",
          CALIBRATION.format(keys=""))
def _(spark, d):
    return probability.calibration_bins(views.binary(spark, d), label="label", prob="score")


@register("calibration_by_version", "B21 L4",
          "grp:s prob_bin_start:6 avg_pred:6 actual_rate:6 calibration_error:6 n:i", CALIBRATION.format(keys="grp,"))
def _(spark, d):
    return probability.calibration_bins(views.binary(spark, d), label="label", prob="score", group_by=["grp"])


@register("calibration_deciles", "B22 W6", "decile:i avg_predicted_prob:6 observed_rate:6 sample_size:i decile_log_loss:6",
          """
SELECT decile, avg(score) AS avg_predicted_prob, avg(label) AS observed_rate, count(*) AS sample_size,
  avg(-ln(greatest(1e-15, CASE label WHEN 1 THEN score ELSE 1 - score END))) AS decile_log_loss
FROM (SELECT ntile(10) OVER (ORDER BY score, label) AS decile, score, label FROM inf_binary) GROUP BY 1""")
def _(spark, d):
    return probability.calibration_deciles(views.binary(spark, d), label="label", prob="score")


@register("calibration_deciles_by_segment", "B22 W6 U5",
          "segment:s decile:i avg_predicted_prob:6 observed_rate:6 sample_size:i decile_log_loss:6", """
SELECT segment, decile, avg(score) AS avg_predicted_prob, avg(label) AS observed_rate, count(*) AS sample_size,
  avg(-ln(greatest(1e-15, CASE label WHEN 1 THEN score ELSE 1 - score END))) AS decile_log_loss
FROM (SELECT segment, ntile(10) OVER (PARTITION BY segment ORDER BY score, label) AS decile, score, label
      FROM inf_binary) GROUP BY ALL""")
def _(spark, d):
    return probability.calibration_deciles(views.binary(spark, d), label="label", prob="score", group_by=["segment"])


@register("percentage_accuracy", "B23 A11 F2 F11", "ts:t percentage_accuracy:6 correct_predictions_count:i "
          "total_predictions_count:i accuracy_check:6", """
SELECT date_trunc('day', ts) AS ts, avg(CAST(pred = label AS INT)) * 100 AS percentage_accuracy,
  count(*) FILTER (pred = label) AS correct_predictions_count, count(*) AS total_predictions_count,
  percentage_accuracy AS accuracy_check FROM inf_binary GROUP BY 1""")
def _(spark, d):
    return binary.percentage_accuracy(views.binary(spark, d), ts="ts", label="label", prediction="pred")


@register("accuracy_by_segment", "B24", "segment:s accuracy:6 volume:i",
          "SELECT segment, avg(CAST(pred = label AS INT)) * 100 AS accuracy, count(*) AS volume FROM inf_binary GROUP BY 1")
def _(spark, d):
    return binary.accuracy_by(views.binary(spark, d), ["segment"], label="label", prediction="pred")


@register("accuracy_drilldown", "B24 F6 F7 X9", "day:d accuracy:6 volume:i", """
SELECT CAST(ts AS DATE) AS day, avg(CAST(pred = label AS INT)) * 100 AS accuracy, count(*) AS volume FROM inf_binary
WHERE segment = 'click' AND amount BETWEEN 20 AND 150 GROUP BY 1""")
def _(spark, d):
    rows = views.binary(spark, d).filter((F.col("segment") == "click") & F.col("amount").between(20, 150))
    return binary.accuracy_by(rows, [F.to_date("ts").alias("day")], label="label", prediction="pred")


@register("classification_rates", "B29 D15",
          "bucket:t tp:i fp:i tn:i fn:i accuracy:6 agreement_rate:6 precision:6 recall:6 f1_score:6 "
          "false_positive_rate:6 false_negative_rate:6 true_negative_rate:6 false_negative_pct:6",
          f"""SELECT *, (tp + tn) / n AS accuracy, (tp + tn) / n AS agreement_rate,
  {ratio_null('tp', 'tp + fp')} AS precision, {ratio_null('tp', 'tp + fn')} AS recall,
  {ratio_null('tp', 'tp + (fp + fn) / 2')} AS f1_score, {ratio_null('fp', 'fp + tn')} AS false_positive_rate,
  {ratio_null('fn', 'tp + fn')} AS false_negative_rate, {ratio_null('tn', 'fp + tn')} AS true_negative_rate,
  fn / n * 100 AS false_negative_pct FROM (SELECT *, nullif(tp + fp + tn + fn, 0) AS n FROM ({DAILY}))""")
def _(spark, d):
    return binary.classification_rates(views.binary(spark, d), **AT_HALF)


@register("class_confusion", "M12 A4", "bucket:t tp:i fp:i fn:i tn:i", """
SELECT date_trunc('day', ts) AS bucket, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp,
  count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn
FROM (SELECT ts, truth = '2-HIGH' AS t, prediction = '2-HIGH' AS p FROM inf_multiclass) GROUP BY 1""")
def _(spark, d):
    return binary.class_confusion(views.multiclass(spark, d), ts="ts", truth="truth", prediction="prediction",
                                  target="2-HIGH")


@register("confusion_integer_labels", "D6 F1", "bucket:t tp:i fp:i tn:i fn:i", """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, count(*) FILTER (label = 1 AND pred = 1) AS tp,
  count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 0 AND pred = 0) AS tn,
  count(*) FILTER (label = 1 AND pred = 0) AS fn FROM inf_binary GROUP BY 1""")
def _(spark, d):
    return binary.confusion_from_labels(views.binary(spark, d), ts="ts", label="label", prediction="pred",
                                        bucket="5 minutes")


@register("confusion_string_labels", "D7 X19", "bucket:t segment:s tp:i fp:i tn:i fn:i", """
SELECT date_trunc('week', ts) AS bucket, segment, count(*) FILTER (label = 1 AND pred = 1) AS tp,
  count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 0 AND pred = 0) AS tn,
  count(*) FILTER (label = 1 AND pred = 0) AS fn FROM inf_binary GROUP BY ALL""")
def _(spark, d):
    rows = views.binary(spark, d)
    for c in ("label", "pred"):
        rows = rows.withColumn(c, F.when(F.col(c) == 1, "bad").otherwise("good"))
    return binary.confusion_from_labels(rows, ts="ts", label="label", prediction="pred", true_label="bad",
                                        false_label="good", bucket="1 week", group_by=["segment"])
