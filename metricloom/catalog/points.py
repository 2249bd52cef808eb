"""A metric store filled from registered queries, in Spark and in SQL.

Every point is stored twice: version 1 holds half the value, version 2 the value
itself except on the 10th of a month. Reading the latest version therefore gives
the value, and half of it on those days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.catalog import binary, defaults, drift, multilabel, regression, views  # noqa: F401
from metricloom.catalog.registry import QUERIES, register
from metricloom.functions.timebuckets import bucket_start
from metricloom.plans.store import ReportedMetric, to_long

MODEL = "model-1"
JANUARY = ("2023-12-30", "2024-02-03")
YEARS = ("1994-12-30", "2002-01-05")


@dataclass(frozen=True)
class Source:
    """A registered query whose columns are stored as metrics."""

    query: str
    ts: str
    metrics: Mapping[str, str]
    dims: Sequence[str] = field(default_factory=tuple)
    span: tuple[str, str] = JANUARY


def same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


SOURCES: dict[str, Source] = {
    "curves": Source("roc_auc_ks", "bucket", same("auc_roc", "gini_coefficient", "ks_statistic", "ks_score")),
    "auc_decrease": Source("auc_relative_decrease", "bucket", same("current_auc", "auc_relative_decrease")),
    "pr": Source("precision_recall_areas", "bucket", same("auprc", "average_precision")),
    "detection": Source("detection_acceptance_profile", "bucket", same(
        "capture_rate", "true_positive_rate", "true_detection_rate", "precision", "correct_acceptance_rate",
        "valid_detection_rate")),
    "npv": Source("negative_predictive_value", "bucket", same("npv", "specificity")),
    "errors": Source("positive_class_error_profile", "bucket", same(
        "adjusted_false_positive_rate", "bad_case_rate", "false_positive_ratio", "overprediction_rate",
        "underprediction_rate", "total_false_positive_rate")),
    "subgroups": Source("subgroup_rate_comparison", "bucket", same("rate_difference", "relative_bad_rate_difference")),
    "ranks": Source("rank_association", "bucket", same("spearman_rho", "kendall_tau")),
    "silhouette": Source("silhouette", "bucket", same("cluster_silhouette", "silhouette_score"), ("series",)),
    "completeness": Source("completeness", "bucket", same("completeness_pct", "incomplete_row_count")),
    "drift_amount": Source("drift_score", "ts", same("drift_score"), ("monitored_column",)),
    "drift_k": Source("drift_score_of_k", "ts", same("drift_score"), ("monitored_column",)),
    "log_loss": Source("log_loss", "ts", same(
        "log_loss", "avg_predicted_probability", "positive_class_count", "total_predictions")),
    "accuracy": Source("percentage_accuracy", "ts", same(
        "percentage_accuracy", "correct_predictions_count", "total_predictions_count")),
    "volume": Source("inference_count", "bucket", same("inference_count"), ("segment",)),
    "responses": Source("pass_fail_count", "bucket", {"n": "inference_count"}, ("result",)),
    "hallucinations": Source("hallucination_count", "bucket", same("hallucination_count"), ("role",)),
    "id_sums": Source("identity_numeric_sums", "bucket", same("numeric_sum"), ("document_type", "column_name")),
    "id_counts": Source("identity_counts", "bucket", same("inference_count"), ("document_type", "image_quality_band")),
    "id_rates": Source("identity_rates", "bucket", same(
        "classification_accuracy_rate_metric", "dl_name_match_rate_metric", "dl_dob_match_rate_metric",
        "dl_license_num_match_rate_metric", "dl_expiry_match_rate_metric", "dl_address_match_rate_metric"),
        ("document_type",)),
    "rmse": Source("rmse", "ts", same("rmse"), span=YEARS),
    "cumulative": Source("cumulative_error", "ts", same("cumulative_error"), span=YEARS),
    "term_end": Source("end_of_month_error", "ts", same("end_of_term_error"), span=YEARS),
    "absolute": Source("absolute_error_rows", "ts", same("absolute_error"), span=YEARS),
    "signed": Source("forecast_error_rows", "ts", same("forecast_error"), span=YEARS),
    "percentage": Source("absolute_percentage_error_rows", "ts", same("absolute_percentage_error"), span=YEARS),
    "maximum": Source("maximum_errors", "ts", same("max_error", "max_relative_error"), span=YEARS),
    "mad": Source("mean_absolute_deviation", "ts", same("mad"), span=YEARS),
    "nmad": Source("normalized_mad", "ts", same("normalized_mad"), span=YEARS),
    "mape": Source("percentage_errors", "ts", same("mape", "mdape", "deviation_ratio"), span=YEARS),
    "ttm": Source("trailing_twelve_months_error", "ts", same("ttm_error"), span=YEARS),
    "wmape": Source("wmape", "ts", same("wmape"), span=YEARS),
    "core_accuracy": Source("core_accuracy", "ts", same(
        "core_accuracy_rate", "accurate_predictions_count", "total_predictions_count", "avg_percentage_error"),
        span=YEARS),
    "core_accuracy_segments": Source("core_accuracy_by_segment", "ts", {"core_accuracy_rate": "accuracy"},
                                     ("segment",), span=YEARS),
    "label_quality": Source("label_precision_recall_f1", "ts", same("precision", "recall", "f1_score"), ("series",), YEARS),
    "label_counts": Source("label_confusion", "ts", same("tp", "fp", "fn"), ("series",), YEARS),
    "coverage": Source("label_coverage_ratio", "ts", same("coverage_ratio"), ("series",), YEARS),
    "pairs": Source("label_cooccurrence", "ts", same("pred_cooccurrence_count", "gt_cooccurrence_count"),
                    ("label_1", "label_2"), YEARS),
}


def points(spark, d, sources: Sequence[str]) -> DataFrame:
    """Long rows of the sources, before versions."""
    out = None
    for key in sources:
        s = SOURCES[key]
        reports = [ReportedMetric(name, column, s.ts, s.dims) for column, name in s.metrics.items()]
        part = to_long(QUERIES[s.query].build(spark, d), reports, model_id=MODEL)
        out = part if out is None else out.unionByName(part)
    return out


def store(spark, d, sources: Sequence[str]) -> DataFrame:
    versions = F.array(
        F.struct(F.lit(1).alias("metric_version"), (F.col("value") * 0.5).alias("value")),
        F.struct(F.lit(2).alias("metric_version"), F.col("value").alias("value")),
    )
    rows = points(spark, d, sources).select(
        "model_id", "metric_name", "timestamp", "dimensions", F.explode(versions).alias("_v")
    )
    kept = rows.filter((F.col("_v.metric_version") == 1) | (F.dayofmonth("timestamp") != 10))
    return kept.select("model_id", "metric_name", "timestamp", "_v.metric_version", "_v.value", "dimensions")


def latest_sql(sources: Sequence[str], where: str = "true") -> str:
    """CTE list: ``store`` and ``latest`` of the sources."""
    ctes, selects = [], []
    for key in sources:
        s = SOURCES[key]
        ctes.append(f"src_{key} AS MATERIALIZED ({QUERIES[s.query].sql})")
        dims = "MAP {" + ", ".join(f"'{x}': CAST({x} AS VARCHAR)" for x in s.dims) + "}" if s.dims else (
            "CAST(MAP {} AS MAP(VARCHAR, VARCHAR))")
        selects += [
            f"SELECT CAST({s.ts} AS TIMESTAMP) AS timestamp, '{name}' AS metric_name, CAST({column} AS DOUBLE) AS v, "
            f"{dims} AS dims FROM src_{key}"
            for column, name in s.metrics.items()
        ]
    ctes.append(
        "store AS (SELECT timestamp, metric_name, version, CASE version WHEN 1 THEN v * 0.5 ELSE v END AS value, dims "
        f"FROM ({' UNION ALL '.join(selects)}), (VALUES (1), (2)) x(version) WHERE version = 1 OR day(timestamp) <> 10)"
    )
    ctes.append(
        "latest AS (SELECT * FROM (SELECT *, max(version) OVER (PARTITION BY metric_name, timestamp) AS newest FROM store) "
        f"WHERE version = newest AND {where})"
    )
    return ", ".join(ctes)


# --- Stored metrics of a document-checking model, from the events table ---

# Monitored columns and how the test data stands in for them.
IDENTITY_COLUMNS = {
    "field_accuracy": "CASE WHEN value < 60 THEN 1.0 ELSE 0.0 END",
    "image_quality_score": "value / 5",
    "ocr_confidence": "least(value / 190, 1)",
    "processing_time_ms": "value * 3",
    "pp_surname_match": "CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END",
    "pp_given_names_match": "CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 0.0 END",
    "pp_passport_num_match": "CASE WHEN user_id % 4 = 0 THEN 1.0 ELSE 0.0 END",
    "pp_dob_match": "CASE WHEN user_id % 5 = 0 THEN 1.0 ELSE 0.0 END",
    "pp_expiry_match": "CASE WHEN user_id % 6 = 0 THEN 1.0 ELSE 0.0 END",
    "pp_nationality_match": "CASE WHEN user_id % 7 = 0 THEN 1.0 ELSE 0.0 END",
    "pp_sex_match": "CASE WHEN user_id % 8 = 0 THEN 1.0 ELSE 0.0 END",
    "pp_mrz_match": "CASE WHEN user_id % 9 = 0 THEN 1.0 ELSE 0.0 END",
}
FIVE = "time_bucket(INTERVAL '5 minutes', ts) AS bucket"


@register("identity_numeric_sums", "D5 L4", "bucket:t document_type:s column_name:s numeric_sum:6", " UNION ALL ".join(
    f"SELECT {FIVE}, event_type AS document_type, '{c}' AS column_name, sum({e}) AS numeric_sum FROM events GROUP BY ALL"
    for c, e in IDENTITY_COLUMNS.items()))
def _(spark, d):
    wide = views.events(spark, d).groupBy(
        bucket_start("ts", "5 minutes").alias("bucket"), F.col("event_type").alias("document_type")
    ).agg(*[F.sum(F.expr(e).cast("double")).alias(c) for c, e in IDENTITY_COLUMNS.items()])
    return wide.unpivot(["bucket", "document_type"], list(IDENTITY_COLUMNS), "column_name", "numeric_sum")


QUALITY_BAND = "CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END"


@register("identity_counts", "D1 U5", "bucket:t document_type:s image_quality_band:s inference_count:i",
          f"SELECT {FIVE}, event_type AS document_type, {QUALITY_BAND} AS image_quality_band, count(*) AS inference_count "
          "FROM events GROUP BY ALL")
def _(spark, d):
    return views.events(spark, d).groupBy(
        bucket_start("ts", "5 minutes").alias("bucket"), F.col("event_type").alias("document_type"),
        F.expr(QUALITY_BAND).alias("image_quality_band"),
    ).agg(F.count(F.lit(1)).alias("inference_count"))


IDENTITY_RATES = {
    name: f"CASE WHEN (user_id + {i}) % 5 < 4 THEN 1.0 ELSE 0.0 END"
    for i, name in enumerate(SOURCES["id_rates"].metrics)
}


@register("identity_rates", "A11", "bucket:t document_type:s " + " ".join(f"{n}:6" for n in IDENTITY_RATES),
          f"SELECT date_trunc('hour', ts) AS bucket, event_type AS document_type, "
          + ", ".join(f"avg({e}) AS {n}" for n, e in IDENTITY_RATES.items()) + " FROM events GROUP BY ALL")
def _(spark, d):
    return views.events(spark, d).groupBy(
        bucket_start("ts", "1 hour").alias("bucket"), F.col("event_type").alias("document_type")
    ).agg(*[F.avg(F.expr(e).cast("double")).alias(n) for n, e in IDENTITY_RATES.items()])
