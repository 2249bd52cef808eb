"""Dashboard series and listings over the metric store and over metric frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.numeric import band, flag, ratio_or_null
from metricloom.functions.timebuckets import bucket_start
from metricloom.operators.ordered import exact_quantiles
from metricloom.operators.timeseries import gapfill
from metricloom.plans.store import dimension, latest_version, select_points


@dataclass(frozen=True)
class Chart:
    """One gap-filled chart: which metrics, shown under which names, split by which dimensions."""

    metrics: Mapping[str, str]
    agg: str = "avg"
    dimensions: Sequence[str] = field(default_factory=tuple)
    # Values of the column_name dimension, where one stored metric serves many columns.
    column_names: Mapping[str, str] = field(default_factory=dict)
    require: Sequence[str] = field(default_factory=tuple)


# Chart names, their stored metrics and display names.
CHARTS: dict[str, Chart] = {
    "absolute-rate-difference": Chart({"rate_difference": "Rate Difference"}),
    "acceptance-accuracy": Chart({
        "valid_detection_rate": "Valid Detection Rate",
        "correct_acceptance_rate": "Correct Acceptance Rate"}),
    "auc-gini-over-time": Chart({"auc_roc": "AUC ROC", "gini_coefficient": "Gini Coefficient"}),
    "auc-relative-decrease-over-time": Chart({"auc_relative_decrease": "AUC Relative Decrease (%)"}),
    "auprc-over-time": Chart({"auprc": "AUPRC (Trapezoidal)", "average_precision": "Average Precision"}),
    "auprc-vs-auc-roc": Chart({"auprc": "AUPRC", "auc_roc": "AUC ROC"}),
    "combined-auc-ks": Chart({"auc_roc": "ROC AUC", "ks_statistic": "KS Statistic", "ks_score": "KS Score"}),
    "combined-disparity-view": Chart({
        "rate_difference": "Rate Difference",
        "relative_bad_rate_difference": "Relative Bad Rate Difference"}),
    "current-auc-vs-baseline": Chart({"current_auc": "Current AUC"}),
    "detection-vs-acceptance-tradeoff": Chart({
        "true_positive_rate": "True Positive Rate (Recall)",
        "correct_acceptance_rate": "Correct Acceptance Rate"}),
    "false-positive-ratio-vs-valid-detection-rate": Chart({
        "false_positive_ratio": "False Positive Ratio",
        "valid_detection_rate": "Valid Detection Rate"}),
    "fp-bad-case-rates-over-time": Chart({
        "adjusted_false_positive_rate": "Adjusted False Positive Rate",
        "false_positive_ratio": "False Positive Ratio",
        "total_false_positive_rate": "Total False Positive Rate",
        "bad_case_rate": "Bad Case Rate"}),
    "kendall-tau-over-time": Chart({"kendall_tau": "Kendall Tau"}),
    "ks-only": Chart({"ks_statistic": "KS Statistic"}),
    "ks-statistic-over-time": Chart({"ks_statistic": "KS Statistic", "ks_score": "KS Score"}),
    "npv-over-time": Chart({"npv": "Negative Predictive Value", "specificity": "Specificity (TNR)"}),
    "npv-vs-precision": Chart({"npv": "NPV (Negative Predictive Value)", "precision": "Precision (PPV)"}),
    "overprediction-vs-underprediction": Chart({
        "overprediction_rate": "Overprediction Rate",
        "underprediction_rate": "Underprediction Rate"}),
    "recall-variants-over-time": Chart({
        "true_detection_rate": "True Detection Rate",
        "capture_rate": "Capture Rate",
        "true_positive_rate": "True Positive Rate",
        "correct_acceptance_rate": "Correct Acceptance Rate"}),
    "relative-bad-rate-difference": Chart({"relative_bad_rate_difference": "Relative Bad Rate Difference"}),
    "spearman-kendall-combined": Chart({"spearman_rho": "Spearman Rank Correlation", "kendall_tau": "Kendall Tau"}),
    "spearman-over-time": Chart({"spearman_rho": "Spearman Rank Correlation"}),
    "cluster-silhouette-over-time": Chart({"cluster_silhouette": "cluster_silhouette"}, dimensions=("series",)),
    "silhouette-score-over-time": Chart({"silhouette_score": "Silhouette Score"}),
    "completeness-pct-over-time": Chart({"completeness_pct": "Data Completeness (%)"}),
    "incomplete-rows-over-time": Chart({"incomplete_row_count": "Incomplete Rows"}, agg="sum"),
    "classification-accuracy-by-doc-type": Chart(
        {"classification_accuracy_rate_metric": "Classification Accuracy"}, dimensions=("document_type",)),
    "classification-vs-extraction-accuracy": Chart(
        {"classification_accuracy_rate_metric": "Classification Accuracy", "numeric_sum": "Field Accuracy"},
        column_names={"field_accuracy": "Field Accuracy"}),
    "dl-extraction-pass-rate-by-state": Chart(
        {"inference_count": "Inference Count"}, agg="sum", dimensions=("image_quality_band",),
        require=("image_quality_band",)),
    "dl-field-match-rates": Chart({
        "dl_name_match_rate_metric": "Name",
        "dl_dob_match_rate_metric": "Date of Birth",
        "dl_license_num_match_rate_metric": "License Number",
        "dl_expiry_match_rate_metric": "Expiry Date",
        "dl_address_match_rate_metric": "Address"}),
    "extraction-pass-rate-by-doc-type": Chart(
        {"numeric_sum": "Extraction Pass Rate"}, agg="pass_rate", dimensions=("document_type",),
        column_names={"field_accuracy": "Field Accuracy"}),
    "field-accuracy-by-doc-type": Chart(
        {"numeric_sum": "Field Accuracy"}, dimensions=("document_type",),
        column_names={"field_accuracy": "Field Accuracy"}),
    "image-quality-score-by-doc-type": Chart(
        {"numeric_sum": "Image Quality Score"}, dimensions=("document_type",),
        column_names={"image_quality_score": "Image Quality Score"}),
    "inference-volume-by-doc-type": Chart(
        {"inference_count": "Inference Count"}, agg="sum", dimensions=("document_type",)),
    "ocr-confidence-by-doc-type": Chart(
        {"numeric_sum": "OCR Confidence"}, dimensions=("document_type",),
        column_names={"ocr_confidence": "OCR Confidence"}),
    "passport-field-match-rates": Chart(
        {"numeric_sum": "Field Match"}, dimensions=("column_name",),
        column_names={
            "pp_surname_match": "Surname",
            "pp_given_names_match": "Given Names",
            "pp_passport_num_match": "Passport Number",
            "pp_dob_match": "Date of Birth",
            "pp_expiry_match": "Expiry Date",
            "pp_nationality_match": "Nationality",
            "pp_sex_match": "Sex",
            "pp_mrz_match": "MRZ"}),
    "processing-time-by-doc-type": Chart(
        {"numeric_sum": "Processing Time"}, agg="avg_p95", dimensions=("document_type",),
        column_names={"processing_time_ms": "Processing Time"}),
    "absolute-error-over-time": Chart({"absolute_error": "Absolute Error"}),
    "cumulative-error-over-time": Chart({"cumulative_error": "Cumulative Error"}),
    "end-of-term-error-by-period": Chart({"end_of_term_error": "End of Term Error"}),
    "forecast-error-bias-tracking": Chart({"forecast_error": "Forecast Error"}),
    "mad-prediction-variability": Chart({"mad": "Mean Absolute Deviation"}),
    "mape-mdape-deviation-over-time": Chart({
        "mape": "Mean Absolute Percentage Error",
        "mdape": "Median Absolute Percentage Error",
        "deviation_ratio": "Deviation Ratio"}),
    "maximum-errors-over-time": Chart({
        "max_error": "Maximum Absolute Error",
        "max_relative_error": "Maximum Relative Error"}),
    "normalized-mad-over-time": Chart({"normalized_mad": "Normalized MAD"}),
    "percentage-error-distribution": Chart({"absolute_percentage_error": "Absolute Percentage Error"}),
    "rmse-over-time": Chart({"rmse": "Root Mean Squared Error"}),
    "ttm-error-smoothed-trend": Chart({"ttm_error": "TTM Error"}),
    "wmape-over-time": Chart({"wmape": "Weighted Mean Absolute Percentage Error"}),
}


def _renamed(key: Column, names: Mapping[str, str]) -> Column:
    out = None
    for value, name in names.items():
        out = F.when(key == value, name) if out is None else out.when(key == value, name)
    return key if out is None else out.otherwise(key)


def chart_points(store: DataFrame, chart: Chart, *, start=None, end=None) -> DataFrame:
    """The chart's rows of the store: newest versions of its metrics and dimension values."""
    points = latest_version(select_points(store, list(chart.metrics), start=start, end=end))
    for name in chart.require:
        points = points.filter(dimension(name).isNotNull())
    if chart.column_names:
        listed = dimension("column_name").isin(*chart.column_names)
        points = points.filter((F.col("metric_name") != "numeric_sum") | listed)
    return points


def gapfill_series(store: DataFrame, chart: Chart, *, start, end, width: str = "1 day") -> DataFrame:
    """Latest points per bucket, metric and dimension, with every bucket of [start, end) present and gaps at 0."""
    series = ["metric_name", *chart.dimensions]
    points = chart_points(store, chart, start=start, end=end).select(
        bucket_start("timestamp", width).alias("bucket"), "metric_name",
        *[dimension(d).alias(d) for d in chart.dimensions], "value",
    )
    keys = ["bucket", *series]
    if chart.agg == "avg_p95":
        values = exact_quantiles(points, keys, "value", {"p95_value": 0.95}, sums={"_sum": "value"})
        values = values.select(*keys, (F.col("_sum") / F.col("n")).alias("metric_value"), "p95_value")
        names = ["metric_value", "p95_value"]
    else:
        value = {
            "avg": F.avg("value"),
            "sum": F.sum("value"),
            "pass_rate": F.avg(flag(F.col("value") == 1.0)),
        }[chart.agg]
        values, names = points.groupBy(*keys).agg(value.alias("metric_value")), ["metric_value"]
    filled = gapfill(values, bucket="bucket", start=start, end=end, width=width, series=series, values=names)
    shown = _renamed(F.col("column_name"), chart.column_names) if "column_name" in chart.dimensions else _renamed(
        F.col("metric_name"), chart.metrics
    )
    return filled.select(
        "bucket", *series, shown.alias("friendly_name"), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names]
    ).orderBy(*keys)


def scaled_series(store: DataFrame, chart: Chart, *, start, end, percent: Sequence[str],
                  width: str = "1 day") -> DataFrame:
    """Rates shown as percentages, other metrics as they are."""
    out = gapfill_series(store, chart, start=start, end=end, width=width)
    scaled = F.when(F.col("metric_name").isin(*percent), F.col("metric_value") * 100).otherwise(F.col("metric_value"))
    return out.withColumn("metric_value", scaled)


# Quality bands of three headline metrics.
BANDS = {
    "log_loss": dict(cuts=((0.3, "Excellent"), (0.5, "Good"), (0.7, "Moderate")), otherwise="Poor"),
    "percentage_accuracy": dict(
        cuts=((90.0, "Excellent"), (80.0, "Good"), (70.0, "Fair")), otherwise="Poor", descending=True, inclusive=True),
    "drift_score": dict(cuts=((0.1, "Stable"), (0.2, "Moderate Drift")), otherwise="Significant Drift"),
}


def banded_series(store: DataFrame, metric: str, *, start, end, dimensions: Sequence[str] = (),
                  width: str = "1 day") -> DataFrame:
    """Gap-filled mean with its quality band; an empty bucket gets value 0 and the last band."""
    points = chart_points(store, Chart({metric: metric}), start=start, end=end).select(
        bucket_start("timestamp", width).alias("bucket"), *[dimension(d).alias(d) for d in dimensions], "value"
    )
    means = points.groupBy("bucket", *dimensions).agg(F.avg("value").alias("_mean"))
    filled = gapfill(means, bucket="bucket", start=start, end=end, width=width, series=dimensions, values=["_mean"])
    return filled.select(
        "bucket", *dimensions, F.coalesce("_mean", F.lit(0.0)).alias(metric),
        band(F.col("_mean"), **BANDS[metric]).alias("band"),
    ).orderBy("bucket", *dimensions)


def wide_metrics(store: DataFrame, aggregates: Mapping[str, str], *, start, end, width: str = "1 day",
                 dimensions: Sequence[str] = (), fill_gaps: bool = True) -> DataFrame:
    """One column per metric (its mean or sum) from one conditional aggregation instead of joins."""
    points = latest_version(select_points(store, list(aggregates), start=start, end=end)).select(
        bucket_start("timestamp", width).alias("bucket"), *[dimension(d).alias(d) for d in dimensions],
        "metric_name", "value",
    )
    how = {"avg": F.avg, "sum": F.sum}
    wide = points.groupBy("bucket", *dimensions).agg(*[
        how[kind](F.when(F.col("metric_name") == name, F.col("value"))).alias(name)
        for name, kind in aggregates.items()
    ])
    if not fill_gaps:
        return wide
    return gapfill(wide, bucket="bucket", start=start, end=end, width=width, series=dimensions,
                   values=list(aggregates))


# --- Listings over multi-label metric frames (ts, series, values) ---


def listing(frame: DataFrame, values: Sequence[str], *, label: bool = True) -> DataFrame:
    """All points of a metric frame, by time and label."""
    keys = ["ts", F.col("series").alias("label")] if label else ["ts"]
    return frame.select(*keys, *values).orderBy("ts", *(["label"] if label else []))


def label_averages(frame: DataFrame, values: Mapping[str, str]) -> DataFrame:
    first = next(iter(values.values()))
    return frame.groupBy(F.col("series").alias("label")).agg(
        *[F.avg(v).alias(name) for v, name in values.items()]
    ).orderBy(F.desc(first))


def low_confidence_labels(frame: DataFrame, *, below: float = 0.5, top: int = 20) -> DataFrame:
    means = frame.groupBy(F.col("series").alias("label")).agg(
        F.avg("avg_confidence").alias("avg_confidence"), F.count(F.lit(1)).alias("days_measured")
    )
    return means.filter(F.col("avg_confidence") < below).orderBy("avg_confidence", "label").limit(top)


def confidence_against_precision(confidence: DataFrame, quality: DataFrame) -> DataFrame:
    return confidence.join(quality, ["ts", "series"]).groupBy(F.col("series").alias("label")).agg(
        F.avg("avg_confidence").alias("avg_confidence"), F.avg("precision").alias("avg_precision")
    )


def exact_match_against_jaccard(exact: DataFrame, jaccard: DataFrame) -> DataFrame:
    return exact.join(jaccard, "ts", "full").select("ts", "exact_match_ratio", "jaccard_similarity").orderBy("ts")


def label_totals(frame: DataFrame) -> DataFrame:
    return frame.groupBy(F.col("series").alias("label")).agg(
        *[F.sum(c).alias(f"total_{c}") for c in ("tp", "fp", "fn")]
    ).orderBy(F.desc("total_tp"))


def label_error_rates(frame: DataFrame) -> DataFrame:
    totals = label_totals(frame)
    tp, fp, fn = F.col("total_tp"), F.col("total_fp"), F.col("total_fn")
    return totals.select(
        "label",
        ratio_or_null(fp, tp + fp).alias("false_positive_rate"),
        ratio_or_null(fn, tp + fn).alias("false_negative_rate"),
        ratio_or_null(fp + fn, tp + fp + fn).alias("total_error_rate"),
    ).orderBy(F.desc("total_error_rate"))


def top_labels(frame: DataFrame, *, top: int = 20) -> DataFrame:
    return frame.groupBy(F.col("series").alias("label")).agg(
        F.sum("class_count").alias("total_count")
    ).orderBy(F.desc("total_count"), "label").limit(top)


def _pair_totals(frame: DataFrame) -> DataFrame:
    return frame.groupBy("label_1", "label_2").agg(
        F.sum("pred_cooccurrence_count").alias("pred_count"), F.sum("gt_cooccurrence_count").alias("gt_count")
    )


def top_pairs(frame: DataFrame, *, top: int = 20) -> DataFrame:
    return _pair_totals(frame).orderBy(F.desc("gt_count"), "label_1", "label_2").limit(top)


def cooccurrence_heatmap(frame: DataFrame, *, which: str) -> DataFrame:
    return _pair_totals(frame).select(
        "label_1", "label_2", F.col(f"{which}_count").alias("total_cooccurrence")
    ).orderBy(F.desc("total_cooccurrence"))


def cooccurrence_difference(frame: DataFrame, *, more_than: float = 10, top: int = 50) -> DataFrame:
    both = _pair_totals(frame).filter(F.col("gt_count") > more_than)
    out = both.withColumn("difference", F.col("pred_count") - F.col("gt_count"))
    return out.orderBy(F.desc(F.abs("difference")), "label_1", "label_2").limit(top)


# --- Query patterns over the store ---


def rollup_by_dimensions(store: DataFrame, metric: str, dimensions: Sequence[str], *, start=None, end=None,
                         width: str = "1 day", how: str = "sum", name: str = "total",
                         where: Column | None = None) -> DataFrame:
    points = latest_version(select_points(store, [metric], start=start, end=end))
    if where is not None:
        points = points.filter(where)
    agg = {"sum": F.sum, "avg": F.avg}[how]
    return points.groupBy(
        bucket_start("timestamp", width).alias("bucket"), *[dimension(d).alias(d) for d in dimensions]
    ).agg(agg("value").alias(name)).orderBy("bucket", *dimensions)


def dimension_average(store: DataFrame, metric: str, dim: str, *, start=None, end=None,
                      name: str = "avg_value") -> DataFrame:
    points = latest_version(select_points(store, [metric], start=start, end=end))
    return points.groupBy(dimension(dim).alias("label")).agg(F.avg("value").alias(name))


def worst_by_dimension(store: DataFrame, metric: str, dim: str, *, n: int = 10, start=None, end=None) -> DataFrame:
    means = dimension_average(store, metric, dim, start=start, end=end)
    return means.orderBy("avg_value", "label").limit(n)


def across_dimensions(store: DataFrame, metric: str, dim: str, *, start=None, end=None,
                      width: str = "1 day") -> DataFrame:
    """Sum per label first, then total, mean and label count per bucket."""
    per_label = rollup_by_dimensions(store, metric, [dim], start=start, end=end, width=width)
    return per_label.groupBy("bucket").agg(
        F.sum("total").alias("total"), F.avg("total").alias("avg_per_label"), F.count_distinct(dim).alias("num_labels")
    ).orderBy("bucket")


def dimension_cardinality(store: DataFrame, dims: Sequence[str], *, start=None, end=None) -> DataFrame:
    points = latest_version(select_points(store, start=start, end=end))
    return points.groupBy("metric_name").agg(
        *[F.count_distinct(dimension(d)).alias(f"unique_{d}_values") for d in dims]
    )


def percentiles_across(store: DataFrame, metric: str, dim: str, quantiles: Mapping[str, float], *,
                       start=None, end=None) -> DataFrame:
    means = dimension_average(store, metric, dim, start=start, end=end)
    return exact_quantiles(means, [], "avg_value", quantiles).drop("n")


def frequency_and_quality(store: DataFrame, *, frequency: str, quality: str, dim: str, start=None, end=None) -> DataFrame:
    """Two metrics averaged per label in one aggregation, each put in a band."""
    points = latest_version(select_points(store, [frequency, quality], start=start, end=end))
    name, value = F.col("metric_name"), F.col("value")
    both = points.groupBy(dimension(dim).alias("label")).agg(
        F.avg(F.when(name == frequency, value)).alias("avg_frequency"),
        F.avg(F.when(name == quality, value)).alias("avg_quality"),
        F.count_if(name == frequency).alias("_nf"),
        F.count_if(name == quality).alias("_nq"),
    ).filter((F.col("_nf") > 0) & (F.col("_nq") > 0)).drop("_nf", "_nq")
    return both.withColumns({
        "label_frequency": band(F.col("avg_frequency"), ((0.05, "Rare"), (0.3, "Moderate")), "Common"),
        "label_quality": band(F.col("avg_quality"), ((0.5, "Poor"), (0.7, "Fair"), (0.9, "Good")), "Excellent"),
    }).orderBy(F.desc("avg_frequency"))


def version_comparison(store: DataFrame, metric: str, dim: str, *, start=None, end=None) -> DataFrame:
    points = latest_version(select_points(store, [metric], start=start, end=end))
    return points.groupBy(dimension(dim).alias("version")).agg(
        F.avg("value").alias("avg_value"), F.stddev_samp("value").alias("stddev_value"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
    ).orderBy(F.desc("avg_value"))


def status_list(store: DataFrame, metric: str, dim: str, *, critical: float = 0.5, warning: float = 0.7,
                start=None, end=None) -> DataFrame:
    """Labels below the warning level with their status, worst first."""
    means = dimension_average(store, metric, dim, start=start, end=end)
    status = band(F.col("avg_value"), ((critical, "CRITICAL"), (warning, "WARNING")), "OK")
    return means.withColumn("status", status).filter(F.col("avg_value") < warning).orderBy("avg_value")
