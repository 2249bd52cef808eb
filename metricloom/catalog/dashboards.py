"""Registered queries: gap-filled charts, store queries and time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.catalog import points as P
from metricloom.catalog.registry import register
from metricloom.operators import timeseries as T
from metricloom.plans import charts, store as S

DAY = "date_trunc('day', timestamp)"


def spine_sql(span, step: str = "1 day") -> str:
    return f"(SELECT unnest(range(TIMESTAMP '{span[0]}', TIMESTAMP '{span[1]}', INTERVAL '{step}')) AS bucket)"


def filled_sql(values: str, keys: list[str], span, step: str = "1 day") -> str:
    """Outer join of the spine times the series with the aggregated points, under the names of ``a``."""
    series = f"(SELECT DISTINCT {', '.join(keys)} FROM ({values}))" if keys else "(SELECT 1)"
    on = " AND ".join(["f.bucket = a.bucket", *[f"f.{k} IS NOT DISTINCT FROM a.{k}" for k in keys]])
    cols = ", ".join(["coalesce(a.bucket, f.bucket) AS bucket", *[f"coalesce(a.{k}, f.{k}) AS {k}" for k in keys]])
    return f"SELECT {cols}, a.* EXCLUDE ({', '.join(['bucket', *keys])}) FROM ({values}) a FULL JOIN " \
           f"(SELECT * FROM {spine_sql(span, step)}, {series}) f ON {on}"


CHART_SOURCES: dict[str, list[str]] = {}
for _name, _chart in charts.CHARTS.items():
    _wanted = set(_chart.metrics)
    if {"numeric_sum", "classification_accuracy_rate_metric"} & _wanted or "document_type" in _chart.dimensions \
            or _chart.require or any(m.startswith("dl_") for m in _wanted):
        _pool = ["id_sums", "id_counts", "id_rates"]
    else:
        _pool = [k for k in P.SOURCES if not k.startswith(("id_", "label_", "core_", "volume", "responses"))]
    _found = []
    for _key in _pool:
        _hit = _wanted & set(P.SOURCES[_key].metrics.values())
        if _hit:
            _found.append(_key)
            _wanted -= _hit
    CHART_SOURCES[_name] = _found


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def renamed_sql(column: str, names) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {column} END"


def chart_sql(name: str) -> str:
    chart, sources = charts.CHARTS[name], CHART_SOURCES[name]
    span = P.SOURCES[sources[0]].span
    where = [f"metric_name IN ({quoted(chart.metrics)})", f"timestamp BETWEEN '{span[0]}' AND '{span[1]}'"]
    where += [f"dims['{x}'] IS NOT NULL" for x in chart.require]
    if chart.column_names:
        where.append(f"(metric_name <> 'numeric_sum' OR dims['column_name'] IN ({quoted(chart.column_names)}))")
    keys = ["metric_name", *chart.dimensions]
    value = {"avg": "avg(value) AS metric_value", "sum": "sum(value) AS metric_value",
             "pass_rate": "avg(CASE WHEN value = 1 THEN 1 ELSE 0 END) AS metric_value",
             "avg_p95": "avg(value) AS metric_value, quantile_cont(value, 0.95) AS p95_value"}[chart.agg]
    dims = "".join(f", dims['{x}'] AS {x}" for x in chart.dimensions)
    values = f"SELECT {DAY} AS bucket, metric_name{dims}, {value} FROM latest GROUP BY ALL"
    shown = renamed_sql("column_name", chart.column_names) if "column_name" in chart.dimensions else renamed_sql(
        "metric_name", chart.metrics)
    outs = "coalesce(metric_value, 0) AS metric_value" + (
        ", coalesce(p95_value, 0) AS p95_value" if chart.agg == "avg_p95" else "")
    return (f"WITH {P.latest_sql(sources, ' AND '.join(where))} SELECT bucket, {', '.join(keys)}, {shown} AS friendly_name, "
            f"{outs} FROM ({filled_sql(values, keys, span)})")


def chart_out(name: str) -> str:
    chart = charts.CHARTS[name]
    dims = "".join(f" {x}:s" for x in chart.dimensions)
    p95 = " p95_value:6" if chart.agg == "avg_p95" else ""
    first = CHART_SOURCES[name][0]
    digits = 1 if first == "cumulative" else 4 if first in ("absolute", "signed", "term_end", "maximum") else 6
    return f"bucket:t metric_name:s{dims} friendly_name:s metric_value:{digits}{p95}"


VARIANT_IDS = {"extraction-pass-rate-by-doc-type": " V5", "processing-time-by-doc-type": " V6 A8"}
for _name in charts.CHARTS:
    @register("chart_" + _name.replace("-", "_"), "V1 T1 T2 S9 F8" + VARIANT_IDS.get(_name, ""), chart_out(_name),
              chart_sql(_name))
    def _(spark, d, name=_name):
        sources = CHART_SOURCES[name]
        start, end = P.SOURCES[sources[0]].span
        return charts.gapfill_series(P.store(spark, d, sources), charts.CHARTS[name], start=start, end=end)


def over(sources, body: str, where: str = "true") -> str:
    return f"WITH {P.latest_sql(sources, where)} {body}"


@register("latest_version", "S9 U2", "metric_name:s timestamp:t metric_version:i max_version_for_timestamp:i value:6 series:s",
          over(["coverage"], "SELECT metric_name, timestamp, version AS metric_version, newest AS max_version_for_timestamp, "
               "value, dims['series'] AS series FROM latest"))
def _(spark, d):
    return S.latest_version(P.store(spark, d, ["coverage"])).withColumn("series", S.dimension("series"))


# --- Time-series operators ---


def volume_points(spark, d):
    return S.latest_version(P.store(spark, d, ["volume"]))


HOURLY = "SELECT date_trunc('hour', timestamp) AS bucket, sum(value) AS total FROM latest GROUP BY 1"


@register("hourly_volume_gapfilled", "T1 T2", "bucket:t total:4",
          over(["volume"], f"SELECT bucket, coalesce(total, 0) AS total FROM ({filled_sql(HOURLY, [], P.JANUARY, '1 hour')})"))
def _(spark, d):
    hourly = T.rollup(volume_points(spark, d), width="1 hour")
    filled = T.gapfill(hourly, bucket="bucket", start=P.JANUARY[0], end=P.JANUARY[1], width="1 hour", values=["total"])
    return filled.select("bucket", F.coalesce("total", F.lit(0.0)).alias("total"))


BY_LABEL = "SELECT {day} AS bucket, dims['series'] AS series, avg(value) AS value FROM latest GROUP BY ALL"


def daily_by_label(spark, d, source: str, metric: str):
    return charts.rollup_by_dimensions(P.store(spark, d, [source]), metric, ["series"], how="avg", name="value")


@register("label_f1_carried_forward", "T1 T3", "bucket:t series:s value:6", over(
    ["label_quality"],
    f"""SELECT bucket, series, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY bucket) AS value
FROM ({filled_sql(BY_LABEL.format(day=DAY), ['series'], P.YEARS)})""", "metric_name = 'f1_score'"))
def _(spark, d):
    daily = daily_by_label(spark, d, "label_quality", "f1_score")
    filled = T.gapfill(daily, bucket="bucket", start=P.YEARS[0], end=P.YEARS[1], width="1 day", series=["series"],
                       values=["value"])
    return T.locf(filled, bucket="bucket", value="value", series=["series"])


for _width in ("hour", "day", "week"):
    @register(f"rollup_{_width}", "T4 F1", "bucket:t segment:s total:4", over(
        ["volume"], f"SELECT date_trunc('{_width}', timestamp) AS bucket, dims['segment'] AS segment, "
                    "sum(value) AS total FROM latest GROUP BY ALL"))
    def _(spark, d, width=_width):
        return T.rollup(volume_points(spark, d), width=f"1 {width}", series=[S.dimension("segment").alias("segment")])


@register("hallucination_rate", "T5 J2", "bucket:t hallucination_rate:6", over(["responses", "hallucinations"], f"""
SELECT bucket, CASE WHEN n = 0 THEN 0 ELSE h / n END AS hallucination_rate
FROM (SELECT {DAY} AS bucket, sum(value) AS h FROM latest WHERE metric_name = 'hallucination_count' GROUP BY 1)
JOIN (SELECT {DAY} AS bucket, sum(value) AS n FROM latest WHERE metric_name = 'inference_count' GROUP BY 1) USING (bucket)"""))
def _(spark, d):
    rows = S.latest_version(P.store(spark, d, ["responses", "hallucinations"]))
    return T.derived_rate(rows, numerator="hallucination_count", denominator="inference_count",
                          name="hallucination_rate")


@register("label_f1_trend", "T6 W3 W7 W12", "bucket:t series:s value:6 previous:6 change:6 rolling_avg:6", over(
    ["label_quality"], f"""SELECT *, lag(value) OVER s AS previous, value - previous AS change,
  avg(value) OVER (PARTITION BY series ORDER BY bucket ROWS 6 PRECEDING) AS rolling_avg
FROM ({BY_LABEL.format(day=DAY)}) WINDOW s AS (PARTITION BY series ORDER BY bucket)""", "metric_name = 'f1_score'"))
def _(spark, d):
    return T.trend(daily_by_label(spark, d, "label_quality", "f1_score"), bucket="bucket", value="value",
                   series=["series"])


FIRST, SECOND = ("1996-01-01", "1996-06-30"), ("1996-07-01", "1996-12-31")


def period_sql(a: str, b: str) -> str:
    return "SELECT dims['series'] AS series, " + ", ".join(
        f"avg(value) FILTER (timestamp BETWEEN '{s}' AND '{e}') AS {n}" for n, (s, e) in ((a, FIRST), (b, SECOND))
    ) + " FROM latest GROUP BY 1"


@register("label_f1_period_comparison", "T7", "series:s first_period:6 second_period:6 change:6 percent_change:6", over(
    ["label_quality"], "SELECT *, second_period - first_period AS change, CASE WHEN first_period > 0 THEN "
    f"(second_period / first_period - 1) * 100 END AS percent_change FROM ({period_sql('first_period', 'second_period')})",
    "metric_name = 'f1_score'"))
def _(spark, d):
    rows = S.latest_version(S.select_points(P.store(spark, d, ["label_quality"]), ["f1_score"]))
    return T.compare_periods(rows, series=[S.dimension("series").alias("series")], first=FIRST, second=SECOND)


@register("coverage_baseline_drift", "T8 X18", "series:s baseline_value:6 current_value:6 drift:6 drift_status:s", over(
    ["coverage"], f"""SELECT *, abs(current_value - baseline_value) AS drift, CASE WHEN drift > 0.01 THEN 'SIGNIFICANT DRIFT'
  ELSE 'MODERATE DRIFT' END AS drift_status FROM ({period_sql('baseline_value', 'current_value')})
WHERE abs(current_value - baseline_value) > 0.005"""))
def _(spark, d):
    rows = S.latest_version(P.store(spark, d, ["coverage"]))
    return T.baseline_drift(rows, series=[S.dimension("series").alias("series")], baseline=FIRST, current=SECOND,
                            report_above=0.005, significant_above=0.01)


# --- Chart variants ---

CORE = charts.Chart({
    "core_accuracy_rate": "Core Accuracy (%)", "accurate_predictions_count": "Accurate Count",
    "total_predictions_count": "Total Predictions", "avg_percentage_error": "Avg Error (%)"})
PERCENT = ("core_accuracy_rate", "avg_percentage_error")


@register("chart_core_accuracy_scaled", "V2", "bucket:t metric_name:s friendly_name:s metric_value:6", over(
    ["core_accuracy"], f"""SELECT bucket, metric_name, {renamed_sql('metric_name', CORE.metrics)} AS friendly_name,
  coalesce(m, 0) * CASE WHEN metric_name IN ({quoted(PERCENT)}) THEN 100 ELSE 1 END AS metric_value FROM
  ({filled_sql(f"SELECT {DAY} AS bucket, metric_name, avg(value) AS m FROM latest GROUP BY ALL", ['metric_name'], P.YEARS)})"""))
def _(spark, d):
    return charts.scaled_series(P.store(spark, d, ["core_accuracy"]), CORE, start=P.YEARS[0], end=P.YEARS[1],
                                percent=PERCENT)


def banded_sql(sources, metric: str, cases: str, dims=()) -> str:
    cols = "".join(f", dims['{x}'] AS {x}" for x in dims)
    values = f"SELECT {DAY} AS bucket{cols}, avg(value) AS m FROM latest GROUP BY ALL"
    return over(sources, f"SELECT *, coalesce(m, 0) AS {metric}, CASE {cases} END AS band FROM "
                         f"({filled_sql(values, list(dims), P.JANUARY)})", f"metric_name = '{metric}'")


BANDED = {
    "log_loss": (["log_loss"], "WHEN m < 0.3 THEN 'Excellent' WHEN m < 0.5 THEN 'Good' WHEN m < 0.7 THEN 'Moderate' ELSE 'Poor'", ()),
    "percentage_accuracy": (["accuracy"], "WHEN m >= 90 THEN 'Excellent' WHEN m >= 80 THEN 'Good' WHEN m >= 70 THEN 'Fair' ELSE 'Poor'", ()),
    "drift_score": (["drift_amount", "drift_k"], "WHEN m < 0.1 THEN 'Stable' WHEN m < 0.2 THEN 'Moderate Drift' "
                    "ELSE 'Significant Drift'", ("monitored_column",)),
}
for _metric, (_sources, _cases, _dims) in BANDED.items():
    @register(f"chart_{_metric}_bands", "V3 X18" + (" V7" if _dims else ""),
              "bucket:t " + "".join(f"{x}:s " for x in _dims) + f"{_metric}:6 band:s",
              banded_sql(_sources, _metric, _cases, _dims))
    def _(spark, d, metric=_metric, sources=_sources, dims=_dims):
        return charts.banded_series(P.store(spark, d, sources), metric, start=P.JANUARY[0], end=P.JANUARY[1],
                                    dimensions=list(dims))


WIDE = {
    "log_loss": (["log_loss"], {"log_loss": "avg", "avg_predicted_probability": "avg", "positive_class_count": "sum",
                                "total_predictions": "sum"}, "positive_class_count", "total_predictions"),
    "accuracy": (["accuracy"], {"percentage_accuracy": "avg", "total_predictions_count": "sum",
                                "correct_predictions_count": "sum"}, "correct_predictions_count",
                 "total_predictions_count"),
}
for _name, (_sources, _aggs, _num, _den) in WIDE.items():
    @register(f"chart_{_name}_wide", "V4 A12", "bucket:t " + " ".join(f"{m}:6" for m in _aggs) + " derived_rate:6", over(
        _sources, f"SELECT *, {_num} / nullif({_den}, 0) AS derived_rate FROM ("
        + filled_sql(f"SELECT {DAY} AS bucket, " + ", ".join(
            f"{k}(value) FILTER (metric_name = '{m}') AS {m}" for m, k in _aggs.items())
            + " FROM latest GROUP BY 1", [], P.JANUARY) + ")", f"metric_name IN ({quoted(_aggs)})"))
    def _(spark, d, sources=_sources, aggs=_aggs, num=_num, den=_den):
        wide = charts.wide_metrics(P.store(spark, d, sources), aggs, start=P.JANUARY[0], end=P.JANUARY[1])
        return wide.withColumn("derived_rate", F.col(num) / F.nullif(F.col(den), F.lit(0.0)))


# --- Query patterns ---


@register("pair_rollup", "V19 X17", "bucket:t label_1:s label_2:s total:4", over(
    ["pairs"], f"SELECT {DAY} AS bucket, dims['label_1'] AS label_1, dims['label_2'] AS label_2, sum(value) AS total "
    "FROM latest GROUP BY ALL", "metric_name = 'pred_cooccurrence_count'"))
def _(spark, d):
    return charts.rollup_by_dimensions(P.store(spark, d, ["pairs"]), "pred_cooccurrence_count", ["label_1", "label_2"])


@register("label_filter", "V20 F7", "bucket:t series:s total:6", over(
    ["label_quality"], f"SELECT {DAY} AS bucket, dims['series'] AS series, avg(value) AS total FROM latest GROUP BY ALL",
    "metric_name = 'f1_score' AND dims['series'] IN ('L1', 'L3', 'L5')"))
def _(spark, d):
    return charts.rollup_by_dimensions(P.store(spark, d, ["label_quality"]), "f1_score", ["series"], how="avg",
                                       where=S.dimension("series").isin("L1", "L3", "L5"))


LABEL_F1 = "SELECT dims['series'] AS label, avg(value) AS avg_value FROM latest GROUP BY 1"
IS_F1 = "metric_name = 'f1_score'"


@register("worst_labels", "V21 L2", "label:s avg_value:6",
          over(["label_quality"], f"{LABEL_F1} ORDER BY 2, 1 LIMIT 3", IS_F1))
def _(spark, d):
    return charts.worst_by_dimension(P.store(spark, d, ["label_quality"]), "f1_score", "series", n=3)


@register("label_metrics_side_by_side", "V22 A12 J2", "bucket:t series:s precision:6 recall:6 f1_score:6", over(
    ["label_quality"], f"SELECT {DAY} AS bucket, dims['series'] AS series, " + ", ".join(
        f"avg(value) FILTER (metric_name = '{m}') AS {m}" for m in ("precision", "recall", "f1_score"))
    + " FROM latest GROUP BY ALL"))
def _(spark, d):
    return charts.wide_metrics(P.store(spark, d, ["label_quality"]),
                               {"precision": "avg", "recall": "avg", "f1_score": "avg"}, start=P.YEARS[0],
                               end=P.YEARS[1], dimensions=["series"], fill_gaps=False)


@register("true_positives_across_labels", "V23 A10 A6", "bucket:t total:4 avg_per_label:6 num_labels:i", over(
    ["label_counts"], "SELECT bucket, sum(v) AS total, avg(v) AS avg_per_label, count(DISTINCT label) AS num_labels FROM ("
    f"SELECT {DAY} AS bucket, dims['series'] AS label, sum(value) AS v FROM latest GROUP BY ALL) GROUP BY 1",
    "metric_name = 'tp'"))
def _(spark, d):
    return charts.across_dimensions(P.store(spark, d, ["label_counts"]), "tp", "series")


@register("dimension_cardinality", "V24 A6 X17",
          "metric_name:s unique_series_values:i unique_label_1_values:i unique_label_2_values:i", over(
              ["label_counts", "pairs"], "SELECT metric_name, " + ", ".join(
                  f"count(DISTINCT dims['{x}']) AS unique_{x}_values" for x in ("series", "label_1", "label_2"))
              + " FROM latest GROUP BY 1"))
def _(spark, d):
    return charts.dimension_cardinality(P.store(spark, d, ["label_counts", "pairs"]), ["series", "label_1", "label_2"])


QUANTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


@register("label_f1_percentiles", "V25 A8", " ".join(f"{n}:6" for n in QUANTILES), over(
    ["label_quality"], "SELECT " + ", ".join(f"quantile_cont(avg_value, {q}) AS {n}" for n, q in QUANTILES.items())
    + f" FROM ({LABEL_F1})", IS_F1))
def _(spark, d):
    return charts.percentiles_across(P.store(spark, d, ["label_quality"]), "f1_score", "series", QUANTILES)


@register("label_frequency_and_quality", "V26 X18", "label:s avg_frequency:6 avg_quality:6 label_frequency:s label_quality:s",
          over(["coverage", "label_quality"], """
SELECT *, CASE WHEN avg_frequency < 0.05 THEN 'Rare' WHEN avg_frequency < 0.3 THEN 'Moderate' ELSE 'Common' END AS label_frequency,
  CASE WHEN avg_quality < 0.5 THEN 'Poor' WHEN avg_quality < 0.7 THEN 'Fair' WHEN avg_quality < 0.9 THEN 'Good'
  ELSE 'Excellent' END AS label_quality FROM (
  SELECT dims['series'] AS label, avg(value) FILTER (metric_name = 'coverage_ratio') AS avg_frequency,
    avg(value) FILTER (metric_name = 'f1_score') AS avg_quality FROM latest GROUP BY 1)"""))
def _(spark, d):
    return charts.frequency_and_quality(P.store(spark, d, ["coverage", "label_quality"]), frequency="coverage_ratio",
                                        quality="f1_score", dim="series")


@register("version_comparison", "V27 A3", "version:s avg_value:6 stddev_value:6 min_value:6 max_value:6", over(
    ["core_accuracy_segments"], "SELECT dims['segment'] AS version, avg(value) AS avg_value, stddev_samp(value) "
    "AS stddev_value, min(value) AS min_value, max(value) AS max_value FROM latest GROUP BY 1"))
def _(spark, d):
    return charts.version_comparison(P.store(spark, d, ["core_accuracy_segments"]), "accuracy", "segment")


@register("label_f1_status", "V28 X18", "label:s avg_value:6 status:s", over(
    ["label_quality"], f"SELECT *, CASE WHEN avg_value < 0.5 THEN 'CRITICAL' ELSE 'WARNING' END AS status FROM ({LABEL_F1}) "
    "WHERE avg_value < 0.7", IS_F1))
def _(spark, d):
    return charts.status_list(P.store(spark, d, ["label_quality"]), "f1_score", "series")
