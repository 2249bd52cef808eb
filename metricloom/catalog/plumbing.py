"""Registered queries: sources, sinks, sketches, streams and user-defined metrics."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from metricloom.catalog import points as P
from metricloom.catalog import views
from metricloom.catalog.binary import DAILY, LOSS
from metricloom.catalog.dashboards import over
from metricloom.catalog.registry import register
from metricloom.functions import sketches
from metricloom.functions.timebuckets import between
from metricloom.operators import binary, probability, regression, sketch_checks
from metricloom.plans import store as S
from metricloom.plans.definitions import Binding, DefinitionRegistry, MetricDefinition, rebind, sql_metric
from metricloom.session import scratch_path, written
from metricloom.sources import readers, writers
from metricloom.streaming import metrics as stream_metrics

EVENTS_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
BY_TYPE = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(value) AS total FROM events"


def by_type(df):
    return df.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# --- Sources and sinks: written from the given tables, read back, aggregated ---

TYPE_OUT = "day:d event_type:s n:i total:4"


def dated(spark, d, file_type: str) -> str:
    path = scratch_path(spark, f"events-{file_type}")
    rows = views.events(spark, d)
    writers.write_by_date(rows, path, ts="ts", file_type=file_type)
    return path


@register("dated_parquet_round_trip", "S1 S11", TYPE_OUT, f"{BY_TYPE} GROUP BY ALL")
def _(spark, d):
    path = scratch_path(spark, "dated")
    days = views.events(spark, d).withColumn("folder", F.to_date("ts"))
    days.hint("rebalance", "folder").write.partitionBy("folder").parquet(path)
    rows = readers.read_dated_parquet(spark, path, EVENTS_SCHEMA)
    return by_type(rows.filter(F.col("file_date") == F.to_date("ts")))


@register("json_partitions_round_trip", "S2 S11", TYPE_OUT, f"{BY_TYPE} GROUP BY ALL")
def _(spark, d):
    path = scratch_path(spark, "json")
    rows = views.events(spark, d)
    parts = {"year": F.year("ts"), "month": F.month("ts"), "day": F.dayofmonth("ts")}
    # One JSON array for each file, of at most some thousand rows.
    chunk = F.pmod(F.xxhash64("event_id"), F.lit(16)).alias("chunk")
    arrays = rows.groupBy(*[c.alias(n) for n, c in parts.items()], chunk).agg(
        F.to_json(F.collect_list(F.struct(*[c for c in rows.columns]))).alias("value"))
    arrays.write.partitionBy(*parts, "chunk").text(path)
    schema = EVENTS_SCHEMA + ", year int, month int, day int, chunk int"
    return by_type(readers.read_partitioned_json(spark, path, schema).drop(*parts, "chunk"))


@register("csv_round_trip", "S3 S11 X8", TYPE_OUT, f"{BY_TYPE} GROUP BY ALL")
def _(spark, d):
    path = scratch_path(spark, "csv")
    rows = views.events(spark, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    rows.write.options(header="true", sep="|").csv(path)
    text = readers.read_csv(spark, path, EVENTS_SCHEMA.replace("ts timestamp", "ts string"), sep="|")
    return by_type(readers.parse_timestamps(text, "ts"))


@register("time_window_scan", "S4 S11", TYPE_OUT,
          f"{BY_TYPE} WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY ALL")
def _(spark, d):
    rows = readers.read_window(
        spark, dated(spark, d, "parquet"), "partition_date=%Y-%m-%d", r".*\.parquet", schema=EVENTS_SCHEMA,
        start=datetime(2024, 1, 8), end=datetime(2024, 1, 15),
    )
    return by_type(rows)


@register("inspected_schema_scan", "S5", TYPE_OUT, f"{BY_TYPE} GROUP BY ALL")
def _(spark, d):
    path = scratch_path(spark, "inspected")
    views.events(spark, d).drop("props").write.options(header="true").csv(path)
    schema = readers.inspect_schema(spark, path, file_type="csv")
    return by_type(readers.read_csv(spark, path, schema))


@register("optional_date_filter", "F8 F7", TYPE_OUT,
          f"{BY_TYPE} WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY ALL")
def _(spark, d):
    return by_type(between(between(views.events(spark, d), "ts"), "ts", "2024-01-05", "2024-01-20"))


@register("numeric_store_round_trip", "S7 S9 U2", "metric_name:s timestamp:t metric_version:i value:6 label_1:s",
          over(["coverage", "pairs"], "SELECT metric_name, timestamp, version - 1 AS metric_version, value, "
               "dims['label_1'] AS label_1 FROM latest"))
def _(spark, d):
    path = scratch_path(spark, "numeric-store")
    # Both versions are written from the same points.
    rows = written(P.points(spark, d, ["coverage", "pairs"]), "numeric-points")
    first = rows.withColumn("value", F.col("value") * 0.5)
    S.write_points(first, path, version=S.next_version(spark, path))
    S.append_recomputed(rows.filter(F.dayofmonth("timestamp") != 10), path)
    return S.latest_version(S.read_store(spark, path)).withColumn("label_1", S.dimension("label_1"))


@register("sketch_store_round_trip", "S8 K1 K2 K4 K5 K7", "bucket:t segment:s n:i low:6 high:6",
          "SELECT date_trunc('day', ts) AS bucket, segment, count(*) AS n, min(amount) AS low, max(amount) AS high "
          "FROM inf_binary GROUP BY ALL")
def _(spark, d):
    path = scratch_path(spark, "sketch-store")
    rows = S.sketch_points(views.binary(spark, d), ts="ts", value="amount", metric_name="amount", model_id=P.MODEL,
                           dimensions=["segment"])
    S.write_points(rows, path, version=0)
    kept = S.latest_version(S.read_store(spark, path, sketch=True))
    merged = kept.groupBy(F.date_trunc("day", "timestamp").alias("bucket"), S.dimension("segment").alias("segment")).agg(
        sketches.merge("value").alias("s"))
    return merged.select("bucket", "segment", sketches.count("s").alias("n"), sketches.min_item("s").alias("low"),
                         sketches.max_item("s").alias("high"))


ANSWERS = {"median": 0.5, "p95": 0.95}


def band_sql(values: str, quantiles: dict[str, float]) -> str:
    """The exact ends of each answer's band from ``vs``, the sorted values, and their number ``n``."""
    gap = sketch_checks.allowed()
    return ", ".join(
        f"{values}[CAST(greatest(0, floor({q - gap!r}::DOUBLE * n) - 1) AS BIGINT) + 1] AS {name}_low, "
        f"{values}[CAST(least(n - 1, ceil({q + gap!r}::DOUBLE * n)) AS BIGINT) + 1] AS {name}_high" for name, q in quantiles.items())


@register("sketch_median_by_segment", "K2 K3 K7", "bucket:t segment:s n:i median_low:6 median_high:6 p95_low:6 p95_high:6 "
          "median_held:b p95_held:b",
          f"SELECT bucket, segment, n, {band_sql('vs', ANSWERS)}, TRUE AS median_held, TRUE AS p95_held FROM ("
          "SELECT date_trunc('day', ts) AS bucket, segment, list(amount ORDER BY amount) AS vs, count(*) AS n "
          "FROM inf_binary WHERE amount IS NOT NULL GROUP BY ALL)")
def _(spark, d):
    rows = views.binary(spark, d)
    points = S.sketch_points(rows, ts="ts", value="amount", metric_name="amount", model_id=P.MODEL, dimensions=["segment"])
    merged = points.groupBy(F.date_trunc("day", "timestamp").alias("bucket"), S.dimension("segment").alias("segment")).agg(
        sketches.merge("value").alias("s"))
    daily = rows.select(F.date_trunc("day", "ts").alias("bucket"), "segment", "amount")
    return sketch_checks.held_quantiles(daily, merged, ["bucket", "segment"], "amount", ANSWERS)


SPLITS = [i / 20 for i in range(1, 20)]


@register("sketch_distribution", "K6 K8 X11", "bin:6 n:i exact_count:i held:b",
          "SELECT pos / 20.0 AS bin, (SELECT count(score) FROM inf_binary) AS n, coalesce(c, 0) AS exact_count, TRUE AS held "
          "FROM (SELECT unnest(generate_series(1, 20)) AS pos) LEFT JOIN (SELECT len(list_filter("
          f"[{', '.join(f'{x!r}::DOUBLE' for x in SPLITS)}], lambda x: x < score)) + 1 AS pos, count(*) AS c "
          "FROM inf_binary WHERE score IS NOT NULL GROUP BY 1) USING (pos)")
def _(spark, d):
    rows = views.binary(spark, d)
    points = S.sketch_points(rows, ts="ts", value="score", metric_name="score", model_id=P.MODEL)
    table = sketch_checks.mass_table(rows, points.agg(sketches.merge("value").alias("s")), "score", SPLITS)
    return table.withColumn("bin", (F.col("pos") + 1) / 20.0)


@register("log_loss_on_sample", "L3 L2 X4", "row_id:i score:6 label:i sample_log_loss:6",
          f"SELECT row_id, score, label, {LOSS} AS sample_log_loss FROM inf_binary ORDER BY row_id LIMIT 100")
def _(spark, d):
    loss = probability.sample_log_loss(F.col("label"), F.col("score"))
    return views.binary(spark, d).select("row_id", "score", "label", loss.alias("sample_log_loss")).orderBy(
        "row_id").limit(100)


# --- Streams: the events file as a stream, run to its end, read back from the store ---


def event_stream(spark, d):
    return spark.readStream.schema(EVENTS_SCHEMA.replace("ts timestamp", "ts timestamp_ntz")).option(
        "pathGlobFilter", "events.parquet").parquet(d)


def scored_stream(spark, d):
    score = F.least(F.col("value") / 200.0, F.lit(1.0))
    return event_stream(spark, d).select(
        "ts", score.alias("score"), F.col("event_type").isin("error", "signup").cast("int").alias("label"),
        F.col("event_type").alias("segment"), F.col("value").alias("amount"),
    )


def stored_stream(spark, aggregated, **kwargs):
    path, checkpoint = scratch_path(spark, "stream-store"), scratch_path(spark, "stream-checkpoint")
    query = stream_metrics.start_numeric_stream(aggregated, path, checkpoint, model_id=P.MODEL, **kwargs)
    query.awaitTermination()
    return S.latest_version(S.read_store(spark, path))


for _width, _unit in (("5 minutes", None), ("1 hour", "hour"), ("1 day", "day")):
    _bucket = f"date_trunc('{_unit}', ts)" if _unit else "time_bucket(INTERVAL '5 minutes', ts)"

    @register(f"stream_confusion_{_width.replace(' ', '_')}", "G1 G2 G3", "bucket:t tp:i fp:i tn:i fn:i",
              DAILY.replace("date_trunc('day', ts)", _bucket))
    def _(spark, d, width=_width):
        counts = stream_metrics.confusion_aggregates(label="label", score="score", threshold=0.5)
        aggregated = stream_metrics.windowed(scored_stream(spark, d), ts="ts", aggregates=counts, width=width)
        rows = stored_stream(spark, aggregated, metrics=list(counts))
        return rows.groupBy(F.col("timestamp").alias("bucket")).pivot("metric_name", list(counts)).agg(F.sum("value"))


@register("stream_volume_by_segment_week", "G1 G3 U5", "bucket:t segment:s n:i total:4",
          "SELECT date_trunc('week', ts) AS bucket, segment, count(*) AS n, sum(amount) AS total FROM inf_binary GROUP BY ALL")
def _(spark, d):
    values = {"n": F.count(F.lit(1)), "total": F.sum("amount")}
    aggregated = stream_metrics.windowed(scored_stream(spark, d), ts="ts", aggregates=values, width="1 week",
                                         group_by=["segment"])
    rows = stored_stream(spark, aggregated, metrics=list(values), dimensions=["segment"])
    return rows.groupBy(F.col("timestamp").alias("bucket"), S.dimension("segment").alias("segment")).pivot(
        "metric_name", list(values)).agg(F.sum("value"))


@register("stream_sketches", "G5 K1 S8", "bucket:t segment:s n:i low:6 high:6",
          "SELECT date_trunc('hour', ts) AS bucket, segment, count(*) AS n, min(amount) AS low, max(amount) AS high "
          "FROM inf_binary GROUP BY ALL")
def _(spark, d):
    path, checkpoint = scratch_path(spark, "stream-sketches"), scratch_path(spark, "stream-checkpoint")
    stream_metrics.start_sketch_stream(
        scored_stream(spark, d), path, checkpoint, ts="ts", value="amount", metric_name="amount", model_id=P.MODEL,
        dimensions=["segment"], width="1 hour",
    ).awaitTermination()
    rows = S.latest_version(S.read_store(spark, path, sketch=True))
    return rows.select(F.col("timestamp").alias("bucket"), S.dimension("segment").alias("segment"),
                       sketches.count("value").alias("n"), sketches.min_item("value").alias("low"),
                       sketches.max_item("value").alias("high"))


@register("stream_two_writers", "G1 G3 G4 S7", "bucket:t n:i total:4",
          "SELECT date_trunc('day', ts) AS bucket, count(*) AS n, sum(amount) AS total FROM inf_binary GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "shared-store")
    values = {"n": F.count(F.lit(1)), "total": F.sum("amount")}
    for name, value in values.items():
        aggregated = stream_metrics.windowed(scored_stream(spark, d), ts="ts", aggregates={name: value}, width="1 day")
        stream_metrics.start_numeric_stream(aggregated, path, scratch_path(spark, "stream-checkpoint"), metrics=[name],
                                            model_id=P.MODEL).awaitTermination()
    daily = views.binary(spark, d).groupBy(F.date_trunc("day", "ts").alias("bucket")).agg(values["n"].alias("n"))
    S.append_recomputed(S.to_long(daily, [S.ReportedMetric("n", "n")], model_id=P.MODEL), path)
    return S.latest_version(S.read_store(spark, path)).groupBy(F.col("timestamp").alias("bucket")).pivot(
        "metric_name", list(values)).agg(F.sum("value"))


LATE_CUT, LATENESS = "2024-01-16 00:00:00", "2 hours"


@register("stream_late_rows", "G1 G2 G3", "bucket:t n:i total:4", f"""
WITH split AS (SELECT ts, amount, ts < TIMESTAMP '{LATE_CUT}' AND row_id % 10 <> 0 AS first FROM inf_binary),
mark AS (SELECT max(ts) - INTERVAL '{LATENESS}' AS w FROM split WHERE first)
SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, sum(amount) AS total FROM split, mark
WHERE first OR date_trunc('hour', ts) + INTERVAL '1 hour' > w GROUP BY 1""")
def _(spark, d):
    # Two files, one after the other: the second holds rows of the future, late ones inside the lateness, and later ones, which are dropped.
    source, path, checkpoint = (scratch_path(spark, f"late-{n}") for n in ("rows", "store", "checkpoint"))
    rows = views.binary(spark, d).select("ts", "amount", "row_id")
    first = (F.col("ts") < F.lit(LATE_CUT).cast("timestamp")) & (F.col("row_id") % 10 != 0)
    for part in (first, ~first):
        rows.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        values = {"n": F.count(F.lit(1)), "total": F.sum("amount")}
        aggregated = stream_metrics.windowed(stream, ts="ts", aggregates=values, width="1 hour", lateness=LATENESS)
        stream_metrics.start_numeric_stream(aggregated, path, checkpoint, metrics=list(values), model_id=P.MODEL).awaitTermination()
    return S.latest_version(S.read_store(spark, path)).groupBy(F.col("timestamp").alias("bucket")).pivot(
        "metric_name", list(values)).agg(F.sum("value"))


# --- Reports of two kinds: sketches where quantiles are asked for, numbers beside them ---

ERRORS = MetricDefinition(
    "error_distribution", regression.error_profile, ("ts", "prediction", "actual"),
    [S.ReportedMetric(e, e, timestamp="ts", kind="sketch") for e in ("absolute_error", "forecast_error", "absolute_percentage_error")]
    + [S.ReportedMetric("error_count", "absolute_error", timestamp="ts", aggregate="count"),
       S.ReportedMetric("mean_absolute_error", "absolute_error", timestamp="ts", aggregate="avg")], {"bucket": "1 day"},
)
BAND_OUT = "n:i median_low:4 median_high:4 p95_low:4 p95_high:4 median_held:b p95_held:b"


def bands_of(values: str, rows: str) -> str:
    return (f"SELECT bucket, metric_name, n, {band_sql('vs', ANSWERS)}, TRUE AS median_held, TRUE AS p95_held FROM (SELECT bucket, metric_name, "
            f"list({values} ORDER BY {values}) AS vs, count(*) AS n FROM ({rows}) WHERE {values} IS NOT NULL GROUP BY ALL)")


ERROR_ROWS = ("SELECT date_trunc('day', ts) AS bucket, unnest(['absolute_error', 'forecast_error', 'absolute_percentage_error']) AS metric_name, "
              "unnest([abs(prediction - actual), prediction - actual, CASE WHEN actual <> 0 THEN abs((prediction - actual) / actual) * 100 END]) AS v "
              "FROM inf_regression")


@register("error_sketches_from_store", "R4 R5 R6 S8 K2 K3 U2", "bucket:t metric_name:s " + BAND_OUT, bands_of("v", ERROR_ROWS))
def _(spark, d):
    rows, paths = views.regression(spark, d), {k: scratch_path(spark, f"error-{k}") for k in ("numeric", "sketch")}
    binding = Binding(ERRORS, {"ts": "ts", "prediction": "prediction", "actual": "actual"})
    S.write_reports(binding.stored_rows(rows, model_id=P.MODEL, bucket="1 day"), paths)
    kept = S.latest_version(S.read_store(spark, paths["sketch"], sketch=True))
    merged = kept.groupBy(F.col("timestamp").alias("bucket"), "metric_name").agg(sketches.merge("value").alias("s"))
    names = ("absolute_error", "forecast_error", "absolute_percentage_error")
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("metric_name"), F.col(e).alias("v")) for e in names])).alias("r")
    errors = binding.frame(rows).select(F.col("ts").alias("bucket"), each).select("bucket", "r.*")
    return sketch_checks.held_quantiles(errors, merged, ["bucket", "metric_name"], "v", ANSWERS)


@register("error_numbers_from_store", "R4 S7 U2", "bucket:t error_count:i mean_absolute_error:4",
          "SELECT date_trunc('day', ts) AS bucket, count(prediction - actual) AS error_count, avg(abs(prediction - actual)) AS mean_absolute_error "
          "FROM inf_regression GROUP BY 1")
def _(spark, d):
    rows, paths = views.regression(spark, d), {k: scratch_path(spark, f"error-{k}") for k in ("numeric", "sketch")}
    binding = Binding(ERRORS, {"ts": "ts", "prediction": "prediction", "actual": "actual"})
    S.write_reports(binding.stored_rows(rows, model_id=P.MODEL, bucket="1 day"), paths)
    return S.latest_version(S.read_store(spark, paths["numeric"])).groupBy(F.col("timestamp").alias("bucket")).pivot(
        "metric_name", ["error_count", "mean_absolute_error"]).agg(F.sum("value"))


@register("stream_reports_of_both_kinds", "G1 G5 R4 S7 S8", "bucket:t segment:s counted:i " + BAND_OUT,
          f"SELECT *, n AS counted FROM ({bands_of('v', 'SELECT ts::DATE AS bucket, segment AS metric_name, amount AS v FROM inf_binary')}) "
          "t(bucket, segment, n, median_low, median_high, p95_low, p95_high, median_held, p95_held)")
def _(spark, d):
    paths = {k: scratch_path(spark, f"reports-{k}") for k in ("numeric", "sketch")}
    reports = [S.ReportedMetric("amount", "amount", dimensions=("segment",), kind="sketch"),
               S.ReportedMetric("amount_count", "amount", dimensions=("segment",), aggregate="count")]
    stream_metrics.start_report_stream(scored_stream(spark, d), paths, scratch_path(spark, "reports-checkpoint"), ts="ts", reports=reports,
                                       model_id=P.MODEL, width="1 day").awaitTermination()
    keys = [F.col("timestamp").alias("bucket"), S.dimension("segment").alias("segment")]
    merged = S.latest_version(S.read_store(spark, paths["sketch"], sketch=True)).groupBy(*keys).agg(sketches.merge("value").alias("s"))
    counted = S.latest_version(S.read_store(spark, paths["numeric"])).groupBy(*keys).agg(F.sum("value").alias("counted"))
    rows = views.binary(spark, d).select(F.date_trunc("day", "ts").alias("bucket"), "segment", "amount")
    return sketch_checks.held_quantiles(rows, merged, ["bucket", "segment"], "amount", ANSWERS).join(counted, ["bucket", "segment"], "left")


@register("lookback_recompute", "G4", "bucket:t tp:i fp:i tn:i fn:i metric_version:i",
          "SELECT *, CASE WHEN bucket >= TIMESTAMP '2024-01-30 22:00:00' THEN 1 ELSE 0 END AS metric_version FROM ("
          + DAILY.replace("date_trunc('day', ts)", "date_trunc('hour', ts)") + ")")
def _(spark, d):
    path = scratch_path(spark, "recomputed")
    rows, names = views.binary(spark, d), ("tp", "fp", "tn", "fn")
    reports = [S.ReportedMetric(n, n) for n in names]
    args = dict(ts="ts", label="label", score="score", threshold=0.5, bucket="1 hour")
    S.write_points(S.to_long(binary.confusion_counts(rows, **args), reports, model_id=P.MODEL), path, version=0)
    recent = S.recent_rows(rows, ts="ts", as_of="2024-01-31 00:00:00", lookback_seconds=7200, width="1 hour")
    S.append_recomputed(S.to_long(binary.confusion_counts(recent, **args), reports, model_id=P.MODEL), path)
    kept = S.latest_version(S.read_store(spark, path))
    return kept.groupBy(F.col("timestamp").alias("bucket"), "metric_version").pivot("metric_name", list(names)).agg(
        F.sum("value"))


# --- User-defined metrics ---

CATEGORY_COUNT = """
SELECT date_trunc('DAY', IDENTIFIER(:timestamp_col)) AS ts, :category AS categorical_value, count(*) AS count
FROM {dataset} WHERE IDENTIFIER(:categorical_column) = :category AND IDENTIFIER(:timestamp_col) IS NOT NULL
GROUP BY 1, 2"""


@register("sql_metric_category_count", "U1 F6 F9", "ts:t categorical_value:s count:i",
          "SELECT date_trunc('day', ts) AS ts, 'click' AS categorical_value, count(*) AS count FROM inf_binary "
          "WHERE segment = 'click' GROUP BY 1")
def _(spark, d):
    return sql_metric(spark, CATEGORY_COUNT, datasets={"dataset": views.binary(spark, d)},
                      columns={"timestamp_col": "ts", "categorical_column": "segment"}, literals={"category": "click"})


PROFILE = MetricDefinition(
    "negative_predictive_value", binary.negative_predictive_value, ("ts", "label", "score"),
    [S.ReportedMetric("npv", "npv"), S.ReportedMetric("specificity", "specificity")], {"threshold": 0.5}, version=2,
)


@register("rebound_metric_by_segment", "U2 U3 U4 U5", "timestamp:t metric_name:s value:6 segment:s",
          "SELECT bucket AS timestamp, unnest(['npv', 'specificity']) AS metric_name, "
          "unnest([tn / nullif(tn + fn, 0), tn / nullif(tn + fp, 0)]) AS value, segment FROM ("
          + DAILY.replace("AS bucket", "AS bucket, segment") + ")")
def _(spark, d):
    rows = views.binary(spark, d)
    first = Binding(PROFILE, {"ts": "ts", "label": "label", "score": "score"}, segmentation=("segment",))
    renamed = rows.withColumnsRenamed({"score": "fraud_score", "label": "is_fraud"})
    again = rebind(first, renamed.schema, {"score": "fraud_score", "label": "is_fraud"})
    return again.points(renamed, model_id=P.MODEL).withColumn("segment", S.dimension("segment"))


REGISTRY = DefinitionRegistry()
REGISTRY.register(replace(PROFILE, literal_args={"threshold": 0.7}, version=1))
REGISTRY.register(PROFILE)


@register("pinned_definition_versions", "U1 U4", "version:i bucket:t npv:6", " UNION ALL ".join(
    f"SELECT {v} AS version, bucket, tn / nullif(tn + fn, 0) AS npv FROM ({DAILY.replace('0.5', t)})" for v, t in ((1, "0.7"), (2, "0.5"), (2, "0.5"))))
def _(spark, d):
    rows, columns = views.binary(spark, d), {"ts": "ts", "label": "label", "score": "score"}
    out = None
    # The first consumer pins version 1, the second version 2, the third takes the newest.
    for pin in (1, 2, None):
        definition = REGISTRY.get("negative_predictive_value", pin)
        frame = Binding(definition, columns).frame(rows).select(F.lit(definition.version).alias("version"), "bucket", "npv")
        out = frame if out is None else out.unionByName(frame)
    return out
