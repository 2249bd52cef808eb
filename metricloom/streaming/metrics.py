"""Windowed counts, sums and sketches on a stream, written as versions of the metric store.

Only mergeable values are streamed. Rates, ranks, percentiles and totals over the
whole result are derived from the stored counts in batch.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from metricloom.functions import sketches
from metricloom.functions.timebuckets import window_args
from metricloom.plans.store import ReportedMetric, dimension_map, from_buckets, to_long, with_unchanged_dimensions, write_points

LATENESS = "2 hours"


def windowed(stream: DataFrame, *, ts: str, aggregates: Mapping[str, Column], width: str = "5 minutes",
             group_by: Sequence[str] = (), lateness: str = LATENESS) -> DataFrame:
    """Tumbling aggregation; rows within ``lateness`` correct their bucket, later ones are dropped."""
    size, slide, offset = window_args(width)
    return (
        stream.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, lateness)
        .groupBy(F.window(ts, size, slide, offset).alias("_w"), *group_by)
        .agg(*[c.alias(name) for name, c in aggregates.items()])
        .select(F.col("_w.start").alias("bucket"), *group_by, *aggregates)
    )


def confusion_aggregates(*, label: str, score: str, threshold: float) -> dict[str, Column]:
    positive, negative = F.col(label) == 1, F.col(label) == 0
    hit, miss = F.col(score) >= threshold, F.col(score) < threshold
    return {
        "tp": F.count_if(positive & hit),
        "fp": F.count_if(negative & hit),
        "tn": F.count_if(negative & miss),
        "fn": F.count_if(positive & miss),
    }


def start_numeric_stream(aggregated: DataFrame, path: str, checkpoint: str, *, metrics: Sequence[str],
                         model_id: str, dimensions: Sequence[str] = (), trigger: Mapping | None = None) -> StreamingQuery:
    """Append changed buckets as a new version per micro-batch; a replayed batch overwrites its own run."""
    reports = [ReportedMetric(m, m, dimensions=tuple(dimensions)) for m in metrics]

    def sink(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{query_id(batch.sparkSession, checkpoint)}-{batch_id}"
        _write_version(to_long(batch, reports, model_id=model_id), path, run_id, list(metrics), bool(dimensions))

    return _start(aggregated, sink, checkpoint, trigger)


def start_sketch_stream(stream: DataFrame, path: str, checkpoint: str, *, ts: str, value: str, metric_name: str,
                        model_id: str, dimensions: Sequence[str] = (), width: str = "5 minutes",
                        trigger: Mapping | None = None) -> StreamingQuery:
    built = windowed(stream.filter(F.col(value).isNotNull()), ts=ts, aggregates={"value": sketches.build(value)},
                     width=width, group_by=dimensions)

    def sink(batch: DataFrame, batch_id: int) -> None:
        points = batch.select(
            F.lit(model_id).alias("model_id"), F.lit(metric_name).alias("metric_name"),
            F.col("bucket").alias("timestamp"), "value",
            dimension_map({d: d for d in dimensions}).alias("dimensions"),
        )
        run_id = f"{query_id(batch.sparkSession, checkpoint)}-{batch_id}"
        _write_version(points, path, run_id, [metric_name], bool(dimensions), sketch=True)

    return _start(built, sink, checkpoint, trigger)


def start_report_stream(stream: DataFrame, paths: Mapping[str, str], checkpoint: str, *, ts: str, reports: Sequence[ReportedMetric],
                        model_id: str, width: str = "5 minutes", lateness: str = LATENESS, trigger: Mapping | None = None) -> StreamingQuery:
    """Reports of both kinds from one stream of single rows, each kind to its own store (``paths``)."""
    dims = list(reports[0].dimensions)
    if any(list(r.dimensions) != dims for r in reports):
        raise ValueError("reports of one stream share their dimensions")
    built = windowed(stream, ts=ts, aggregates={f"_v{i}": r.column() for i, r in enumerate(reports)}, width=width, group_by=dims, lateness=lateness)

    def sink(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{query_id(batch.sparkSession, checkpoint)}-{batch_id}"
        batch = batch.persist()
        try:
            rows = from_buckets(batch, reports, model_id=model_id, timestamp="bucket", values=[f"_v{i}" for i in range(len(reports))])
            for kind, points in rows.items():
                _write_version(points, paths[kind], run_id, [r.name for r in reports if r.kind == kind], bool(dims), sketch=kind == "sketch")
        finally:
            batch.unpersist()

    return _start(built, sink, checkpoint, trigger)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of this checkpoint; another checkpoint has another id."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def _write_version(points: DataFrame, path: str, run_id: str, names: Sequence[str], has_dimensions: bool, *,
                   sketch: bool = False) -> None:
    """One micro-batch as the store's next version; with dimensions the unchanged ones are carried forward."""
    if not has_dimensions:
        write_points(points, path, run_id=run_id)
        return
    # Used several times below; without this every use would run the stateful plan again.
    points = points.persist()
    try:
        write_points(with_unchanged_dimensions(points, path, run_id=run_id, names=names, sketch=sketch), path, run_id=run_id)
    finally:
        points.unpersist()


def _start(df: DataFrame, sink, checkpoint: str, trigger: Mapping | None) -> StreamingQuery:
    return (
        df.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(sink)
        .start()
    )
