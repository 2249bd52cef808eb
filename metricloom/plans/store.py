"""The long metric store: one row per (model, metric, timestamp, version, dimensions).

Layout: ``<path>/run_id=NNNNNNNNNNNN-R/metric_version=N/metric_name=M/year=Y``, sorted by time within a
file. A run owns its folder and overwrites only that, so a retried run or replayed
micro-batch leaves no duplicates and writers that choose the same version number keep
each other's points. Filters on metric and year prune
folders and the time filter prunes row groups. Points are already aggregated, so
folders by day would hold a handful of rows each.

Every run first appends a record to the store's commit log (``commits.py``). Its place there, which no two runs
share, begins the folder's name. Of points with equal versions those of the later record are the newer ones, and a
version that nobody has chosen comes from the log, so neither depends on a clock or a random id. ``compact`` rewrites what is
still the newest and deletes the folders of earlier runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions import sketches
from metricloom.functions.timebuckets import bucket_start
from metricloom.plans import commits
from metricloom.session import written

POINT_KEY = ("model_id", "metric_name", "timestamp")
NUMERIC_SCHEMA = (
    "model_id string, timestamp timestamp, value double, dimensions map<string,string>, "
    "run_id string, metric_version int, metric_name string, year int"
)
SKETCH_SCHEMA = NUMERIC_SCHEMA.replace("value double", "value binary")


@dataclass(frozen=True)
class ReportedMetric:
    """How one column of a metric frame becomes a time series.

    A frame of finished values needs no ``aggregate``. From a frame of single rows a report is made by ``aggregate``
    (``count``, ``sum``, ``avg``, ``min`` or ``max`` of the column), or, with the kind ``sketch``, as one mergeable sketch of the column for each
    bucket: a number for what can be added up, a sketch where quantiles will be asked for.
    """

    name: str
    value: str
    timestamp: str = "bucket"
    dimensions: Sequence[str] = field(default_factory=tuple)
    kind: str = "numeric"
    description: str = ""
    aggregate: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("numeric", "sketch") or self.aggregate not in (None, *AGGREGATES):
            raise ValueError(f"not a report: {self}")
        if self.kind == "sketch" and self.aggregate is not None:
            raise ValueError(f"a sketch has no other aggregate: {self}")

    def column(self) -> Column:
        """The aggregate over single rows."""
        if self.kind == "sketch":
            return sketches.build(self.value)
        if self.aggregate is None:
            raise ValueError(f"{self.name} is reported from finished values")
        return AGGREGATES[self.aggregate](F.col(self.value))


AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def dimension_map(columns: Mapping[str, Column | str]) -> Column:
    if not columns:
        return F.create_map().cast("map<string,string>")
    entries = []
    for name, c in columns.items():
        entries += [F.lit(name), (F.col(c) if isinstance(c, str) else c).cast("string")]
    return F.create_map(*entries)


def to_long(df: DataFrame, reports: Iterable[ReportedMetric], *, model_id: str) -> DataFrame:
    """Unpivot a wide metric frame to store rows in one pass over it."""
    rows = [
        F.struct(
            F.lit(r.name).alias("metric_name"),
            F.col(r.timestamp).cast("timestamp").alias("timestamp"),
            F.col(r.value).cast("double").alias("value"),
            dimension_map({d: d for d in r.dimensions}).alias("dimensions"),
        )
        for r in reports
    ]
    return df.select(F.explode(F.array(*rows)).alias("_r")).select(F.lit(model_id).alias("model_id"), "_r.*")


def report_rows(rows: DataFrame, reports: Sequence[ReportedMetric], *, model_id: str, bucket: str = "5 minutes") -> dict[str, DataFrame]:
    """Store rows of each kind, ``numeric`` and ``sketch``, from one pass over single rows.

    All reports share their timestamp column and dimensions. The buckets are written once and both kinds read them, so
    that a number and a sketch of the same bucket are of the same rows. A sketch of a bucket without values is left out.
    """
    if len({(r.timestamp, tuple(r.dimensions)) for r in reports}) != 1:
        raise ValueError("reports of one pass share their timestamp and their dimensions")
    dims = tuple(reports[0].dimensions)
    at = bucket_start(reports[0].timestamp, bucket).alias("_at")
    kept = rows.filter(F.col(reports[0].timestamp).isNotNull())
    built = kept.groupBy(at, *dims).agg(*[r.column().alias(f"_v{i}") for i, r in enumerate(reports)])
    return from_buckets(written(built, "reported-buckets"), reports, model_id=model_id, timestamp="_at",
                        values=[f"_v{i}" for i in range(len(reports))])


def from_buckets(built: DataFrame, reports: Sequence[ReportedMetric], *, model_id: str, timestamp: str,
                 values: Sequence[str]) -> dict[str, DataFrame]:
    """The store rows of each kind from one row per bucket that holds every report's value."""
    out = {}
    for kind, value_type in (("numeric", "double"), ("sketch", "binary")):
        entries = [F.struct(F.lit(r.name).alias("metric_name"), F.col(timestamp).cast("timestamp").alias("timestamp"),
                            F.col(v).cast(value_type).alias("value"), dimension_map({d: d for d in r.dimensions}).alias("dimensions"))
                   for r, v in zip(reports, values, strict=True) if r.kind == kind]
        if entries:
            long = built.select(F.explode(F.array(*entries)).alias("_r")).select(F.lit(model_id).alias("model_id"), "_r.*")
            out[kind] = long.filter(sketches.count("value") > 0) if kind == "sketch" else long
    return out


def write_reports(rows: Mapping[str, DataFrame], paths: Mapping[str, str], *, run_id: str | None = None) -> None:
    """Write the rows of each kind to that kind's store, as its next version."""
    for kind, points in rows.items():
        write_points(points, paths[kind], run_id=run_id)


def sketch_points(df: DataFrame, *, ts: str, value: str, metric_name: str, model_id: str,
                  dimensions: Sequence[str] = (), bucket: str = "5 minutes") -> DataFrame:
    """Row-level values to one mergeable sketch per bucket and dimension values."""
    kept = df.filter(F.col(ts).isNotNull() & F.col(value).isNotNull())
    built = kept.groupBy(bucket_start(ts, bucket).alias("timestamp"), *dimensions).agg(sketches.build(value).alias("value"))
    return built.select(
        F.lit(model_id).alias("model_id"), F.lit(metric_name).alias("metric_name"), "timestamp", "value",
        dimension_map({d: d for d in dimensions}).alias("dimensions"),
    )


def write_points(points: DataFrame, path: str, *, version: int | None = None, run_id: str | None = None) -> int:
    """Write one run's rows as one version, in place of what the same run wrote before; returns the version.

    Without ``run_id`` the run gets a new one, without ``version`` the next one that no other run has. A run that is
    repeated keeps its record and with it the version and its place among equal versions.
    """
    record = commits.reserve(points.sparkSession, path, run_id or uuid.uuid4().hex, version)
    _write(points.withColumn("metric_version", F.lit(record.version)), path, record)
    return record.version


def _write(points: DataFrame, path: str, record: commits.Record) -> None:
    """Rebalancing splits a large metric-year over several files."""
    (
        points.withColumn("year", F.year("timestamp"))
        .hint("rebalance", "metric_name", "year")
        .sortWithinPartitions("metric_name", "year", "timestamp")
        .write.mode("overwrite")
        .partitionBy("metric_version", "metric_name", "year")
        .parquet(f"{path.rstrip('/')}/run_id={record.folder}")
    )


def read_store(spark: SparkSession, path: str, *, sketch: bool = False) -> DataFrame:
    return spark.read.schema(SKETCH_SCHEMA if sketch else NUMERIC_SCHEMA).parquet(path)


def next_version(spark: SparkSession, path: str) -> int:
    """One more than the newest version in the commit log; a writer that goes by it may still meet another one there."""
    return commits.newest_version(spark, path) + 1


def compact(spark: SparkSession, path: str, *, sketch: bool = False) -> int:
    """Rewrite the newest points of all runs so far as one run and delete the folders of those runs; returns how many went.

    Points keep their versions. Runs that begin meanwhile come later in the log and stay. Until the deletion both
    copies are there, and the rewritten one counts as it is the later of the two. Readers that listed
    the store before it must be done: call it when none is open.
    """
    record = commits.reserve(spark, path, f"compact-{uuid.uuid4().hex}", None)
    before = [f for f in commits.run_folders(spark, path) if f < record.folder]
    if not before:
        return 0
    points = read_store(spark, path, sketch=sketch).filter(F.col("run_id") < record.folder)
    _write(latest_version(points).drop("run_id", "year", "max_version_for_timestamp"), path, record)
    commits.delete_runs(spark, path, before)
    return len(before)


def select_points(store: DataFrame, names: Sequence[str] | None = None, *, start=None, end=None) -> DataFrame:
    """Metric and time filters, early, so that folders are pruned."""
    if names is not None:
        store = store.filter(F.col("metric_name").isin(*names))
    if start is not None and end is not None:
        low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
        store = store.filter(F.col("timestamp").between(low, high))
        if "year" in store.columns:
            store = store.filter(F.col("year").between(F.year(low), F.year(high)))
    return store


def latest_version(store: DataFrame) -> DataFrame:
    """All rows of the newest version of each (model, metric, timestamp), whatever their dimensions.

    Of equal versions the run that comes later in the commit log counts: its place begins the run id.

    The newest versions come from a partial aggregation and are joined back;
    a window would shuffle every row and hold one key's rows in one task.
    """
    run = F.col("run_id") if "run_id" in store.columns else F.lit("")
    newest = store.groupBy(*POINT_KEY).agg(F.max(F.struct("metric_version", run.alias("run"))).alias("_newest"))
    kept = store.join(newest, list(POINT_KEY)).filter(
        (F.col("metric_version") == F.col("_newest.metric_version")) & (run == F.col("_newest.run")))
    return kept.withColumn("max_version_for_timestamp", F.col("_newest.metric_version")).drop("_newest")


def dimension(name: str) -> Column:
    return F.col("dimensions")[name]


def has_dimension(name: str) -> Column:
    return F.map_contains_key("dimensions", name)


def recent_rows(df: DataFrame, *, ts: str, as_of, lookback_seconds: int, width: str) -> DataFrame:
    """Inference rows of every bucket the window (as_of - lookback, as_of] touches, whole buckets only."""
    now = F.lit(as_of).cast("timestamp")
    first = bucket_start(F.timestamp_seconds(F.unix_seconds(now) - lookback_seconds), width)
    return df.filter((F.col(ts) >= first) & (F.col(ts) <= now))


def append_recomputed(points: DataFrame, path: str, *, run_id: str | None = None) -> int:
    """Write recomputed points as the next version; returns that version."""
    return write_points(points, path, run_id=run_id)


def with_unchanged_dimensions(points: DataFrame, path: str, *, run_id: str, names: Sequence[str],
                              sketch: bool = False) -> DataFrame:
    """Add the stored rows of the same time points whose dimensions ``points`` does not hold.

    A version stands for the whole time point, so a run that only changed some
    dimension values has to carry the others forward. Rows that the same run wrote in an
    earlier attempt do not count. Only the named metrics between the first and the last
    time point are read.
    """
    try:
        stored = read_store(points.sparkSession, path, sketch=sketch)
    except AnalysisException:
        return points
    first, last = points.agg(F.min("timestamp"), F.max("timestamp")).first()
    if first is None:
        return points
    same = F.to_json("dimensions").alias("_dims")
    touched = points.select(*POINT_KEY).distinct()
    before = select_points(stored, names, start=first, end=last).filter(~F.col("run_id").endswith(f"-{run_id}"))
    older = latest_version(before.join(touched, list(POINT_KEY), "left_semi")).select(*points.columns, same)
    changed = points.select(*POINT_KEY, same).distinct()
    kept = older.join(changed, [*POINT_KEY, "_dims"], "left_anti").drop("_dims")
    return points.unionByName(kept)
