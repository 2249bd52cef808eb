"""Readers: dated folders, Hive-partitioned JSON, CSV, time-window locators, warehouses."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

Schema = StructType | str

# strftime tokens from fine to coarse; the finest one present sets the step between paths.
TOKEN_STEPS = (("%M", timedelta(minutes=1)), ("%H", timedelta(hours=1)), ("%d", timedelta(days=1)),
               ("%m", timedelta(days=1)), ("%Y", timedelta(days=1)))
LOCAL_TYPES = ("parquet", "json", "csv", "orc")


def read_dated_parquet(spark: SparkSession, root: str, schema: Schema, *, date_column: str = "file_date",
                       nanosecond_columns: Sequence[str] = ()) -> DataFrame:
    """``<root>/YYYY-MM-DD/data-YYYY-MM-DD.parquet``; the date is taken from the path.

    Spark has no nanosecond type: such columns are read as whole numbers and cut to microseconds.
    """
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    stored = StructType([
        StructField(f.name, LongType()) if f.name in nanosecond_columns else f for f in wanted.fields
    ])
    df = spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(root)
    df = _with_path_date(df, date_column)
    cut = {c: F.timestamp_micros(F.expr(f"`{c}` div 1000")) for c in nanosecond_columns}
    return df.withColumns(cut) if cut else df


def _with_path_date(df: DataFrame, name: str) -> DataFrame:
    found = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})/[^/]*$", 1)
    return df.select("*", F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd").alias(name))


def read_partitioned_json(spark: SparkSession, root: str, schema: Schema) -> DataFrame:
    """Hive folders (year=/month=/day=) of files holding one JSON array each."""
    return spark.read.schema(schema).option("multiLine", "true").json(root)


def read_csv(spark: SparkSession, root: str, schema: Schema, *, sep: str = ",", header: bool = True,
             quote: str = '"', date_column: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).options(sep=sep, header=str(header).lower(), quote=quote)
    if date_column is None:
        return reader.csv(root)
    return _with_path_date(reader.option("recursiveFileLookup", "true").csv(root), date_column)


def expand_prefix(prefix: str, start: datetime, end: datetime, zone: str = "UTC") -> list[str]:
    """Every path of a strftime prefix that the window [start, end) touches, each once."""
    step = next((s for token, s in TOKEN_STEPS if token in prefix), None)
    if step is None:
        return [prefix]
    local = ZoneInfo(zone)

    def localise(moment: datetime) -> datetime:
        moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
        return moment.astimezone(local)

    at, stop = localise(start), localise(end)
    if step >= timedelta(days=1):
        at = at.replace(hour=0, minute=0, second=0, microsecond=0)
    elif step >= timedelta(hours=1):
        at = at.replace(minute=0, second=0, microsecond=0)
    else:
        at = at.replace(second=0, microsecond=0)
    paths: dict[str, None] = {}
    while at < stop:
        paths[at.strftime(prefix)] = None
        at += step
    return list(paths)


def read_window(spark: SparkSession, root: str, prefix: str, suffix: str, *, start: datetime, end: datetime,
                schema: Schema, file_type: str = "parquet", zone: str = "UTC",
                options: Mapping[str, str] | None = None) -> DataFrame:
    """Only the folders of the time window, and in them only files matching the suffix pattern.

    Folders that do not exist are skipped; a window without data gives no rows.
    """
    if file_type not in LOCAL_TYPES:
        raise ValueError(f"file type must be one of {LOCAL_TYPES}")
    fs_paths = existing(spark, root, prefix, expand_prefix(prefix, start, end, zone))
    if not fs_paths:
        return spark.createDataFrame([], schema)
    opts = {"multiLine": "true"} if file_type == "json" else {"header": "true"} if file_type == "csv" else {}
    opts = {**opts, "recursiveFileLookup": "true", **(options or {})}
    df = spark.read.schema(schema).options(**opts).format(file_type).load([escaped(p) for p in fs_paths])
    return df.filter(F.col("_metadata.file_name").rlike(f"^(?:{suffix})$"))


def escaped(path: str) -> str:
    """The path as a glob that matches it alone."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def prefix_glob(prefix: str, folders: Sequence[str]) -> str:
    """One glob that matches all ``folders``: whole folder names that they share stay, time fields become wildcards."""
    shared = os.path.commonprefix([f.split("/") for f in folders])

    def field(token: str) -> str:
        if token == "%%":
            return "%"
        return "[0-9]" * {"%Y": 4, "%j": 3}.get(token, 2) if token in ("%Y", "%j", "%m", "%d", "%H", "%M", "%S", "%y") else "*"

    open_ = ["".join(field(x) if x.startswith("%") else escaped(x) for x in re.split(r"(%.)", part)) for part in prefix.split("/")[len(shared):]]
    return "/".join([*map(escaped, shared), *open_])


def existing(spark: SparkSession, root: str, prefix: str, folders: Sequence[str]) -> list[str]:
    """Those of the expanded folders that exist, in their order, from one listing below what they have in common."""
    if not folders:
        return []
    root = root.rstrip("/")
    found = list_folders(spark, f"{escaped(root)}/{prefix_glob(prefix, folders)}")
    # Listed paths carry the scheme, and the root may do without it: they are compared below the root.
    depth = prefix.rstrip("/").count("/") + 1
    there = {"/".join(p.rstrip("/").split("/")[-depth:]) for p in found}
    return [f"{root}/{f}" for f in folders if f.rstrip("/") in there]


def list_folders(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob matches, listed by the file system and handed over in one piece."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(pattern)
    found = jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPath(target.getFileSystem(spark._jsc.hadoopConfiguration()), target)
    joined = found.mkString("\n")
    return joined.split("\n") if joined else []


def inspect_schema(spark: SparkSession, path: str, *, file_type: str = "parquet", sampling: float = 0.1,
                   options: Mapping[str, str] | None = None) -> StructType:
    """Column types inferred from a sample, to be edited and then declared."""
    reader = spark.read.options(**(options or {})).format(file_type)
    if file_type in ("json", "csv"):
        reader = reader.option("samplingRatio", str(sampling))
    if file_type == "csv":
        reader = reader.option("inferSchema", "true").option("header", "true")
    return reader.load(path).schema


def tagged(schema: StructType, tags: Mapping[str, list[str]]) -> StructType:
    """Column tags as field metadata; they are hints and change no result."""
    out = StructType()
    for f in schema.fields:
        out.add(f.name, f.dataType, f.nullable, {**f.metadata, "tags": tags[f.name]} if f.name in tags else f.metadata)
    return out


def columns_with_tag(schema: StructType, tag: str) -> list[str]:
    return [f.name for f in schema.fields if tag in f.metadata.get("tags", [])]


# Location schemes of the supported object stores.
STORE_SCHEMES = {"s3": "s3a", "gcs": "gs"}


def object_store_uri(kind: str, bucket: str, path: str = "") -> str:
    return f"{STORE_SCHEMES[kind]}://{bucket}/{path.lstrip('/')}".rstrip("/")


def warehouse_options(kind: str, **fields) -> tuple[str, dict[str, str]]:
    """(format, options) for a warehouse read; drivers and connectors come with the cluster."""
    if kind == "jdbc":
        host, port, database = fields["host"], fields.get("port"), fields["database"]
        address = f"{host}:{port}" if port else host
        options = {"url": f"jdbc:{fields.get('protocol', 'postgresql')}://{address}/{database}"}
        options |= {k: str(fields[f]) for k, f in (("user", "username"), ("password", "password"),
                                                   ("driver", "driver"), ("dbtable", "table")) if f in fields}
        # Without bounds a JDBC read is one task; with them it is split.
        options |= {k: str(fields[k]) for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
                    if k in fields}
        return "jdbc", options
    if kind == "snowflake":
        names = {"account_url": "sfURL", "database": "sfDatabase", "schema": "sfSchema", "warehouse": "sfWarehouse",
                 "username": "sfUser", "password": "sfPassword", "table": "dbtable"}
        return "snowflake", {names[k]: str(v) for k, v in fields.items() if k in names}
    if kind == "bigquery":
        names = {"project_id": "parentProject", "table": "table", "credentials": "credentials"}
        return "bigquery", {names[k]: str(v) for k, v in fields.items() if k in names}
    raise ValueError(f"unknown warehouse kind: {kind}")


def read_warehouse(spark: SparkSession, kind: str, **fields) -> DataFrame:
    fmt, options = warehouse_options(kind, **fields)
    return spark.read.format(fmt).options(**options).load()


def parse_timestamps(df: DataFrame, column: str) -> DataFrame:
    """ISO-8601 text to timestamps; unreadable text becomes NULL."""
    return df.withColumn(column, F.try_to_timestamp(F.col(column)))
