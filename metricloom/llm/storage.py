"""Tables written to the shared scratch folder, which cut the lineage and survive lost executors."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from metricloom.session import scratch_path

_scopes: list[list[str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    for made in _scopes:
        made.append(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """The paths of all tables that ``stage`` writes inside the block."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def drop_tables(spark: SparkSession, paths: list[str], *needed: DataFrame) -> list[str]:
    """Delete those of the written tables that none of ``needed`` reads; the others are returned."""
    read = [f for df in needed for f in df.inputFiles()]
    kept = [p for p in paths if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in read)]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        if p not in kept:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)
    return kept


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions_for(spark: SparkSession, amount: float, per_partition: float) -> int:
    """So many partitions that each holds about ``per_partition``, and no fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(amount) // int(per_partition)))
