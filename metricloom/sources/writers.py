"""Writers for partitioned data and audit files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.operators.alerts import EVIDENCE_COLUMNS


def write_by_date(df: DataFrame, path: str, *, ts: str, column: str = "partition_date",
                  mode: str = "append", file_type: str = "parquet") -> None:
    """One folder per day. Rebalancing gives a busy day several files and quiet days one."""
    dated = df.withColumn(column, F.to_date(F.col(ts).cast("timestamp")))
    dated.hint("rebalance", column).write.mode(mode).partitionBy(column).format(file_type).save(path)


def write_evidence_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with header, sorted by date and metric: days x rules rows, never inference rows."""
    (
        rows.select(*EVIDENCE_COLUMNS)
        .repartition(1)
        .sortWithinPartitions("date", "metric_name")
        .write.mode("overwrite")
        .options(header="true", emptyValue="")
        .csv(path)
    )
