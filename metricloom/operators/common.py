"""Shared preparation steps of the metric functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.functions.timebuckets import bucket_start


def bucketed(df: DataFrame, ts: str, bucket: str, columns: dict, group_by: Sequence[str] = (),
             *, name: str = "bucket", drop_null_ts: bool = True) -> DataFrame:
    """Bucket start, segment columns and the renamed metric inputs; nothing else is read."""
    if drop_null_ts:
        df = df.filter(F.col(ts).isNotNull())
    return df.select(bucket_start(ts, bucket).alias(name), *group_by, *[c.alias(k) for k, c in columns.items()])


def prediction_pairs(df: DataFrame, *, ts: str, prediction: str, actual: str, bucket: str,
                     group_by: Sequence[str] = (), nonzero: bool = False, min_actual: float | None = None) -> DataFrame:
    """(ts, segments, prediction, actual) rows with nothing NULL."""
    kept = df.dropna(subset=[ts, prediction, actual])
    if nonzero:
        kept = kept.filter(F.col(actual) != 0)
    if min_actual is not None:
        kept = kept.filter(F.abs(F.col(actual)) > min_actual)
    return bucketed(
        kept, ts, bucket,
        {"prediction": F.col(prediction).cast("double"), "actual": F.col(actual).cast("double")},
        group_by, name="ts",
    )
