"""Population stability: current distribution per bucket against a reference distribution.

Rows are reduced to (bucket, bin) counts in one partial aggregation; everything
after that works on counts. Numeric references have at most ``num_bins`` rows, so
they are broadcast; categorical references have no bound and are left to Catalyst.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.numeric import clamped_bin
from metricloom.functions.timebuckets import bucket_start, width_seconds
from metricloom.operators.timeseries import trailing_sums

EPSILON = 1e-6


def _psi_term(current: Column, reference: Column) -> Column:
    p = F.greatest(F.coalesce(current, F.lit(0.0)), F.lit(EPSILON))
    q = F.greatest(F.coalesce(reference, F.lit(0.0)), F.lit(EPSILON))
    return (p - q) * F.ln(p / q)


def _shares(counts: DataFrame, within: Sequence[str], name: str) -> DataFrame:
    """Share of ``n`` within a group of at most a few bins."""
    total = F.sum("n").over(Window.partitionBy(*within))
    return counts.withColumn(name, F.col("n") / F.nullif(total.cast("double"), F.lit(0.0))).drop("n")


def _shares_of_unbounded(counts: DataFrame, within: Sequence[str], name: str) -> DataFrame:
    """The same for groups of any number of categories: the totals are joined back instead of a window."""
    totals = counts.groupBy(*[F.col(k).alias(f"_k_{k}") for k in within]).agg(F.sum("n").cast("double").alias("_total"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in within]
    joined = counts.join(totals, on).withColumn(name, F.col("n") / F.col("_total"))
    return joined.drop("n", "_total", *[f"_k_{k}" for k in within])


def _range(df: DataFrame, feature: str) -> DataFrame:
    """One row: the value range of the reference."""
    value = F.col(feature).cast("double")
    return df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))


def _reference_shares(rows: DataFrame, bounds: DataFrame, feature: str, bins: int) -> DataFrame:
    binned = clamped_bin(F.col(feature).cast("double"), F.col("_low"), F.col("_high"), bins)
    counts = rows.crossJoin(F.broadcast(bounds)).groupBy(binned.alias("bin_id")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").cast("double").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("bin_id", (F.col("n") / F.col("_total")).alias("p_ref"))


def _current_shares(df: DataFrame, bounds: DataFrame, ts: str, feature: str, bins: int, bucket: str,
                    group_by: Sequence[str]) -> DataFrame:
    binned = clamped_bin(F.col(feature).cast("double"), F.col("_low"), F.col("_high"), bins)
    counts = (
        df.crossJoin(F.broadcast(bounds))
        .groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by, binned.alias("bin_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return _shares(counts, ["bucket", *group_by], "p_cur")


def psi_against_reference(df: DataFrame, reference: DataFrame, *, ts: str, feature: str, num_bins: int = 10,
                          bucket: str = "1 day", group_by: Sequence[str] = ()) -> DataFrame:
    """Numeric PSI against a fixed reference table; bins absent from the current bucket add nothing."""
    bounds = _range(reference, feature)
    ref = _reference_shares(reference, bounds, feature, num_bins)
    cur = _current_shares(df, bounds, ts, feature, num_bins, bucket, group_by)
    return (
        cur.join(F.broadcast(ref), "bin_id", "left")
        .groupBy("bucket", *group_by)
        .agg(F.sum(_psi_term(F.col("p_cur"), F.col("p_ref"))).alias("psi_against_reference"))
        .orderBy("bucket", *group_by)
    )


def psi_categorical(df: DataFrame, reference: DataFrame, *, ts: str, feature: str, bucket: str = "5 minutes",
                    group_by: Sequence[str] = ()) -> DataFrame:
    """PSI over category shares. A NULL category is a category of the current bucket without a reference share."""
    ref_counts = reference.groupBy(F.col(feature).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = ref_counts.agg(F.sum("n").cast("double").alias("_total"))
    ref = ref_counts.crossJoin(F.broadcast(total)).select("category", (F.col("n") / F.col("_total")).alias("p_ref"))
    cur_counts = df.groupBy(
        bucket_start(ts, bucket).alias("bucket"), *group_by, F.col(feature).alias("category")
    ).agg(F.count(F.lit(1)).alias("n"))
    cur = _shares_of_unbounded(cur_counts, ["bucket", *group_by], "p_cur")
    return (
        cur.join(ref, "category", "left")
        .groupBy("bucket", *group_by)
        .agg(F.sum(_psi_term(F.col("p_cur"), F.col("p_ref"))).alias("psi_against_reference"))
        .orderBy("bucket", *group_by)
    )


def psi_trailing(df: DataFrame, *, ts: str, feature: str, num_bins: int = 10, bucket: str = "5 minutes",
                 lookback: str = "30 days", categorical: bool = False, group_by: Sequence[str] = ()) -> DataFrame:
    """PSI of each bucket against the rows of the ``lookback`` before it.

    Bins span the global range; the top value itself lands in bin ``num_bins + 1``.
    The reference total counts all bins, also those absent from the bucket.
    """
    rows = df.filter(F.col(ts).isNotNull())
    if categorical:
        bin_id = F.col(feature)
    else:
        rows = rows.crossJoin(F.broadcast(_range(df, feature)))
        bin_id = F.width_bucket(F.col(feature).cast("double"), F.col("_low"), F.col("_high"), F.lit(num_bins))
    counts = rows.groupBy(bucket_start(ts, bucket).alias("bucket"), *group_by, bin_id.alias("bin_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    span = width_seconds(lookback)
    per_bin = trailing_sums(counts, [*group_by, "bin_id"], "bucket", {"ref_n": "n"}, span=span)
    totals = counts.groupBy("bucket", *group_by).agg(F.sum("n").alias("total"))
    per_bucket = trailing_sums(totals, group_by, "bucket", {"ref_total": "total"}, span=span)
    on = [per_bin[k].eqNullSafe(per_bucket[k]) for k in ("bucket", *group_by)]
    joined = per_bin.join(per_bucket, on).select(
        *[per_bin[k] for k in ("bucket", *group_by)],
        (F.col("n") / F.col("total").cast("double")).alias("p_cur"),
        (F.col("ref_n") / F.nullif(F.col("ref_total").cast("double"), F.lit(0.0))).alias("p_ref"),
    )
    return (
        joined.groupBy("bucket", *group_by)
        .agg(F.sum(_psi_term(F.col("p_cur"), F.col("p_ref"))).alias("psi_vs_30d_baseline"))
        .orderBy("bucket", *group_by)
    )


def drift_score(df: DataFrame, *, ts: str, feature: str, reference_start, reference_end, num_bins: int = 10,
                bucket: str = "1 day") -> DataFrame:
    """PSI of every bucket from ``reference_end`` on against an earlier period of the same table.

    Reference bins that no current bucket holds are charged once, to the first bucket.
    """
    start, end = (F.lit(t).cast("timestamp") for t in (reference_start, reference_end))
    rows = df.dropna(subset=[ts, feature])
    reference = rows.filter((F.col(ts) >= start) & (F.col(ts) < end))
    bounds = _range(reference, feature)
    ref = _reference_shares(reference, bounds, feature, num_bins)
    cur = _current_shares(rows.filter(F.col(ts) >= end), bounds, ts, feature, num_bins, bucket, ())
    present = cur.join(F.broadcast(ref), "bin_id", "left").select(
        "bucket", _psi_term(F.col("p_cur"), F.col("p_ref")).alias("term")
    )
    # At most num_bins distinct bins, so the set fits one row.
    seen = cur.agg(F.min("bucket").alias("bucket"), F.collect_set("bin_id").alias("_bins"))
    unseen = (
        ref.crossJoin(F.broadcast(seen))
        .filter(~F.array_contains("_bins", F.col("bin_id")))
        .select("bucket", _psi_term(F.lit(EPSILON), F.col("p_ref")).alias("term"))
    )
    return (
        present.unionByName(unseen)
        .groupBy(F.col("bucket").alias("ts"))
        .agg(F.sum("term").alias("drift_score"))
        .withColumn("monitored_column", F.lit(feature))
        .orderBy("ts")
    )
