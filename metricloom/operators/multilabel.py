"""Multi-label metrics. Each row's label arrays are compared inside the row, so nothing is self-joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.labels import (
    explode_confidences,
    label_count,
    label_set,
    named_labels,
    scored_labels,
    sorted_pairs,
)
from metricloom.functions.numeric import flag, ratio_or_null
from metricloom.operators.common import bucketed


def confusion_per_label(df: DataFrame, *, ts: str, predicted: str, actual: str, bucket: str = "1 day",
                        group_by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn per label; one row of ``df`` is one inference."""
    rows = bucketed(df, ts, bucket, {"_p": named_labels(predicted), "_a": named_labels(actual)}, group_by, name="ts")
    seen = rows.select("ts", *group_by, "_p", "_a", F.explode(F.array_union("_p", "_a")).alias("series"))
    in_p, in_a = F.array_contains("_p", F.col("series")), F.array_contains("_a", F.col("series"))
    return (
        seen.select("ts", *group_by, "series", in_p.alias("_in_p"), in_a.alias("_in_a"))
        .groupBy("ts", *group_by, "series")
        .agg(
            F.count_if(F.col("_in_p") & F.col("_in_a")).cast("double").alias("tp"),
            F.count_if(F.col("_in_p") & ~F.col("_in_a")).cast("double").alias("fp"),
            F.count_if(~F.col("_in_p") & F.col("_in_a")).cast("double").alias("fn"),
        )
        .orderBy("ts", *group_by, "series")
    )


def precision_recall_f1(df: DataFrame, *, group_by: Sequence[str] = (), **args) -> DataFrame:
    counts = confusion_per_label(df, group_by=group_by, **args)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "ts", *group_by, "series",
        ratio_or_null(tp, tp + fp).alias("precision"),
        ratio_or_null(tp, tp + fn).alias("recall"),
        ratio_or_null(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def class_count(df: DataFrame, *, ts: str, labels: str, bucket: str = "1 day",
                group_by: Sequence[str] = ()) -> DataFrame:
    rows = bucketed(df, ts, bucket, {"_l": named_labels(labels)}, group_by, name="ts")
    return (
        rows.select("ts", *group_by, F.explode("_l").alias("series"))
        .groupBy("ts", *group_by, "series")
        .agg(F.count(F.lit(1)).cast("double").alias("class_count"))
        .orderBy("ts", *group_by, "series")
    )


def per_inference(df: DataFrame, *, ts: str, row_id: str, labels: dict[str, str], bucket: str, group_by: Sequence[str]) -> DataFrame:
    """One row per bucket, segment and inference: ``_id`` and, for each name, the distinct label sets that its rows hold.

    This is the only shuffle of inferences; whatever is counted below it is unfolded after the shuffle and summed
    before the next one.
    """
    sets = {name: F.sort_array(named_labels(column)) for name, column in labels.items()}
    rows = bucketed(df, ts, bucket, {"_id": F.col(row_id), **sets}, group_by, name="ts")
    return rows.groupBy("ts", *group_by, "_id").agg(*[F.collect_set(name).alias(name) for name in labels])


def coverage_ratio(df: DataFrame, *, ts: str, row_id: str, labels: str, bucket: str = "1 day",
                   group_by: Sequence[str] = ()) -> DataFrame:
    """Share of the bucket's distinct inferences that carry the label."""
    keys = ["ts", *group_by]
    inferences = per_inference(df, ts=ts, row_id=row_id, labels={"_l": labels}, bucket=bucket, group_by=group_by)
    # A NULL series stands for the inference itself.
    series = F.concat(F.array_distinct(F.flatten("_l")), F.array(F.lit(None).cast("string")))
    counts = inferences.select(*keys, "_id", F.explode(series).alias("series")).groupBy(*keys, "series").agg(F.count("_id").alias("_n"))
    total = F.max(F.when(F.col("series").isNull(), F.col("_n"))).over(Window.partitionBy(*keys))
    return counts.withColumn("_total", total).filter("series is not null").select(
        *keys, "series", ratio_or_null("_n", "_total").alias("coverage_ratio")
    ).orderBy(*keys, "series")


def _join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be NULL; the right side's keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_k_{k}" for k in keys])


def label_density(df: DataFrame, *, ts: str, labels: str, bucket: str = "1 day",
                  group_by: Sequence[str] = ()) -> DataFrame:
    """Mean labels per row over the number of distinct labels of the whole data set."""
    rows = bucketed(df, ts, bucket, {"_l": F.col(labels)}, group_by, name="ts")
    catalog = rows.select(F.explode(named_labels("_l")).alias("label")).agg(
        F.count_distinct("label").cast("double").alias("_labels")
    )
    means = rows.groupBy("ts", *group_by).agg(F.avg(label_count("_l")).alias("_mean"))
    return means.crossJoin(F.broadcast(catalog)).select(
        "ts", *group_by, ratio_or_null("_mean", "_labels").alias("label_density")
    ).orderBy("ts", *group_by)


def prediction_volume(df: DataFrame, *, ts: str, labels: str, bucket: str = "1 day",
                      group_by: Sequence[str] = ()) -> DataFrame:
    rows = bucketed(df, ts, bucket, {"_n": label_count(labels)}, group_by, name="ts")
    return rows.groupBy("ts", *group_by).agg(F.avg("_n").alias("pred_label_count")).orderBy("ts", *group_by)


def exact_match_ratio(df: DataFrame, *, ts: str, predicted: str, actual: str, bucket: str = "1 day",
                      group_by: Sequence[str] = ()) -> DataFrame:
    same = F.sort_array(label_set(predicted)) == F.sort_array(label_set(actual))
    rows = bucketed(df, ts, bucket, {"_same": flag(same)}, group_by, name="ts")
    return rows.groupBy("ts", *group_by).agg(F.avg("_same").alias("exact_match_ratio")).orderBy("ts", *group_by)


def jaccard_similarity(df: DataFrame, *, ts: str, predicted: str, actual: str, bucket: str = "1 day",
                       group_by: Sequence[str] = ()) -> DataFrame:
    """Mean per-row overlap; two empty label sets agree fully."""
    p, a = label_set(predicted), label_set(actual)
    union = F.size(F.array_union(p, a))
    score = F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(p, a)) / union)
    rows = bucketed(df, ts, bucket, {"_j": score}, group_by, name="ts")
    return rows.groupBy("ts", *group_by).agg(F.avg("_j").alias("jaccard_similarity")).orderBy("ts", *group_by)


def average_confidence(df: DataFrame, *, ts: str, row_id: str, labels: str, confidences: str, bucket: str = "1 day",
                       group_by: Sequence[str] = ()) -> DataFrame:
    """Mean confidence per label over all of the bucket's inferences; absence counts as 0.

    Absent rows add nothing to the sum, so it is divided by the bucket's row count
    instead of pairing every label with every inference.
    """
    keys = ["ts", *group_by]
    rows = bucketed(
        df, ts, bucket, {"_id": F.col(row_id), "_scored": scored_labels(labels, confidences)}, group_by, name="ts"
    )
    totals = rows.groupBy(*keys).agg(F.count_distinct("_id").alias("_n"))
    sums = (
        explode_confidences(rows, keys, "_scored")
        .groupBy(*keys, F.col("label").alias("series"))
        .agg(F.sum("confidence").alias("_sum"))
    )
    return _join_keys(sums, totals, keys).select(
        *keys, "series", (F.col("_sum") / F.col("_n")).alias("avg_confidence")
    ).orderBy(*keys, "series")


def label_cooccurrence(df: DataFrame, *, ts: str, row_id: str, predicted: str, actual: str, bucket: str = "1 day",
                       group_by: Sequence[str] = ()) -> DataFrame:
    """Inferences per unordered label pair, predicted and actual, from one scan; a pair lies in one row of the inference."""
    keys = ["ts", *group_by]
    inferences = per_inference(df, ts=ts, row_id=row_id, labels={"_p": predicted, "_a": actual}, bucket=bucket, group_by=group_by)

    def side(sets: str, first: int) -> Column:
        # The pairs of one set differ; only several sets of an inference can repeat one.
        all_pairs = F.flatten(F.transform(sets, sorted_pairs))
        pairs = F.when(F.size(sets) > 1, F.array_distinct(all_pairs)).otherwise(all_pairs)
        return F.transform(pairs, lambda p: F.struct(p["label_1"].alias("label_1"), p["label_2"].alias("label_2"),
                                                     F.lit(first).alias("_in_p"), F.lit(1 - first).alias("_in_a")))

    pairs = inferences.select(*keys, F.explode(F.concat(side("_p", 1), side("_a", 0))).alias("_pair"))
    return (
        pairs.groupBy(*keys, F.col("_pair.label_1").alias("label_1"), F.col("_pair.label_2").alias("label_2"))
        .agg(
            F.sum("_pair._in_p").cast("double").alias("pred_cooccurrence_count"),
            F.sum("_pair._in_a").cast("double").alias("gt_cooccurrence_count"),
        )
        .orderBy(*keys, "label_1", "label_2")
    )


def pair_association(df: DataFrame, *, ts: str, row_id: str, labels: str, bucket: str = "1 day",
                     group_by: Sequence[str] = ()) -> DataFrame:
    """P(2|1), P(1|2), lift and Jaccard of label pairs, from pair, label and row counts."""
    keys = ["ts", *group_by]
    args = {"ts": ts, "bucket": bucket, "group_by": group_by}
    pairs = label_cooccurrence(df, row_id=row_id, predicted=labels, actual=labels, **args)
    singles = class_count(df, labels=labels, **args)
    totals = bucketed(df, ts, bucket, {}, group_by, name="ts").groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    joined = pairs.withColumnRenamed("pred_cooccurrence_count", "_ab")
    for side in ("1", "2"):
        counts = singles.select(*keys, F.col("series").alias(f"label_{side}"), F.col("class_count").alias(f"_n{side}"))
        joined = _join_keys(joined, counts, [*keys, f"label_{side}"])
    joined = _join_keys(joined, totals, keys)
    both, first, second, n = (F.col(c) for c in ("_ab", "_n1", "_n2", "_rows"))
    return joined.select(
        *keys, "label_1", "label_2", both.alias("pair_count"),
        ratio_or_null(both, first).alias("p_2_given_1"),
        ratio_or_null(both, second).alias("p_1_given_2"),
        ratio_or_null(both * n, first * second).alias("lift"),
        ratio_or_null(both, first + second - both).alias("jaccard"),
    ).orderBy(*keys, "label_1", "label_2")
