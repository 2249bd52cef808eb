"""Label-array expressions; everything stays in built-in functions, those without lambdas where they do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions.numeric import as_col


def _without(labels: Column | str, left_out: Column) -> Column:
    """The distinct elements but those left out, in order; a NULL array becomes empty. One pass without a lambda."""
    empty = F.array().cast("array<string>")
    return F.array_except(F.coalesce(as_col(labels).cast("array<string>"), empty), left_out)


def label_set(labels: Column | str) -> Column:
    """Distinct, non-NULL elements."""
    return _without(labels, F.array(F.lit(None).cast("string")))


def named_labels(labels: Column | str) -> Column:
    """Distinct, non-NULL, non-empty labels."""
    return _without(labels, F.array(F.lit(None).cast("string"), F.lit("")))


def label_count(labels: Column | str) -> Column:
    """Array length with duplicates and NULL elements; a NULL array counts 0."""
    return F.coalesce(F.size(F.coalesce(as_col(labels), F.array().cast("array<string>"))), F.lit(0)).cast("double")


def sorted_pairs(names: Column) -> Column:
    """Pairs (label_1 < label_2) of distinct names in ascending order."""
    return F.flatten(
        F.transform(
            names,
            lambda a, i: F.transform(
                F.slice(names, i + 2, F.size(names)),
                lambda b: F.struct(a.alias("label_1"), b.alias("label_2")),
            ),
        )
    )


def label_pairs(labels: Column | str) -> Column:
    """Unordered pairs (label_1 < label_2) of the labels of one row."""
    # As a lambda's argument the names are made once, not again for each of them.
    return F.element_at(F.transform(F.array(F.sort_array(named_labels(labels))), sorted_pairs), 1)


def scored_labels(labels: Column | str, confidences: Column | str) -> Column:
    """(label, confidence) for every named label position; where a label is repeated, the scored ones first."""
    zipped = F.arrays_zip(
        as_col(labels).cast("array<string>").alias("label"), as_col(confidences).cast("array<double>").alias("confidence")
    )
    named = lambda z: z["label"].isNotNull() & (z["label"] != "")
    ordered = F.concat(
        F.filter(zipped, lambda z: named(z) & z["confidence"].isNotNull()),
        F.filter(zipped, lambda z: named(z) & z["confidence"].isNull()),
    )
    # Where all labels are named and differ, nothing is left out and nothing has to come first.
    plain = F.size(named_labels(labels)) == F.size(zipped)
    return F.coalesce(
        F.when(plain, zipped).otherwise(ordered),
        F.array().cast("array<struct<label:string,confidence:double>>"),
    )


def explode_confidences(df: DataFrame, keys: Sequence[str], scored: str) -> DataFrame:
    """One row per distinct label of each row: its first scored confidence, or 0.0 when it has none.

    The names are laid out before the explode, so no array is rebuilt per element.
    """
    named = df.withColumn("_names", F.col(scored)["label"])
    spread = named.select(*keys, "_names", F.posexplode(scored).alias("_position", "_entry"))
    first = F.array_position("_names", F.col("_entry.label")) == F.col("_position") + 1
    return spread.filter(first).select(
        *keys, "_entry.label", F.coalesce("_entry.confidence", F.lit(0.0)).alias("confidence")
    )
