"""KLL quantile sketches, all on the built-in JVM aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from metricloom.functions.numeric import as_col


def build(value: Column | str) -> Column:
    return F.kll_sketch_agg_double(as_col(value).cast("double"))


def merge(sketch: Column | str) -> Column:
    return F.kll_merge_agg_double(as_col(sketch))


def quantile(sketch: Column | str, q: float) -> Column:
    """NULL for a sketch without values."""
    return F.when(count(sketch) > 0, F.kll_sketch_get_quantile_double(as_col(sketch), F.lit(float(q))))


def count(sketch: Column | str) -> Column:
    return F.kll_sketch_get_n_double(as_col(sketch))


def min_item(sketch: Column | str) -> Column:
    return quantile(sketch, 0.0)


def max_item(sketch: Column | str) -> Column:
    return quantile(sketch, 1.0)


def pmf(sketch: Column | str, points: Sequence[float]) -> Column:
    """Mass between successive split points, ``len(points) + 1`` entries.

    Spark's rank is inclusive, so mass exactly on a split point falls to its left.
    """
    ranks = [F.kll_sketch_get_rank_double(as_col(sketch), F.lit(float(p))) for p in points]
    edges = [F.lit(0.0), *ranks, F.lit(1.0)]
    return F.array(*[high - low for low, high in zip(edges, edges[1:])])
