"""Ordered computations that never put a whole group in one task.

Ranking curves, ranks, exact percentiles and N-tiles all need running totals
along a sorted value. A plain window partitioned by the group would sort the
group in one task, and one day or segment may hold a third of all rows. Here a
group is cut into blocks of values: running totals are taken inside each block, and
each block starts from the total of the blocks before it.

Blocks follow the data. One value in ``BLOCK_ROWS``, chosen by a hash, ends a block: a sample that merges
from any partitioning and is the same in every run. So a block holds about that many distinct values
wherever they lie, in a narrow range as well as over many orders of magnitude. Values are
counted and written first, then their splitters, so all branches see the same blocks, and the planner knows
whether the splitters are small enough to be broadcast. Without the rows for two blocks there is one, and no splitters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.session import written

#: Distinct values of a group that share a block, on average.
BLOCK_ROWS = 32_768


def splitters(df: DataFrame, keys: Sequence[str], order: str, block_rows: int) -> DataFrame:
    """``_key, _marks``: the ascending values at which the blocks of a group begin; groups with one block are missing."""
    value = F.col(order).cast("double")
    chosen = df.filter(value.isNotNull() & ~F.isnan(value)).filter(F.pmod(F.xxhash64(F.lit(29), value), F.lit(block_rows)) == 0)
    return chosen.groupBy(group_key(keys).alias("_key")).agg(F.sort_array(F.collect_set(value)).alias("_marks"))


def block_of(value: Column, marks: Column) -> Column:
    """How many of the ascending ``marks`` are at most ``value``, by binary search; NULL comes first, NaN last."""
    steps = F.reverse(F.sequence(F.lit(0), F.length(F.bin(F.size(marks))) - 1))

    def down(at: Column, step: Column) -> Column:
        further = at + F.pow(F.lit(2.0), step).cast("int")
        return F.when((further <= F.size(marks)) & (F.get(marks, further - 1) <= value), further).otherwise(at)

    found = F.when(F.size(marks) > 0, F.aggregate(steps, F.lit(0), down)).otherwise(F.lit(0))
    # Never NULL, so that joins on the block add no filter and both sides stay the same subplan.
    return F.coalesce(F.when(value.isNull(), F.lit(-1)).otherwise(found), F.lit(0)).cast("long")


def with_blocks(df: DataFrame, keys: Sequence[str], order: str, block_rows: int | None = None) -> DataFrame:
    """``df``, written, with ``_key`` and ``_block``."""
    block_rows = block_rows or BLOCK_ROWS
    table = written(df, "ordered-values")
    keyed = table.withColumn("_key", group_key(keys))
    if table.count() <= 2 * block_rows:
        return keyed.withColumn("_block", F.lit(0).cast("long"))
    marks = written(splitters(table, keys, order, block_rows), "ordered-splitters")
    joined = keyed.join(marks, "_key", "left").withColumn("_marks", F.coalesce("_marks", F.array().cast("array<double>")))
    return joined.withColumn("_block", block_of(F.col(order).cast("double"), F.col("_marks"))).drop("_marks")


def group_key(keys: Sequence[str]) -> Column:
    """All keys as one struct, so that NULL keys join with each other."""
    return F.struct(*keys) if keys else F.lit(0)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    descending: bool = False,
    tie_break: Sequence[str] = (),
    block: Column | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (through the row) and ``total_<c>`` (of the group) for every ``c`` in ``sums``.

    ``df`` holds one row per (keys, order, tie_break); callers pre-aggregate first. ``block`` is for orders whose
    blocks are known without looking at the data: a long that never decreases along the order and depends on it alone.
    """
    direction = F.desc if descending else F.asc
    if block is None:
        blocked = with_blocks(df, keys, order, block_rows)
    else:
        blocked = df.withColumn("_key", group_key(keys)).withColumn("_block", block.cast("long"))
    # One shuffle serves the block totals and the running totals; Spark reuses it for both.
    blocked = blocked.repartition("_key", "_block")

    blocks = blocked.groupBy("_key", "_block").agg(*[F.sum(c).alias(f"_in_{c}") for c in sums])
    group = Window.partitionBy("_key")
    before = group.orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_key",
        "_block",
        *[F.coalesce(F.sum(f"_in_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
        *[F.sum(f"_in_{c}").over(group).alias(f"total_{c}") for c in sums],
    )

    inside = (
        Window.partitionBy("_key", "_block")
        .orderBy(direction(order), *tie_break)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = blocked.select("*", *[F.sum(c).over(inside).alias(f"_local_{c}") for c in sums])
    joined = local.join(offsets, ["_key", "_block"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_local_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"total_{c}") for c in sums],
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    *,
    sums: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles per group, plus the row count ``n`` and optional sums.

    The values are collapsed to counts first, then each rank is looked up in the
    running counts; no group is held in memory as a whole.
    """
    sums = dict(sums or {})
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    )
    ranked = running_totals(counts, keys, "_value", ["n"]).withColumn("_below", F.col("cum_n") - F.col("n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_below") <= rank) & (rank < F.col("cum_n")), F.col("_value")))

    picks, outs = [], []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("total_n") - 1)
        picks += [
            at(F.floor(position)).alias(f"_low_{name}"),
            at(F.ceil(position)).alias(f"_high_{name}"),
            F.max(position - F.floor(position)).alias(f"_part_{name}"),
        ]
        low, high, part = F.col(f"_low_{name}"), F.col(f"_high_{name}"), F.col(f"_part_{name}")
        outs.append((low + (high - low) * part).alias(name))
    totals = [F.sum(f"_sum_{k}").alias(k) for k in sums]
    result = ranked.groupBy(*keys).agg(*picks, F.sum("n").alias("n"), *totals)
    return result.select(*keys, *outs, "n", *sums)


def weighted_tiles(df: DataFrame, keys: Sequence[str], order: str, weight: str, tiles: int,
                   *, tie_break: Sequence[str] = ()) -> DataFrame:
    """N-tiles over rows that carry a count: one output row per (row, tile) with the overlap as weight.

    The first ``n % tiles`` tiles hold one row more, as NTILE has it.
    """
    ranked = running_totals(df, keys, order, [weight], tie_break=tie_break)
    n, first, last = F.col(f"total_{weight}"), F.col(f"cum_{weight}") - F.col(weight), F.col(f"cum_{weight}") - 1
    small, extra = F.floor(n / F.lit(tiles)), n % tiles

    def start_of(tile: Column) -> Column:
        return tile * small + F.least(tile, extra)

    def tile_of(row: Column) -> Column:
        in_large = row < extra * (small + 1)
        return F.when(in_large, F.floor(row / (small + 1))).otherwise(
            extra + F.floor((row - extra * (small + 1)) / F.greatest(small, F.lit(1)))
        )

    spread = ranked.select("*", F.explode(F.sequence(tile_of(first), tile_of(last))).alias("_tile"))
    tile = F.col("_tile")
    overlap = F.least(last + 1, start_of(tile + 1)) - F.greatest(first, start_of(tile))
    return spread.select(
        *[c for c in df.columns if c != weight], (tile + 1).cast("int").alias("tile"), overlap.alias(weight)
    )
