"""Spearman and Kendall rank correlation per bucket, from one frame of ranks.

Rows are counted to distinct pairs once. Each side's values get their minimum and dense ranks from running totals,
and the pairs with both ranks are written; both coefficients read that table.

Kendall's pair count is quadratic when pairs are listed. Here every pair is
settled at the highest base-8 digit in which the two dense x ranks differ: rows that
share the digits above it form a group, and inside the group running weights
along the dense y ranks count the concordant and discordant pairs. That is n log n work, made of
shuffles and running totals only, and no pair is ever emitted. Dense ranks are evenly spread by
themselves, so the blocks of these totals are plain ranges of ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.operators.common import bucketed
from metricloom.operators.ordered import BLOCK_ROWS, group_key, running_totals
from metricloom.session import written

DIGIT_BITS = 3
DIGITS = 1 << DIGIT_BITS


def _ranks(pairs: DataFrame, value: str) -> DataFrame:
    """``_g, <value>`` and its minimum rank, dense rank from 0 and number of distinct values."""
    counts = pairs.groupBy("_g", value).agg(F.sum("n").alias("n"), F.lit(1).cast("long").alias("d"))
    return running_totals(counts, ["_g"], value, ["n", "d"]).select(
        "_g", value,
        (F.col("cum_n") - F.col("n") + 1).cast("double").alias(f"rank_{value}"),
        (F.col("cum_d") - 1).alias(f"dense_{value}"),
        F.col("total_d").alias(f"distinct_{value}"),
    )


def ranked_pairs(df: DataFrame, *, ts: str, x: str, y: str, bucket: str = "1 day", group_by: Sequence[str] = ()) -> DataFrame:
    """The written frame of distinct pairs: ``_g`` (bucket and segments), their row count ``n``, and the ranks of both sides."""
    rows = bucketed(
        df.dropna(subset=[x, y]), ts, bucket, {"x": F.col(x).cast("double"), "y": F.col(y).cast("double")}, group_by
    )
    pairs = rows.groupBy(group_key(["bucket", *group_by]).alias("_g"), "x", "y").agg(F.count(F.lit(1)).alias("n"))
    pairs = written(pairs, "rank-pairs")
    ranked = pairs.join(_ranks(pairs, "x"), ["_g", "x"]).join(_ranks(pairs, "y"), ["_g", "y"])
    return written(ranked.drop("x", "y"), "rank-frame")


def _spearman(ranked: DataFrame) -> DataFrame:
    n, rx, ry = F.col("n"), F.col("rank_x"), F.col("rank_y")
    moments = ranked.groupBy("_g").agg(
        F.sum("n").alias("n"),
        *[
            (F.sum(n * value) / F.sum("n")).alias(name)
            for name, value in (("mx", rx), ("my", ry), ("mxy", rx * ry), ("mxx", rx * rx), ("myy", ry * ry))
        ],
    )
    spread = (F.col("mxx") - F.col("mx") * F.col("mx")) * (F.col("myy") - F.col("my") * F.col("my"))
    rho = F.when((F.col("n") < 2) | (spread <= 0), F.lit(0.0)).otherwise(
        (F.col("mxy") - F.col("mx") * F.col("my")) / F.sqrt(spread)
    )
    return moments.select("_g", rho.alias("spearman_rho"))


def _kendall(ranked: DataFrame) -> DataFrame:
    levels = F.ceil(F.length(F.bin(F.col("distinct_x") - 1)) / F.lit(DIGIT_BITS)) - 1
    spread = ranked.select("_g", "dense_y", "n", "dense_x", F.explode(F.sequence(F.lit(0), levels.cast("int"))).alias("_level"))
    place = F.col("_level") * DIGIT_BITS
    # Shifting takes its distance per row only in SQL form.
    spread = spread.withColumn("_place", place.cast("int")).select(
        "_g", "dense_y", "n", "_level",
        F.expr(f"shiftright(dense_x, _place) & {DIGITS - 1}").alias("_digit"),
        F.expr(f"shiftright(dense_x, _place + {DIGIT_BITS})").alias("_prefix"),
    )
    weights = [f"w{d}" for d in range(DIGITS)]
    by_y = spread.groupBy("_g", "_level", "_prefix", "dense_y").agg(
        *[F.sum(F.when(F.col("_digit") == d, F.col("n")).otherwise(0)).alias(f"w{d}") for d in range(DIGITS)]
    )
    totals = running_totals(by_y, ["_g", "_level", "_prefix"], "dense_y", weights, block=F.floor(F.col("dense_y") / BLOCK_ROWS))
    # Rows of the group with a strictly smaller y, per digit.
    below = totals.select(
        "_g", *weights, *[(F.col(f"cum_{w}") - F.col(w)).cast("double").alias(f"b_{w}") for w in weights]
    )
    concordant, discordant = F.lit(0.0), F.lit(0.0)
    smaller = F.lit(0.0)
    for d in range(DIGITS):
        concordant = concordant + F.col(f"w{d}") * smaller
        smaller = smaller + F.col(f"b_w{d}")
    larger = F.lit(0.0)
    for d in reversed(range(DIGITS)):
        discordant = discordant + F.col(f"w{d}") * larger
        larger = larger + F.col(f"b_w{d}")
    sums = below.groupBy("_g").agg(F.sum(concordant).alias("c"), F.sum(discordant).alias("d"))
    tau = F.when(F.col("c") + F.col("d") > 0, (F.col("c") - F.col("d")) / (F.col("c") + F.col("d"))).otherwise(0.0)
    return sums.select("_g", tau.alias("kendall_tau"))


def _associations(df: DataFrame, parts, *, bucket_args: dict, group_by: Sequence[str]) -> DataFrame:
    ranked = ranked_pairs(df, group_by=group_by, **bucket_args)
    both = parts[0](ranked)
    for part in parts[1:]:
        both = both.join(part(ranked), "_g")
    return both.select(*[F.col("_g")[k].alias(k) for k in ["bucket", *group_by]], *both.columns[1:]).orderBy("bucket", *group_by)


def rank_association(df: DataFrame, *, ts: str, x: str, y: str, bucket: str = "1 day",
                     group_by: Sequence[str] = ()) -> DataFrame:
    """Spearman's rho on minimum ranks and Kendall's tau over untied pairs, each under two names."""
    both = _associations(df, (_spearman, _kendall), bucket_args={"ts": ts, "x": x, "y": y, "bucket": bucket}, group_by=group_by)
    return both.select(
        "bucket", *group_by,
        F.col("spearman_rho").alias("spearman_rank_correlation_coefficient"),
        "spearman_rho",
        F.col("kendall_tau").alias("kendall_rank_correlation_coefficient"),
        "kendall_tau",
    )


def spearman(df: DataFrame, *, ts: str, x: str, y: str, bucket: str = "1 day",
             group_by: Sequence[str] = ()) -> DataFrame:
    return _associations(df, (_spearman,), bucket_args={"ts": ts, "x": x, "y": y, "bucket": bucket}, group_by=group_by)


def kendall(df: DataFrame, *, ts: str, x: str, y: str, bucket: str = "1 day",
            group_by: Sequence[str] = ()) -> DataFrame:
    return _associations(df, (_kendall,), bucket_args={"ts": ts, "x": x, "y": y, "bucket": bucket}, group_by=group_by)
