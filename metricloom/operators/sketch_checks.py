"""Sketch answers held to their error: exact rank bounds beside what a KLL sketch says.

A sketch's quantile may be off by a rank error that its parameter ``k`` fixes. ``quantile_bands`` finds, exactly and
for every group, the two values between which such an answer must lie; ``held_quantiles`` tells whether
it does. ``mass_table`` does the same for the mass between split points. A sketch that was
built wrong, merged twice or read from another series breaks its band.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.functions import sketches
from metricloom.operators.ordered import group_key, running_totals
from metricloom.session import written

#: The k of Spark's sketches unless another is asked for.
DEFAULT_K = 200
#: Groups of fewer values are ordered whole: their ranks lie too close together to be told apart by a sketch's error.
MARKED_ROWS = 1024


def rank_error(k: int = DEFAULT_K, *, mass: bool = False) -> float:
    """The normalised rank error of a KLL sketch at 99 % confidence: of one rank, or of the mass between two."""
    # The published fit for this family of sketches.
    return 2.446 / k**0.9433 if mass else 2.296 / k**0.9723


def allowed(k: int = DEFAULT_K, *, mass: bool = False) -> float:
    """Twice the published error, so that many groups can be checked at once without chance failures."""
    return round(2 * rank_error(k, mass=mass), 4)


def _ends(quantiles: Mapping[str, float], gap: float) -> list[tuple[float, bool]]:
    """Ascending ends, each a part of the rows and whether a stretch opens there, of the stretches where the ranks asked for must lie.

    A stretch reaches a sketch's allowed error to both sides of such a rank. Ends beyond the first or last row are left out.
    """
    stretches: list[list[float]] = []
    for part in sorted(q + side for q in quantiles.values() for side in (-gap, gap)):
        low, high = part - allowed(), part + allowed()
        if stretches and low <= stretches[-1][1]:
            stretches[-1][1] = high
        else:
            stretches.append([low, high])
    return [(part, opens) for stretch in stretches for part, opens in zip(stretch, (True, False), strict=True) if 0 < part < 1]


def quantile_bands(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], *,
                   gap: float | None = None, merged: DataFrame | None = None, sketch: str = "s") -> DataFrame:
    """``keys, n`` and ``<name>_low, <name>_high``: exact values at the ranks ``q - gap`` and ``q + gap`` of the non-null rows.

    A sketch of each group, from ``merged`` or built here, says between which values these ranks lie. Only the values there are kept
    apart and ordered; those below, between and above are counted. The counts show whether a rank was met: a group
    where one was not, as its sketch is a wrong one, is done again with all its values. So a sketch decides what is ordered, never the result.
    """
    gap = allowed() if gap is None else gap
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_value"))
    if merged is None:
        merged = rows.groupBy(*keys).agg(sketches.build("_value").alias(sketch))
    ends = _ends(quantiles, gap)
    if not ends:
        return _bands(rows, keys, quantiles, gap, ends)
    marks = [F.when(sketches.count(sketch) >= MARKED_ROWS, sketches.quantile(sketch, part)).alias(f"_m{i}") for i, (part, _) in enumerate(ends)]
    # One row for a key, whatever is in ``merged``, so that no row is counted twice.
    known = merged.select(group_key(keys).alias("_key"), F.struct(*marks).alias("_m")).groupBy("_key").agg(F.max("_m").alias("_m"))
    known = written(known.select("_key", "_m.*"), "band-marks")
    marked = rows.withColumn("_key", group_key(keys)).join(known, "_key", "left")

    out = written(_bands(marked, keys, quantiles, gap, ends), "quantile-bands")
    lost = F.lit(False)
    for name in quantiles:
        lost = lost | F.col(f"{name}_low").isNull() | F.col(f"{name}_high").isNull()
    missed = out.filter(lost).select(group_key(keys).alias("_key"))
    if missed.isEmpty():
        return out
    again = rows.withColumn("_key", group_key(keys)).join(missed, "_key", "left_semi")
    return out.filter(~lost).unionByName(_bands(again, keys, quantiles, gap, []))


def _bands(rows: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float], gap: float, ends: Sequence[tuple[float, bool]]) -> DataFrame:
    """The bands of rows with their group's marks ``_m0``, ``_m1``, ...; a rank outside the stretches is NULL."""
    # Region i ends at mark i. The values of a region outside the stretches count at its mark, in their place by the region.
    region, at_value, outside = F.lit(-1), F.col("_value"), [i for i, (_, opens) in enumerate(ends) if opens]
    if ends:
        none = F.col("_m0").isNull() | F.col("_value").isNull()
        region, at_value = F.when(none, -1), F.when(none, F.col("_value"))
        for i, (_, opens) in enumerate(ends):
            mark = F.col(f"_m{i}")
            here = F.col("_value") < mark if opens else F.col("_value") <= mark
            region, at_value = region.when(here, i), at_value.when(here, mark if opens else F.col("_value"))
        beyond = not ends[-1][1]
        outside += [len(ends)] * beyond
        region, at_value = region.otherwise(len(ends)), at_value.otherwise(F.col(f"_m{len(ends) - 1}") if beyond else F.col("_value"))
    counts = rows.select(*keys, region.alias("_region"), at_value.alias("_value")).groupBy(*keys, "_region", "_value").agg(
        F.count(F.lit(1)).alias("n"))
    ranked = running_totals(counts, keys, "_value", ["n"], tie_break=["_region"]).withColumn("_below", F.col("cum_n") - F.col("n"))
    n, kept = F.col("total_n"), ~F.col("_region").isin(*outside) if outside else F.lit(True)

    def at(rank: Column) -> Column:
        return F.max(F.when(kept & (F.col("_below") <= rank) & (rank < F.col("cum_n")), F.col("_value")))

    picks = []
    for name, q in quantiles.items():
        low = F.greatest(F.lit(0.0), F.floor(F.lit(q - gap) * n) - 1)
        high = F.least(n - 1.0, F.ceil(F.lit(q + gap) * n))
        picks += [at(low).alias(f"{name}_low"), at(high).alias(f"{name}_high")]
    return ranked.groupBy(*keys).agg(F.sum("n").alias("n"), *picks)


def held_quantiles(df: DataFrame, merged: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], *,
                   sketch: str = "s", gap: float | None = None) -> DataFrame:
    """The bands of ``df``'s groups with ``<name>_held``: whether the answer of the group's sketch in ``merged`` lies in its band.

    A missing sketch, or one of another number of values, holds nothing.
    """
    merged = written(merged.select(*keys, sketch), "merged-sketches")
    bands = quantile_bands(df, keys, value, quantiles, gap=gap, merged=merged, sketch=sketch).withColumn("_key", group_key(keys))
    answers = merged.select(group_key(keys).alias("_key"), sketches.count(sketch).alias("_n"),
                            *[sketches.quantile(sketch, q).alias(f"_{name}") for name, q in quantiles.items()])
    both = bands.join(answers, "_key", "left")
    held = [F.coalesce((F.col("_n") == F.col("n")) & F.col(f"_{name}").between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(False))
            .alias(f"{name}_held") for name in quantiles]
    return both.select(*keys, "n", *[f"{name}_{end}" for name in quantiles for end in ("low", "high")], *held)


def mass_table(df: DataFrame, merged: DataFrame, value: str, points: Sequence[float], *, sketch: str = "s",
               gap: float | None = None) -> DataFrame:
    """``pos, n, exact_count, estimated_count, held`` for each stretch between ascending split points, from 0 on.

    A value on a split point counts for the stretch below it, as the sketch has it. Every stretch has a row, empty or not.
    """
    gap = allowed(mass=True) if gap is None else gap
    table = merged.select(sketches.count(sketch).alias("n"), F.posexplode(sketches.pmf(sketch, points)).alias("pos", "mass"))
    edges = F.array(*[F.lit(float(p)) for p in points])
    kept = df.filter(F.col(value).isNotNull())
    exact = kept.groupBy(F.size(F.filter(edges, lambda p: p < F.col(value))).alias("pos")).agg(F.count(F.lit(1)).alias("exact_count"))
    both = table.join(exact, "pos", "left").withColumn("exact_count", F.coalesce("exact_count", F.lit(0).cast("long")))
    estimated = F.col("mass") * F.col("n")
    return both.select("pos", "n", "exact_count", estimated.alias("estimated_count"),
                       (F.abs(estimated - F.col("exact_count")) <= gap * F.col("n")).alias("held"))
