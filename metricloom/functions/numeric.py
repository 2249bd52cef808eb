"""Guarded ratios, clamped bins and value bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio_or_zero(num: Column | str, den: Column | str) -> Column:
    num, den = as_col(num), as_col(den)
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def ratio_or_null(num: Column | str, den: Column | str) -> Column:
    return as_col(num) / F.nullif(as_col(den), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (also for NULL)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def clamped_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 1..bins, values outside the range in the edge bins, NULL in bin 1."""
    step = F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * bins) + 1
    return F.when(high == low, F.lit(1)).otherwise(
        F.least(F.lit(bins), F.greatest(F.lit(1), step)).cast("int")
    )


def band(value: Column, cuts: Sequence[tuple[float, str]], otherwise: str, *, descending: bool = False,
         inclusive: bool = False) -> Column:
    """First label whose cut the value is below (or above, when descending)."""
    out = None
    for cut, label in cuts:
        if descending:
            hit = value >= cut if inclusive else value > cut
        else:
            hit = value <= cut if inclusive else value < cut
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(otherwise))
