"""Column functions with the null rules the pipeline relies on: null is kept, NaN is turned into null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def clip_at(col: Column, bound: float = 0.0) -> Column:
    """Raise values below `bound` to it. `greatest` would turn null into the bound."""
    return F.when(col < bound, F.lit(float(bound))).otherwise(col)


def nan_as_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def sum_horizontal(cols: Sequence[str | Column]) -> Column:
    """Row sum with null counted as zero."""
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)) for c in cols]
    return reduce(lambda a, b: a + b, parts)


def guarded_ratio(num: Column, den: Column, gate: Column, threshold: float) -> Column:
    """`num / den` where `gate` exceeds `threshold`, else null."""
    return F.when(gate > threshold, F.try_divide(num, den))


def variation(std: Column, mean: Column, floor: float = 1e-10) -> Column:
    """Coefficient of variation; null where the mean is practically zero."""
    return F.when(F.abs(mean) > floor, std / F.abs(mean))


def scaled_corr(x: Column, y: Column) -> Column:
    """Population covariance over the product of sample deviations, on rows where both are known; 0 if either is flat.

    This is Pearson's r times (n-1)/n.
    """
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_samp(F.when(both, x)), F.stddev_samp(F.when(both, y))
    flat = (sx == 0) | (sy == 0)
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.covar_pop(x, y), sx * sy))
