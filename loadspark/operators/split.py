"""Time-based splits: train/test, warm-up, closed bad intervals, hold-outs and expanding folds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loadspark.series import SeriesSpec, attach_stats, interval


def _ntz(at: datetime | date) -> Column:
    return F.lit(datetime(at.year, at.month, at.day) if not isinstance(at, datetime) else at).cast("timestamp_ntz")


def between_dates(df: DataFrame, col: str, first: date, last: date) -> DataFrame:
    """Rows of the days `first` to `last`, both included; a half-open range, so it reaches the scan."""
    return df.where((F.col(col) >= _ntz(first)) & (F.col(col) < _ntz(last + timedelta(days=1))))


def split_temporal(df: DataFrame, spec: SeriesSpec, at: datetime) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(spec.ts) < _ntz(at)), df.where(F.col(spec.ts) >= _ntz(at))


def clip_warmup(df: DataFrame, spec: SeriesSpec, start: datetime | None = None, days: int = 9) -> DataFrame:
    """Drop the first `days` days after `start`, by default after the first instant of each series."""
    if start is not None:
        return df.where(F.col(spec.ts) >= _ntz(start + timedelta(days=days)))
    with_first = attach_stats(df, spec, {"_first": F.min(spec.ts)})
    return with_first.where(F.col(spec.ts) >= F.col("_first") + interval(timedelta(days=days))).drop("_first")


def exclude_intervals(df: DataFrame, col: str, intervals: Sequence[tuple[datetime, datetime]]) -> DataFrame:
    """Drop rows inside any of the closed intervals; a row without a time is dropped too."""
    return df.where(reduce(lambda a, b: a & b, (~F.col(col).between(_ntz(a), _ntz(b)) for a, b in intervals)))


def holdout_mask(df: DataFrame, spec: SeriesSpec, days: int = 90, out: str = "is_val") -> DataFrame:
    """Flag the last `days` days of each series."""
    with_last = attach_stats(df, spec, {"_last": F.max(spec.ts)})
    return with_last.withColumn(out, F.col(spec.ts) >= F.col("_last") - interval(timedelta(days=days))).drop("_last")


def expanding_folds(
    df: DataFrame, spec: SeriesSpec, splits: Sequence[datetime], horizon_days: int = 90
) -> DataFrame:
    """One row per (fold, role) a row belongs to: `fit` before the split, `val` within the horizon after it.

    The folds are a short literal list, so this is a projection with an explode: no join, no shuffle.
    """
    t = F.col(spec.ts)
    roles = []
    for i, at in enumerate(splits):
        end = at + timedelta(days=horizon_days)
        role = F.when(t < _ntz(at), "fit").when(t < _ntz(end), "val")
        roles.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    member = F.filter(F.array(*roles), lambda r: r["role"].isNotNull())
    return df.withColumn("_m", F.explode(member)).select("*", "_m.fold", "_m.role").drop("_m")
