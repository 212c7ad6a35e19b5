"""Daily statistics and the fixed daily-window features built from them.

Everything is computed on one small table, a row per series and day, and joined to the rows once by day.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadspark.functions.columns import variation
from loadspark.operators.rolling import rolling
from loadspark.series import SeriesSpec

DAY = "_day"
# The variables that get lag features.
LAG_VARIABLES = ["load", "sion_measured_temperature", "sion_measured_global_radiation", "solar_remote"]
DAILY = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}


def daily_stats(df: DataFrame, spec: SeriesSpec, variables: Sequence[str], day: str = "day") -> DataFrame:
    """Daily min, max, mean and sample deviation: `{var}_daily_{stat}`; a one-row day has no deviation."""
    return df.groupBy(*spec.keys, F.to_date(spec.ts).alias(day)).agg(
        *(fn(v).alias(f"{v}_daily_{s}") for v in variables for s, fn in DAILY.items())
    )


def _days_before(spec: SeriesSpec, k: int):
    """The frame holding exactly the day `k` days earlier, if that day exists."""
    return W.partitionBy(*spec.keys).orderBy(F.unix_date(DAY)).rangeBetween(-k, -k)


def lag_table(
    df: DataFrame, spec: SeriesSpec, variables: Sequence[str], days: Sequence[int] = (2, 3), week: int = 7, week_end: int = 2
) -> DataFrame:
    """All lag features per day. A task sees one series' days, never its rows."""
    daily = daily_stats(df, spec, variables, DAY)
    last_days = W.partitionBy(*spec.keys).orderBy(DAY).rowsBetween(-(week - 1), 0)
    weekly: dict[str, Column] = {}
    for v in variables:
        for s in ("min", "max", "mean"):
            weekly[f"_w_{v}_{s}"] = F.avg(f"{v}_daily_{s}").over(last_days)
        weekly[f"_w_{v}_std"] = F.stddev_samp(f"{v}_daily_mean").over(last_days)
    daily = daily.withColumns(weekly)

    out: dict[str, Column] = {}
    for v in variables:
        for s in DAILY:
            for k in days:
                out[f"{v}_{s}_{k}d"] = F.max(f"{v}_daily_{s}").over(_days_before(spec, k))
            out[f"{v}_week_{s}"] = F.max(f"_w_{v}_{s}").over(_days_before(spec, week_end))
    lagged = daily.select(*spec.keys, DAY, *(c.alias(n) for n, c in out.items()))
    ratios: dict[str, Column] = {}
    for v in variables:
        for k in days:
            ratios[f"{v}_cv_{k}d"] = variation(F.col(f"{v}_std_{k}d"), F.col(f"{v}_mean_{k}d"))
        ratios[f"{v}_cv_week"] = variation(F.col(f"{v}_week_std"), F.col(f"{v}_week_mean"))
    return lagged.withColumns(ratios)


def add_lag_features(
    df: DataFrame,
    spec: SeriesSpec,
    variables: Sequence[str] = tuple(LAG_VARIABLES),
    days: Sequence[int] = (2, 3),
    week: int = 7,
    week_end: int = 2,
) -> DataFrame:
    """Statistics of whole earlier days, the same for all rows of a day: 15 columns per variable.

    `{var}_{min,max,mean,std,cv}_{k}d` describe day D-k. `{var}_week_*` average the daily values of the `week`
    present days that end at D-`week_end`; `week_std` is the deviation of their daily means.
    """
    return join_daily(df, spec, [lag_table(df, spec, variables, days, week, week_end)])


def join_daily(df: DataFrame, spec: SeriesSpec, tables: Sequence[DataFrame]) -> DataFrame:
    """Add the columns of per-day tables to the rows of each day; the rows are joined once, whatever the tables."""
    by = [*spec.keys, DAY]
    daily = reduce(lambda a, b: a.join(b, by, "full"), tables)
    return df.withColumn(DAY, F.to_date(spec.ts)).join(daily, by, "left").drop(DAY)


def daily_yield(
    df: DataFrame, spec: SeriesSpec, prod: str, ghi: str, threshold: float = 200.0, day: str = "day"
) -> DataFrame:
    """Daily production over daily irradiance on bright rows; null on a day without one."""
    bright = F.col(ghi) > threshold
    made = F.coalesce(F.sum(F.when(bright, F.col(prod))), F.lit(0.0))
    return df.groupBy(*spec.keys, F.to_date(spec.ts).alias(day)).agg(
        F.try_divide(made, F.sum(F.when(bright, F.col(ghi)))).alias("daily_yield_ratio")
    )


def add_yield_ratio(
    df: DataFrame,
    spec: SeriesSpec,
    prod: str = "solar_remote",
    ghi: str = "sion_forecast_global_radiation",
    threshold: float = 200.0,
    window_days: int = 30,
    mode: str = "days",
    out: str = "solar_remote_yield_ratio",
) -> DataFrame:
    """Past mean of the daily yield ratio.

    `days`: over the `window_days` calendar days that end at D-2, on the daily table. `rows`: the daily ratio put
    back on the rows, moved 2 rows and averaged over `window_days` rows.
    """
    if mode == "days":
        return join_daily(df, spec, [yield_table(df, spec, prod, ghi, threshold, window_days, out)])
    joined = join_daily(df, spec, [daily_yield(df, spec, prod, ghi, threshold, DAY)])
    return rolling(joined, spec, "daily_yield_ratio", window_days, "mean", min_samples=1, out=out, shift=2).drop(
        "daily_yield_ratio"
    )


def yield_table(
    df: DataFrame, spec: SeriesSpec, prod: str, ghi: str, threshold: float = 200.0, window_days: int = 30, out: str = "yield"
) -> DataFrame:
    """Per day, the mean daily yield ratio of the `window_days` calendar days that end at D-2."""
    past = W.partitionBy(*spec.keys).orderBy(F.unix_date(DAY)).rangeBetween(-(window_days + 1), -2)
    daily = daily_yield(df, spec, prod, ghi, threshold, DAY)
    return daily.select(*spec.keys, DAY, F.avg("daily_yield_ratio").over(past).alias(out))


def mean_over_days(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], day: str = "day") -> DataFrame:
    """Daily mean of several columns."""
    return df.groupBy(*spec.keys, F.to_date(spec.ts).alias(day)).agg(*(F.avg(c).alias(c) for c in cols))
