"""Profiles, correlations and mutual information."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from loadspark.functions.columns import scaled_corr
from loadspark.operators.reshape import normalise, to_long
from loadspark.series import SeriesSpec, attach_stats, interval, with_row_index
from loadspark.session import materialise


def profile_mean(df: DataFrame, by: Mapping[str, Column] | Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean of `cols` by any grouping, such as hour, weekday, or month and hour."""
    groups = [c.alias(n) for n, c in by.items()] if isinstance(by, Mapping) else [F.col(c) for c in by]
    return df.groupBy(*groups).agg(*(F.avg(c).alias(c) for c in cols))


def calendar_summary(df: DataFrame, ts: str = "local_timestamp") -> DataFrame:
    """Number of weekend days, holidays and working days among the days present."""
    flags = {"weekend_days": "local_is_weekend", "holidays": "local_is_holiday", "working_days": "local_is_working_day"}
    days = df.groupBy(F.to_date(ts).alias("_day")).agg(*(F.bool_or(c).alias(n) for n, c in flags.items()))
    return days.agg(*(F.count_if(n).alias(n) for n in flags))


def day_type_profile(
    df: DataFrame, flags: Mapping[str, Column], col: str = "load", hour: str = "local_hour"
) -> DataFrame:
    """Mean and deviation by hour and day type; a row counts in every type whose flag is true."""
    types = F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))
    rows = df.select(hour, col, F.explode(F.filter(types, lambda t: t.isNotNull())).alias("day_type"))
    return rows.groupBy(hour, "day_type").agg(F.avg(col).alias(f"mean_{col}"), F.stddev_samp(col).alias(f"std_{col}"))


def standard_day_types() -> dict[str, Column]:
    weekend, working = F.col("local_is_weekend"), F.col("local_is_working_day")
    return {
        "Holiday": F.col("local_is_holiday"),
        "Not working day": ~working,
        "Weekday": ~weekend,
        "Weekend": weekend,
        "Working day": working,
    }


def corr_table(
    df: DataFrame,
    features: Sequence[str],
    target: str = "load",
    scaled: bool = True,
    by: Sequence[str] = (),
    digits: int | None = 3,
) -> DataFrame:
    """Correlation of every feature with the target: one aggregation, then one row per feature (and group).

    `scaled` divides the population covariance by sample deviations; otherwise it is Pearson's r. Sort at the sink.
    """
    y = F.col(target)
    fn = scaled_corr if scaled else F.corr
    wide = df.groupBy(*by).agg(*(fn(F.col(f), y).alias(f) for f in features))
    long = to_long(wide, by, features, "feature", "pearson_r")
    return long if digits is None else long.withColumn("pearson_r", F.round("pearson_r", digits))


def lag_autocorr(
    df: DataFrame,
    spec: SeriesSpec,
    col: str = "load",
    days: Sequence[int] = (2, 3, 4, 5, 6, 7),
    weekend: str = "local_is_weekend",
    mode: str = "rows",
    digits: int = 4,
) -> DataFrame:
    """Correlation with the value k days earlier, over all rows, weekdays and weekends.

    The past side is repeated once per lag and met in a single join on the row number (or instant).
    """
    kept = df.select(*spec.keys, spec.ts, *spec.tie, col, weekend)
    place = "_at"
    if mode == "rows":
        now = materialise(with_row_index(kept, spec, place))
        ahead = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(place) + k * spec.rows_per_day).alias("at")) for k in days)))
    else:
        now = kept.withColumn(place, F.col(spec.ts))
        ahead = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(place) + interval(timedelta(days=k))).alias("at")) for k in days)))
    past = now.select(*spec.keys, F.col(col).alias("_past"), ahead.alias("_a")).select(
        *spec.keys, "_past", F.col("_a.k").alias("lag_days"), F.col("_a.at").alias(place)
    )
    x, y, off = F.col(col), F.col("_past"), F.col(weekend)
    return (
        now.join(past, [*spec.keys, place])
        .groupBy(*spec.keys, "lag_days")
        .agg(
            F.round(F.corr(x, y), digits).alias("all"),
            F.round(F.corr(F.when(~off, x), F.when(~off, y)), digits).alias("weekday"),
            F.round(F.corr(F.when(off, x), F.when(off, y)), digits).alias("weekend"),
        )
    )


def binned_mi(df: DataFrame, features: Sequence[str], target: str, bins: int = 32) -> DataFrame:
    """Mutual information (nats) of each feature with the target over equal-width bins.

    Bin edges come from one pass of minima and maxima; the joint histogram has at most bins^2 cells per feature and
    is pre-aggregated before its shuffle, so its size does not depend on the data.
    """
    cols = [*features, target]
    full = df.select(*cols).where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in cols))
    stats = {f"_{fn}_{c}": getattr(F, fn)(c) for c in cols for fn in ("min", "max")}
    ranged = attach_stats(full, SeriesSpec(), stats)

    def bin_of(c: str) -> Column:
        low, width = F.col(f"_min_{c}"), F.col(f"_max_{c}") - F.col(f"_min_{c}")
        place = F.floor((F.col(c) - low) / width * bins).cast("int")
        return F.when(width > 0, F.when(place >= bins, bins - 1).otherwise(place)).otherwise(0)

    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), bin_of(f).alias("x")) for f in features))
    joint = (
        ranged.select(F.explode(pairs).alias("p"), bin_of(target).alias("y"))
        .groupBy("p.feature", "p.x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return mutual_information(joint)


def mutual_information(joint: DataFrame) -> DataFrame:
    """Sum of p_xy ln(p_xy / (p_x p_y)) per feature, from counts (feature, x, y, n)."""
    px = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    py = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("nt"))
    cells = joint.join(px, ["feature", "x"]).join(py, ["feature", "y"]).join(total, "feature")
    p = F.col("n") / F.col("nt")
    term = p * F.ln(F.col("n") * F.col("nt") / (F.col("nx") * F.col("ny")))
    return cells.groupBy("feature").agg(F.sum(term).alias("importance"))


def importance_share(importance: DataFrame, k: int = 15) -> DataFrame:
    """The `k` most important features as a percentage of the largest."""
    top = importance.orderBy(F.desc("importance"), "feature").limit(k)
    best = top.agg(F.max("importance").alias("m")).scalar()
    return top.withColumn("importance_norm", F.try_divide(F.col("importance"), best) * 100)


def efficiency_profile(
    df: DataFrame, spec: SeriesSpec, production: Sequence[str], ghi: str, threshold: float = 50.0
) -> DataFrame:
    """Production per irradiance by hour of day on daylight rows, relative to each station's own mean."""
    ratios = {c: F.try_divide(F.col(c), F.col(ghi)) for c in production}
    bright = df.where(F.col(ghi) > threshold).select(F.hour(spec.ts).alias("hour"), *(r.alias(c) for c, r in ratios.items()))
    hourly = profile_mean(normalise(bright, production, "mean", SeriesSpec(ts="hour")), ["hour"], production)
    return to_long(hourly, ["hour"], production, "station", "normalised_ratio")


def production_profile(
    df: DataFrame, spec: SeriesSpec, production: Sequence[str], ghi: str, threshold: float = 50.0
) -> DataFrame:
    """Mean production by hour of day on daylight rows, scaled to [0, 1] per station."""
    hourly = profile_mean(df.where(F.col(ghi) > threshold), {"hour": F.hour(spec.ts)}, production)
    return to_long(
        normalise(hourly, production, "minmax", SeriesSpec(ts="hour")), ["hour"], production, "station", "normalised_production"
    )


def ghi_correlation(
    df: DataFrame, production: Sequence[str], ghi: str, threshold: float = 50.0, net: Sequence[str] = ("solar_remote",)
) -> DataFrame:
    """Pearson correlation of each station with irradiance on daylight rows, and what kind of meter it is."""
    table = corr_table(df.where(F.col(ghi) > threshold), production, ghi, scaled=False, digits=None)
    kind = F.when(F.col("feature").isin(*net), "Prosumer (net?)").otherwise("Utility-scale (gross)")
    return table.select(F.col("feature").alias("station"), "pearson_r", kind.alias("type"))
