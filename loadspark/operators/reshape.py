"""Names, projections, reshaping and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loadspark.functions.columns import sum_horizontal
from loadspark.series import SeriesSpec, attach_stats, rows_at, with_row_index

# Raw and clean column names of the energy table.
ENERGY_NAMES = {
    "standardised load [-]": "load",
    "standardised forecast load [-]": "forecast_load",
    "central valais solar production [kWh]": "solar_central_valais",
    "sion area solar production [kWh]": "solar_sion",
    "sierre area production [kWh]": "solar_sierre",
    "remote solar production [kWh]": "solar_remote",
}
# Raw and clean names of forecast and measured weather variables.
FORECAST_NAMES = {
    "PRED_T_2M_ctrl": "forecast_temperature",
    "PRED_GLOB_ctrl": "forecast_global_radiation",
    "PRED_TOT_PREC_ctrl": "forecast_precipitation",
    "PRED_RELHUM_2M_ctrl": "forecast_humidity",
    "PRED_DURSUN_ctrl": "forecast_sunshine_duration",
}
MEASUREMENT_NAMES = {
    "Air temperature 2m above ground (current value)": "measured_temperature",
    "Global radiation (ten minutes mean)": "measured_global_radiation",
    "Precipitation (ten minutes total)": "measured_precipitation",
    "Relative air humidity 2m above ground (current value)": "measured_humidity",
    "Sunshine duration (ten minutes total)": "measured_sunshine_duration",
}
# Weather stations.
STATIONS = ["sion", "evionnaz", "evolene", "montana", "visp", "basel", "bern", "geneve", "pully", "zurich"]
SOLAR_COLUMNS = ["solar_central_valais", "solar_sion", "solar_sierre", "solar_remote"]
NON_FEATURES = ["utc_timestamp", "local_timestamp", "load", "forecast_load", *SOLAR_COLUMNS]


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def drop_by_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.endswith(suffix)))


def drop_matching(df: DataFrame, prefixes: Sequence[str] = (), parts: Sequence[str] = ()) -> DataFrame:
    """Drop helper columns by name prefix or by a substring."""
    gone = [c for c in df.columns if c.startswith(tuple(prefixes)) or any(p in c for p in parts)]
    return df.drop(*gone)


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    return df.select(*first, *(c for c in df.columns if c not in first))


def rename_weather(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Forecast names, pivot artefacts dropped, columns in a fixed order."""
    return drop_by_suffix(rename_map(df, FORECAST_NAMES), "_0").select(ts, *FORECAST_NAMES.values())


def model_features(df: DataFrame, exclude: Sequence[str] | None = None) -> list[str]:
    """All columns but targets, timestamps, raw solar and raw measured weather; read from the schema only."""
    if exclude is None:
        raw = [f"{s}_{v}" for s in STATIONS for v in MEASUREMENT_NAMES.values()]
        exclude = [*NON_FEATURES, *raw]
    gone = set(exclude)
    return [c for c in df.columns if c not in gone]


# Categories of feature names and the pattern of each; the first that fits counts.
CATEGORIES = {
    "Cyclical": r"^utc_(sin|cos)_",
    "Lag": r"_(min|max|mean|std|cv)_(2d|3d)$|_week_(min|max|mean|std)$|_cv_week$",
    "Weather forecast": r"_forecast_",
    "Weather measurement": r"_measured_",
    "Solar capacity": r"^(poa_irradiance|solar_yield_30d|solar_remote_yield_ratio)$|solar_capacity",
    "Solar production": r"^solar_",
    "Temporal": r"^local_",
}


def categorise_features(features: DataFrame, name: str = "feature") -> DataFrame:
    """Add the category of each feature name."""
    fits = (F.when(F.col(name).rlike(pattern), F.lit(label)) for label, pattern in CATEGORIES.items())
    return features.withColumn("category", F.coalesce(*fits, F.lit("Other")))


def pairwise_delta(df: DataFrame, home: str, others: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Home station minus every other station, per variable, in one projection."""
    return df.withColumns(
        {
            f"delta_{v}_{o}": F.col(f"{home}_forecast_{v}") - F.col(f"{o}_forecast_{v}")
            for v in variables
            for o in others
        }
    )


def normalise(
    df: DataFrame, cols: Sequence[str], how: str = "max", spec: SeriesSpec | None = None, of: DataFrame | None = None
) -> DataFrame:
    """Scale columns by statistics of the whole series.

    `max`: by the column maximum, 0 where that is not positive. `total_max`: null as 0, by the largest row sum of
    `cols`, or by 1 where that is not positive. `minmax`: to [0, 1], 0 for a flat column. `mean`: by a positive mean.
    `of` takes the statistics from another DataFrame, as for a filtered view scaled by the full table.
    """
    spec = spec or SeriesSpec()
    if how == "total_max":
        df2 = attach_stats(df, spec, {"_top": F.max(sum_horizontal(cols))}, of)
        top = F.when(F.col("_top") > 0, F.col("_top")).otherwise(F.lit(1.0))
        return df2.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) / top for c in cols}).drop("_top")
    wanted = {"max": ("max",), "minmax": ("min", "max"), "mean": ("avg",)}[how]
    stats = {f"_{fn}_{c}": getattr(F, fn)(c) for c in cols for fn in wanted}

    def scaled(c: str) -> Column:
        x, zero = F.col(c), F.lit(0.0)
        if how == "max":
            top = F.col(f"_max_{c}")
            return F.when(top > 0, x / top).otherwise(zero)
        if how == "minmax":
            low, width = F.col(f"_min_{c}"), F.col(f"_max_{c}") - F.col(f"_min_{c}")
            return F.when(width != 0, (x - low) / width).otherwise(zero)
        mean = F.col(f"_avg_{c}")
        return F.when(mean > 0, x / mean).otherwise(x)

    return attach_stats(df, spec, stats, of).withColumns({c: scaled(c) for c in cols}).drop(*stats)


def sample_n(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """At most `n` rows, the same ones on every run and in any engine with md5: the smallest digests of seed and `key`."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)))
    return df.orderBy(digest, *key).limit(n)


def slice_rows(df: DataFrame, spec: SeriesSpec, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows `start` to `stop` (not included) of each series in time order; negative positions count from its end.

    Without keys the two rows at the ends are searched by counting and all others compared with them, so none is numbered.
    With keys, rows are numbered. Rows without an instant have no position. `tie` should tell rows of one instant apart.
    """
    timed = df.where(F.col(spec.ts).isNotNull())
    if spec.keys:
        numbered = with_row_index(timed, spec, "_idx")
        if start < 0 or (stop or 0) < 0:
            numbered = attach_stats(numbered, spec, {"_rows": F.count(F.lit(1))})
        else:
            numbered = numbered.withColumn("_rows", F.lit(0))

        def at(p: int) -> Column:
            return F.lit(p) if p >= 0 else F.col("_rows") + p

        inside = F.col("_idx") >= at(start)
        inside = inside if stop is None else inside & (F.col("_idx") < at(stop))
        return numbered.where(inside).drop("_idx", "_rows")
    order = [spec.ts, *spec.tie]
    n = timed.count()
    first, end, _ = slice(start, stop).indices(n)
    if first >= end:
        return df.limit(0)
    ends = rows_at(timed, order, sorted({first, end - 1}))
    place = F.struct(*order)

    def literal(p: int) -> Column:
        return F.struct(*(F.lit(ends[p][c]).cast(df.schema[c].dataType).alias(c) for c in order))

    return timed.where((place >= literal(first)) & (place <= literal(end - 1)))


def every_nth(df: DataFrame, spec: SeriesSpec, n: int, head: int | None = None) -> DataFrame:
    """Every n-th row of each series in time order, and of those only the first `head` if given."""
    indexed = with_row_index(df, spec, "_idx")
    keep = F.col("_idx") % n == 0
    if head is not None:
        keep = keep & (F.col("_idx") < n * head)
    return indexed.where(keep).drop("_idx")


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "variable", val: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), var, val)


def to_wide(
    df: DataFrame,
    by: Sequence[str],
    name_col: str,
    value_col: str,
    names: Mapping[str, str] | Sequence[str],
    on_duplicate: str = "error",
) -> DataFrame:
    """One column per name. Two rows for one cell, nulls too, fail the query, unless `on_duplicate` names an aggregate.

    `names` is the list of names to expect (so no pass looks them up), or a map from name to column name.
    """
    if on_duplicate == "error":
        message = F.concat(F.lit("more than one value for "), F.any_value(F.col(name_col)))
        cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(message).cast("double")).otherwise(F.max(value_col))
    else:
        cell = getattr(F, on_duplicate)(value_col)
    wide = df.groupBy(*by).pivot(name_col, list(names)).agg(cell)
    return wide.withColumnsRenamed(dict(names)) if isinstance(names, Mapping) else wide


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """The `k` rows with the largest `col` (a TakeOrderedAndProject); equal rows by their other columns, NaN as null."""
    top = F.col(col)
    if df.schema[col].dataType.typeName() in ("double", "float"):
        top = F.when(~F.isnan(top), top)
    ties = [f.name for f in df.schema.fields if f.name != col and f.dataType.typeName() != "map"]
    return df.orderBy(top.desc_nulls_last(), *ties).limit(k)
