"""Clipping, null handling and column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from loadspark.functions.columns import clip_at, nan_as_null
from loadspark.operators.fills import forward_fill
from loadspark.series import SeriesSpec

# Forecast variables that cannot be negative.
CLIP_SUFFIXES = (
    "forecast_global_radiation",
    "forecast_precipitation",
    "forecast_humidity",
    "forecast_sunshine_duration",
)


def _floats(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def clip_lower(df: DataFrame, cols: Sequence[str], bound: float = 0.0) -> DataFrame:
    return df.withColumns({c: clip_at(F.col(c), bound) for c in cols}) if cols else df


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = _floats(df) if cols is None else cols
    return df.withColumns({c: nan_as_null(F.col(c)) for c in cols}) if cols else df


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without a null; unlike `dropna`, NaN stays."""
    return df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (cols or df.columns))))


def clean(
    df: DataFrame, spec: SeriesSpec, clip_cols: Sequence[str] | None = None, max_gap: timedelta | None = None
) -> DataFrame:
    """Clip forecasts at zero, carry values forward, drop the rows at the start that stay incomplete."""
    if clip_cols is None:
        clip_cols = [c for c in df.columns if c.endswith(CLIP_SUFFIXES)]
    clock = {spec.ts, *spec.keys, *spec.tie}
    filled = forward_fill(clip_lower(df, clip_cols), spec, [c for c in df.columns if c not in clock], max_gap)
    return drop_null_rows(filled)


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: nulls, empty strings, negatives, smallest and largest value, null share and its severity.

    One aggregation over the table; its single row is then turned into one row per column.
    """
    per_column = []
    for f in df.schema.fields:
        c = F.col(f.name)
        text = isinstance(f.dataType, T.StringType)
        number = isinstance(f.dataType, T.NumericType)
        per_column.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.count_if(c.isNull()).alias("null_count"),
                (F.count_if(c == "") if text else F.lit(0).cast("long")).alias("empty_count"),
                (F.count_if(c < 0) if number else F.lit(0).cast("long")).alias("negative_count"),
                F.min(c).cast("string").alias("min_value"),
                F.max(c).cast("string").alias("max_value"),
                F.count(F.lit(1)).alias("rows"),
            )
        )
    stats = df.agg(F.array(*per_column).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    share = F.try_divide(F.col("null_count"), F.col("rows")) * 100
    return stats.select(
        "column",
        "null_count",
        "empty_count",
        "negative_count",
        "min_value",
        "max_value",
        F.round(share, 1).alias("null_pct"),
        F.when(share > 10, "high (>10%)").when(share > 1, "medium (1-10%)").otherwise("low (<1%)").alias("severity"),
    )


def cells_filled(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many null cells cleaning removed (by filling or by dropping rows), as one row."""

    def nulls(df: DataFrame):
        return F.coalesce(sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)), F.lit(0))

    left = after.agg(nulls(after).alias("n")).scalar()
    return before.agg(nulls(before).alias("_n")).select((F.col("_n") - left).cast("long").alias("cells_filled"))
