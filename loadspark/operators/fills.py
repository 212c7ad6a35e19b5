"""Carrying known values over gaps, forward and backward, without putting a series into one task."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadspark.series import BUCKET, SeriesSpec, epoch_seconds, with_blocks


def _nearest_known(
    df: DataFrame, spec: SeriesSpec, cols: Sequence[str], directions: Sequence[str], with_instant: bool
) -> DataFrame:
    """Add `_prev_{c}` / `_next_{c}`: the nearest known value at or before / at or after each row with an instant.

    Buckets are filled on their own; a value carried in from another bucket comes from one row per bucket.
    """
    d = with_blocks(df, spec)
    by = spec.bucket_keys
    inside = {
        "prev": (F.last, W.partitionBy(*by).orderBy(*spec.order).rowsBetween(W.unboundedPreceding, 0)),
        "next": (F.first, W.partitionBy(*by).orderBy(*spec.order).rowsBetween(0, W.unboundedFollowing)),
    }
    beyond = {
        "prev": (F.last, W.partitionBy(*spec.keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)),
        "next": (F.first, W.partitionBy(*spec.keys).orderBy(BUCKET).rowsBetween(1, W.unboundedFollowing)),
    }
    edge = {"prev": F.max_by, "next": F.min_by}

    # What is carried for a column: its value, and when asked the instant it was known at.
    carried: dict[str, tuple[Column, str]] = {}
    for c in cols:
        carried[c] = (F.col(c), c)
        if with_instant:
            carried[f"{c}_at"] = (F.when(F.col(c).isNotNull(), F.col(spec.ts)), c)

    filled = d.withColumns(
        {
            f"_{side}_{n}": inside[side][0](value, ignorenulls=True).over(inside[side][1])
            for side in directions
            for n, (value, _) in carried.items()
        }
    )
    if spec.bucket_rows is None:
        return filled.drop(BUCKET)
    edges = d.where(F.col(BUCKET).isNotNull()).groupBy(*by).agg(
        *(
            edge[side](value, F.when(F.col(c).isNotNull(), spec.order_value)).alias(f"_e_{side}_{n}")
            for side in directions
            for n, (value, c) in carried.items()
        )
    )
    carry = edges.select(
        *by,
        *(
            beyond[side][0](f"_e_{side}_{n}", ignorenulls=True).over(beyond[side][1]).alias(f"_c_{side}_{n}")
            for side in directions
            for n in carried
        ),
    )
    names = [f"{side}_{n}" for side in directions for n in carried]
    return (
        filled.join(carry, by, "left")
        .withColumns({f"_{n}": F.coalesce(F.col(f"_{n}"), F.col(f"_c_{n}")) for n in names})
        .drop(BUCKET, *(f"_c_{n}" for n in names))
    )


def _fill(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], sides: Sequence[str], max_gap: timedelta | None) -> DataFrame:
    order = list(df.columns)
    near = _nearest_known(df, spec, cols, sides, max_gap is not None)

    def candidate(side: str, c: str) -> Column:
        if max_gap is None:
            return F.when(F.col(spec.ts).isNotNull(), F.col(f"_{side}_{c}"))
        away = F.abs(epoch_seconds(F.col(spec.ts)) - epoch_seconds(F.col(f"_{side}_{c}_at")))
        return F.when(away <= int(max_gap.total_seconds()), F.col(f"_{side}_{c}"))

    return near.withColumns(
        {c: F.coalesce(F.col(c), *(candidate(side, c) for side in sides)) for c in cols}
    ).select(*order)


def forward_fill(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], max_gap: timedelta | None = None) -> DataFrame:
    """Replace null by the last known value of the series, at most `max_gap` old."""
    return _fill(df, spec, cols, ["prev"], max_gap)


def backward_fill(df: DataFrame, spec: SeriesSpec, cols: Sequence[str], max_gap: timedelta | None = None) -> DataFrame:
    """Replace null by the next known value of the series, at most `max_gap` away."""
    return _fill(df, spec, cols, ["next"], max_gap)


def fill_both(
    df: DataFrame, spec: SeriesSpec, cols: Sequence[str], first: str = "backward", max_gap: timedelta | None = None
) -> DataFrame:
    """Fill in one direction, then what is left in the other; one pass serves both."""
    sides = ["next", "prev"] if first == "backward" else ["prev", "next"]
    return _fill(df, spec, cols, sides, max_gap)
