"""Words, seeded order and order totals that never put one key into one task."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that share an order bucket at least, on average; a bucket is what one sort holds together.
BUCKET_ROWS = 512


def clean_text(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    """Whitespace-separated words in order; none for a null or blank text."""
    return F.filter(F.split(clean_text(text), SPACE, -1), lambda w: w != "")


def seeded_order(seed: int, *columns: str) -> Column:
    """A 60-bit position that shuffles rows: the same for the same values and seed, in any engine with md5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def seeded_order_sql(seed: int, *columns: str) -> str:
    parts = " || ':' || ".join(f"coalesce(cast({c} AS VARCHAR), '')" for c in columns)
    return f"('0x' || substr(md5('{seed}:' || {parts}), 1, 15))::BIGINT"


def order_shift(rows: int, bits: int) -> int:
    """How far to shift a `bits`-bit position right so that a bucket holds max(BUCKET_ROWS, sqrt(rows)) rows on average.

    Both the rows of one bucket and the number of buckets then stay small beside the table.
    """
    buckets = max(1, rows // max(BUCKET_ROWS, isqrt(rows)))
    return bits - min(bits, buckets.bit_length() - 1)


def totals_before(
    df: DataFrame,
    group: list[str],
    bucket: str,
    order: list[str],
    sums: dict[str, Column],
    whole: dict[str, str] | None = None,
) -> DataFrame:
    """Add, per row, what all earlier rows of its group sum up to; `whole` names sums over the whole group.

    `bucket` must not fall along `order`. Rows move by (group, bucket), so a group that holds a third of the table is
    spread over its buckets; between buckets only one row of sums travels. `df` is read twice: store it if it is costly.
    Null keys form a group of their own.
    """
    temp = {name: f"__sum_{i}" for i, name in enumerate(sums)}
    keys = [*group, bucket]
    parts = df.groupBy(*keys).agg(*(F.sum(e).alias(temp[n]) for n, e in sums.items()))
    all_of = Window.partitionBy(*group)
    earlier = all_of.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *(F.col(k).alias(f"__key_{k}") for k in keys),
        *(F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"{t}_off") for t in temp.values()),
        *(F.sum(temp[n]).over(all_of).alias(f"__whole_{w}") for w, n in (whole or {}).items()),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select("*", *(F.coalesce(F.sum(e).over(inside), F.lit(0)).alias(temp[n]) for n, e in sums.items()))
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(offsets[f"__key_{k}"])
    return rows.join(offsets, on).select(
        *(rows[c] for c in df.columns),
        *((rows[t] + offsets[f"{t}_off"]).alias(n) for n, t in temp.items()),
        *(offsets[f"__whole_{w}"].alias(w) for w in whole or {}),
    )
