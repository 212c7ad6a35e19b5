"""Row shifts, rolling frames and change detection over long series.

A rolling frame needs the rows just before each block. Rows are numbered, cut into blocks several windows long,
and each row is also copied into the next block while a window there can still see it (the halo). Every block then
works alone, and only rows a block owns are kept. A block is at least four windows long, so copies stay under a
quarter of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from loadspark.series import SELF, SeriesSpec, beside, interval, ranked, step_start, with_row_index
from loadspark.session import spread_groups

IDX, BLOCK, OWNER = "_idx", "_block", "_owner"
# Columns of a rolling pass: first row of a block, row of its own block, rolled values.
FIRST, OWN, SOURCE = "_first", "_own", "_of_"
# Up to this many rows a window frame in the JVM beats sending the column to Python.
FRAME_ROWS = 256


@dataclass(frozen=True)
class Roll:
    """One rolling column: `fn` is mean, std, median or quantile (with `q`)."""

    col: str
    out: str
    fn: str = "mean"
    q: float | None = None
    interpolation: str = "linear"


def _block_rows(spec: SeriesSpec, reach: int) -> int:
    return max(4 * reach, spec.bucket_rows or 0, 1)


def _with_halo(indexed: DataFrame, spec: SeriesSpec, reach: int) -> DataFrame:
    size = _block_rows(spec, reach)
    return (
        indexed.withColumn(OWNER, F.expr(f"{IDX} div {size}"))
        .withColumn(BLOCK, F.explode_outer(F.expr(f"sequence({OWNER}, ({IDX} + {reach}) div {size})")))
        .where(F.col(IDX).isNotNull() | F.col(BLOCK).isNull())
    )


def _finite(col: str) -> Column:
    """The value where it is a finite number, else null: NaN and infinities count as missing for any window length."""
    v = F.col(col).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _frame(r: Roll, frame, min_samples: int) -> Column:
    fn = {"mean": F.avg, "std": F.stddev_samp}[r.fn]
    v = _finite(r.col)
    return F.when(F.count(v).over(frame) >= min_samples, fn(v).over(frame))


def _roll_block(rolls: Sequence[Roll], n: int, min_samples: int, shift: int, keep: list[str]):
    """The function of one task: pandas rolling over sorted blocks, halo rows dropped at the end.

    Blocks lie one after the other. Each batch is rolled at once, its windows ending at the edges of their blocks; the rows of
    its last block, which may go on, wait for the next batch.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Blocks(BaseIndexer):
            """Windows that begin no earlier than the block of their row."""

            def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
                end = np.maximum(np.arange(1, num_values + 1) - shift, self.begin)
                return np.maximum(end - n, self.begin), end

        def rolled(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            at = np.append(starts, rows.num_rows)
            begin = np.repeat(at[:-1], np.diff(at))
            out = rows.select(keep)
            for r in rolls:
                values = pd.Series(rows.column(SOURCE + r.col).to_numpy())
                window = values.rolling(Blocks(window_size=n, begin=begin), min_periods=min_samples)
                if r.fn == "median":
                    got = window.median()
                elif r.fn == "quantile":
                    got = window.quantile(r.q, interpolation=r.interpolation)
                else:
                    got = getattr(window, r.fn)()
                out = out.append_column(r.out, pa.array(got.to_numpy(), pa.float64(), from_pandas=True))
            yield from out.filter(rows.column(OWN)).combine_chunks().to_batches()

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            last = np.flatnonzero(batch.column(FIRST).to_numpy(zero_copy_only=False))
            waiting.append(batch)
            if not len(last) or (len(waiting) == 1 and last[-1] == 0):
                continue
            rows = pa.Table.from_batches(waiting)
            starts = np.flatnonzero(rows.column(FIRST).to_numpy())
            yield from rolled(rows.slice(0, starts[-1]), starts[:-1])
            waiting = rows.slice(starts[-1]).to_batches()
        if waiting:
            rows = pa.Table.from_batches(waiting)
            yield from rolled(rows, np.flatnonzero(rows.column(FIRST).to_numpy()))

    return apply


def rolling_many(
    df: DataFrame, spec: SeriesSpec, rolls: Iterable[Roll], n: int, min_samples: int | None = None, shift: int = 0
) -> DataFrame:
    """Rolling statistics over the last `n` rows of each series, the window ending `shift` rows back.

    A result needs `min_samples` known values (default: the whole window); nulls, NaN and infinities are not known, and
    rows without an instant take no part and get null. Rows that share an instant come in the order of `tie`, then of
    the rolled values, whatever the window length. Short means and deviations are window
    frames in the JVM; quantiles and long windows are pandas rolling over sorted blocks, all columns in one exchange.
    """
    rolls = list(rolls)
    need = n if min_samples is None else min_samples
    in_jvm = n <= FRAME_ROWS and all(r.fn in ("mean", "std") for r in rolls)
    sources = [r.col for r in rolls]
    if in_jvm:
        told, order = ranked(df, spec, sources)
        if spec.bucket_rows is None:
            timed = F.col(spec.ts).isNotNull()
            frame = W.partitionBy(*spec.keys, timed).orderBy(*order.order).rowsBetween(-(n - 1) - shift, -shift)
            return told.withColumns({r.out: F.when(timed, _frame(r, frame, need)) for r in rolls}).drop(SELF)
        frame = W.partitionBy(*spec.keys, BLOCK).orderBy(IDX).rowsBetween(-(n - 1) - shift, -shift)
        return (
            _with_halo(with_row_index(told, order, IDX), spec, n - 1 + shift)
            .withColumns({r.out: _frame(r, frame, need) for r in rolls})
            .where(F.col(OWNER).eqNullSafe(F.col(BLOCK)))
            .drop(IDX, OWNER, BLOCK, SELF)
        )

    def in_python(narrow: DataFrame, order: SeriesSpec) -> DataFrame:
        return roll_indexed(with_row_index(narrow, order, IDX), order, rolls, n, need, shift).drop(IDX)

    return beside(df, spec, sources, in_python)


def roll_indexed(
    indexed: DataFrame, spec: SeriesSpec, rolls: Sequence[Roll], n: int, need: int, shift: int = 0
) -> DataFrame:
    """Pandas rolling on rows that are already numbered (`_idx`), which pass through with all their columns.

    They are dealt by block and sorted, so that a task rolls all its blocks in a few calls whatever their number; nothing is
    joined back. Rows without a number are dealt by their content and get null.
    """
    if need > n:
        raise ValueError(f"min_samples {need} must be <= window {n}")
    keep = indexed.columns
    reach = n - 1 + shift
    size = _block_rows(spec, reach)
    numbered = F.col(IDX).isNotNull()
    blocks = _with_halo(indexed, spec, reach).drop(OWNER)
    dealt = spread_groups(blocks, *spec.keys, F.coalesce(F.col(BLOCK), F.xxhash64(*keep)))
    rows = dealt.sortWithinPartitions(*spec.keys, BLOCK, IDX).select(
        *keep,
        # Numbers have no gaps, so the first row of a block is known from its number.
        F.when(numbered, F.col(IDX) == F.greatest(F.lit(0), F.col(BLOCK) * size - reach)).otherwise(True).alias(FIRST),
        F.when(numbered, F.expr(f"{IDX} div {size}") == F.col(BLOCK)).otherwise(True).alias(OWN),
        *(F.when(numbered, _finite(c)).alias(SOURCE + c) for c in dict.fromkeys(r.col for r in rolls)),
    )
    outs = (T.StructField(r.out, T.DoubleType()) for r in rolls)
    return rows.mapInArrow(_roll_block(rolls, n, need, shift, keep), T.StructType([*indexed.schema, *outs]))


def rolling(
    df: DataFrame,
    spec: SeriesSpec,
    col: str,
    n: int,
    fn: str = "mean",
    q: float | None = None,
    min_samples: int | None = None,
    out: str | None = None,
    shift: int = 0,
    interpolation: str = "linear",
) -> DataFrame:
    name = out or f"{col}_{fn}_{n}"
    return rolling_many(df, spec, [Roll(col, name, fn, q, interpolation)], n, min_samples, shift)


def add_lag(
    df: DataFrame, spec: SeriesSpec, col: str, n: int | timedelta, mode: str = "time", out: str | None = None
) -> DataFrame:
    """The value `n` back. `time`: at exactly the instant that much earlier. `rows`: that many rows earlier.

    By time this is an equi-join whose key includes the instant, by rows a window per block, so hot series spread.
    """
    name = out or f"{col}_lag"
    if mode == "time":
        span = n if isinstance(n, timedelta) else spec.step * n
        past = df.select(*spec.keys, (F.col(spec.ts) + interval(span)).alias(spec.ts), F.col(col).alias(name))
        return df.join(past, [*spec.keys, spec.ts], "left")
    rows = int(n / spec.step) if isinstance(n, timedelta) else n
    if spec.bucket_rows is None:
        timed = F.col(spec.ts).isNotNull()
        before = F.lag(col, rows).over(W.partitionBy(*spec.keys, timed).orderBy(*spec.order))
        return df.withColumn(name, F.when(timed, before))
    blocks = _with_halo(with_row_index(df, spec, IDX), spec, rows)
    before = F.lag(col, rows).over(W.partitionBy(*spec.keys, BLOCK).orderBy(IDX))
    own = F.col(OWNER).eqNullSafe(F.col(BLOCK))
    return blocks.withColumn(name, before).where(own).drop(IDX, OWNER, BLOCK)


def add_persistence(
    df: DataFrame, spec: SeriesSpec, col: str = "load", days: int = 7, mode: str = "time", out: str | None = None
) -> DataFrame:
    """The value of the same time `days` days before."""
    n = timedelta(days=days) if mode == "time" else spec.rows_per_day * days
    return add_lag(df, spec, col, n, mode, out or f"{col}_persistence_{days}d")


def transitions(df: DataFrame, spec: SeriesSpec, flag: str) -> DataFrame:
    """Rows whose flag differs from the row before; the first row and rows next to a null flag are not changes."""
    return add_lag(df, spec, flag, 1, "rows", "_before").where(F.col(flag) != F.col("_before")).drop("_before")


def broadcast_bucket_mean(
    df: DataFrame,
    spec: SeriesSpec,
    col: str,
    unit: timedelta = timedelta(hours=1),
    offset: timedelta = timedelta(minutes=15),
    out: str | None = None,
) -> DataFrame:
    """Mean over each `unit`, repeated on its rows; units start `offset` after the full unit.

    A window group is one unit of one series: a handful of grid rows. Rows without an instant are dropped.
    """
    group = W.partitionBy(*spec.keys, "_unit")
    timed = df.withColumn("_unit", step_start(spec.ts, unit, offset))
    return timed.withColumn(out or f"{col}_hourly", F.avg(col).over(group)).drop("_unit")
