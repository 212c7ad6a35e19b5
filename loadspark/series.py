"""What a keyed time series is, and how its order is kept while its rows stay spread out.

A plain `Window.partitionBy(key).orderBy(ts)` puts a whole series into one task. Here a series is cut into time
buckets of `bucket_rows` grid steps. Work that needs order runs inside buckets; what must cross a bucket edge
(row counts, running sums, last known values) is first reduced to one row per bucket and joined back. A key that
holds a third of all rows is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

from loadspark.session import materialise, spread_groups

BUCKET, SELF, NTH = "_bucket", "_self", "_nth"
SPREAD = 32
#: Sampled rows for each block that a dense bucket is cut into, and how many blocks it may become.
SAMPLED, CUT_BITS = 32, 24
#: Counted ranges of a search for positions, and rows that are numbered at its end.
BINS, FEW = 256, 1 << 16


def epoch_seconds(col: Column) -> Column:
    """Whole seconds since 1970 of a wall-clock timestamp; does not depend on the session time zone."""
    return (
        F.unix_date(F.to_date(col)).cast("long") * 86400
        + F.hour(col) * 3600
        + F.minute(col) * 60
        + F.second(col)
    )


def interval(span: timedelta) -> Column:
    """A day-time interval literal."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(span.total_seconds()))


def floor_to(col: Column, step: timedelta, offset: timedelta = timedelta(0)) -> Column:
    """Start of the grid step an instant falls in; steps start at midnight plus `offset`."""
    size, off = int(step.total_seconds()), int(offset.total_seconds())
    start = F.floor((epoch_seconds(col) - off) / size) * size + off
    return F.timestamp_add("SECOND", start.cast("long"), F.expr("timestamp_ntz'1970-01-01'"))


def step_start(ts: str, step: timedelta, offset: timedelta = timedelta(0)) -> Column:
    """`floor_to` for a whole column, by Spark's own time windows; rows without an instant are dropped."""
    text = f"{int(step.total_seconds())} seconds"
    start = f"{int(offset.total_seconds())} seconds" if offset else None
    return F.window(ts, text, startTime=start).start


@dataclass(frozen=True)
class SeriesSpec:
    """Names the time column, the key columns and the grid of a series.

    `bucket_rows` is how many grid steps one bucket spans; None says every single series is known to fit one
    task, and plain windows per key are used. `tie` orders rows that share an instant; where it leaves rows alike, rolling
    frames and fits order them by the columns they work on. Keys must not be null; rows without an instant are kept and
    take no part.

    On its grid a series has one row a step, so buckets are bounded. Raw readings may have any number: with `most_rows`
    buckets are counted first, and those that hold more rows are cut at sampled rows into blocks of about that many.
    """

    ts: str = "utc_timestamp"
    keys: tuple[str, ...] = ()
    step: timedelta = timedelta(minutes=15)
    bucket_rows: int | None = 4096
    tie: tuple[str, ...] = ()
    most_rows: int | None = None

    @property
    def order(self) -> list[Column]:
        return [F.col(self.ts), *(F.col(t) for t in self.tie)]

    @property
    def order_value(self) -> Column:
        """One comparable value with the same order as `order`."""
        return F.struct(*self.order) if self.tie else F.col(self.ts)

    @property
    def row_id(self) -> list[str]:
        """The columns that tell rows apart, as far as `tie` does."""
        return [*self.keys, self.ts, *self.tie]

    def ranked_by(self, *columns: str) -> SeriesSpec:
        """The same series with further columns to order rows that share an instant."""
        more = [c for c in dict.fromkeys(columns) if c not in self.row_id]
        return replace(self, tie=(*self.tie, *more))

    @property
    def rows_per_day(self) -> int:
        return int(timedelta(days=1) / self.step)

    @property
    def bucket_keys(self) -> list[str]:
        return [*self.keys, BUCKET]

    def bucket(self) -> Column:
        if self.bucket_rows is None:
            return F.lit(0).cast("long")
        span = self.step * self.bucket_rows
        if span >= timedelta(days=1):
            # Whole days need one date conversion per row.
            return F.floor(F.unix_date(F.to_date(self.ts)) / span.days)
        return F.floor(epoch_seconds(F.col(self.ts)) / int(span.total_seconds()))


def with_running_totals(
    df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column], totals: Mapping[str, Column]
) -> DataFrame:
    """Inclusive running sums per key in `order`, which must agree with the order of `bucket`.

    Inside a bucket the sum is a window; before it comes the sum of all earlier buckets, from one row per bucket.
    """
    names = list(totals)
    by = [*keys, bucket]
    per_bucket = df.groupBy(*by).agg(*(F.sum(totals[n]).alias(f"_sum_{n}") for n in names))
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *by, *(F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in names)
    )
    inside = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({n: F.sum(totals[n]).over(inside) for n in names})
    return (
        local.join(offsets, by, "left")
        .withColumns({n: F.col(n) + F.col(f"_off_{n}") for n in names})
        .drop(*(f"_off_{n}" for n in names))
    )


def with_blocks(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Add the bucket of every row; it does not fall along the order of the series.

    With `most_rows` a bucket that holds more is cut: a sample of its rows, about SAMPLED for each block to be, is sorted and
    every SAMPLED-th row starts a block. Instants are no limit: blocks are cut by instant and tie.
    """
    plain = df.withColumn(BUCKET, spec.bucket())
    if spec.most_rows is None:
        return plain
    by = spec.bucket_keys
    timed = plain.where(F.col(spec.ts).isNotNull())
    counts = timed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > spec.most_rows)
    dense = materialise(counts.drop("_n"))
    if dense.isEmpty():
        return plain
    drawn = F.pmod(F.xxhash64(F.lit(1), *df.columns), F.lit(spec.most_rows)) < SAMPLED
    sample = timed.where(drawn).join(dense, by, "left_semi").groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(*spec.order))).alias("_all")
    )
    every = F.filter("_all", lambda _, i: i % SAMPLED == SAMPLED - 1)
    cut = attach_per_key(plain, sample.select(*by, every.alias("_cuts")), by, df.columns)
    here = F.struct(*spec.order)
    block = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= here)), F.lit(0))
    return cut.withColumn(BUCKET, F.col(BUCKET) * (1 << CUT_BITS) + F.greatest(block, F.lit(0))).drop("_cuts")


def rows_at(df: DataFrame, order: Sequence[str], positions: Sequence[int]) -> dict[int, Row]:
    """The rows at these positions (from 0) in the order of a timestamp column and further columns, without numbering all rows.

    The time around every position is cut into BINS ranges whose rows are counted, and only the range that holds the
    position goes on, until it has FEW rows or is one instant. An instant with more rows is dealt into sorted partitions,
    which are counted alike. Then the rows of that range alone are numbered. Rows must have an instant.
    """
    rows = df.select(*order).withColumn("_us", F.unix_micros(F.col(order[0]).cast("timestamp")))
    low, high, n = rows.agg(F.min("_us"), F.max("_us"), F.count("_us")).first()
    if any(not 0 <= p < n for p in positions):
        raise ValueError(f"there are {n} rows")
    # First and last microsecond, rows before and rows inside.
    spans = {p: (low, high, 0, n) for p in positions}
    while True:
        wide = sorted({(a, b) for a, b, _, m in spans.values() if m > FEW and b > a})
        if not wide:
            break
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        step = {(a, b): -(-(b - a + 1) // BINS) for a, b in wide}
        bins = [
            F.when(F.col("_us").between(a, b), F.struct(F.lit(k).alias("k"), F.floor((F.col("_us") - a) / step[a, b]).alias("bin")))
            for k, (a, b) in enumerate(wide)
        ]
        for r in rows.groupBy(F.coalesce(*bins).alias("at")).count().where("at is not null").collect():
            found.setdefault(wide[r["at"]["k"]], []).append((r["at"]["bin"], r["count"]))
        for p, (a, b, before, m) in spans.items():
            if (a, b) in found and m > FEW:
                for at, count in sorted(found[a, b]):
                    if p < before + count:
                        start = a + at * step[a, b]
                        spans[p] = (start, min(b, start + step[a, b] - 1), before, count)
                        break
                    before += count
    out: dict[int, Row] = {}
    for a, b, before, m in sorted(set(spans.values())):
        wanted = [p for p in positions if spans[p] == (a, b, before, m)]
        part = rows.where(F.col("_us").between(a, b)).drop("_us")
        if m > FEW:
            parts = min(4096, -(-m // FEW))
            part = materialise(part.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
            sizes = sorted((r["_p"], r["count"]) for r in part.groupBy("_p").count().collect())
        else:
            part, sizes = part.withColumn("_p", F.lit(0)), [(0, m)]
        for at, count in sizes:
            mine = [p for p in wanted if before <= p < before + count]
            if mine:
                place = F.row_number().over(W.partitionBy("_p").orderBy(*order)) + F.lit(before - 1)
                held = part.where(F.col("_p") == at).withColumn("_i", place).where(F.col("_i").isin(mine))
                out |= {r["_i"]: r for r in held.collect()}
            before += count
    return out


def with_row_index(df: DataFrame, spec: SeriesSpec, out: str = "row_idx") -> DataFrame:
    """Number the rows of every series from 0 in time order; rows without an instant get NULL."""
    if spec.bucket_rows is None:
        known = F.col(spec.ts).isNotNull()
        position = F.row_number().over(W.partitionBy(*spec.keys, known).orderBy(*spec.order)).cast("long") - 1
        return df.withColumn(out, F.when(known, position))
    bucketed = with_blocks(df, spec)
    one = F.when(F.col(spec.ts).isNotNull(), 1).otherwise(0).cast("long")
    counted = with_running_totals(bucketed, spec.keys, BUCKET, spec.order, {out: one})
    return counted.withColumn(out, F.col(out) - 1).drop(BUCKET)


def attach_per_key(
    df: DataFrame, per_key: DataFrame, keys: Sequence[str], spread_by: Sequence[str], spread: int = SPREAD
) -> DataFrame:
    """Left join one row per key onto the rows of that key, each key spread over `spread` join groups.

    For groups without an inner order to cut them by. The small side is repeated `spread` times, so no task receives
    all the rows of a hot key; beyond that adaptive execution splits skewed join partitions. Null keys match.
    """
    slots = F.sequence(F.lit(0), F.lit(spread - 1))
    right = per_key.withColumnsRenamed({k: f"_key_{k}" for k in keys}).withColumn("_at", F.explode(slots))
    slot = F.pmod(F.xxhash64(*spread_by), F.lit(spread)).cast("int")
    on = F.col("_slot") == F.col("_at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return df.withColumn("_slot", slot).join(right, on, "left").drop("_slot", "_at", *(f"_key_{k}" for k in keys))


def attach_per_bucket(df: DataFrame, per_key: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Left join one row per key onto the rows of that key, one join group per bucket.

    The small side is repeated once per bucket that exists, so a join group is never larger than a bucket.
    """
    by = [*keys, bucket]
    return df.join(df.select(*by).distinct().join(per_key, list(keys)), by, "left")


def attach_stats(df: DataFrame, spec: SeriesSpec, stats: Mapping[str, Column], of: DataFrame | None = None) -> DataFrame:
    """Add aggregates of the whole series (of `of`, by default `df`) to every row.

    Without keys the aggregates are one scalar subquery; with keys they are joined on, bucket by bucket.
    """
    source = df if of is None else of
    exprs = [c.alias(n) for n, c in stats.items()]
    if not spec.keys:
        one = source.agg(F.struct(*exprs).alias("_stats")).scalar()
        return df.withColumn("_stats", one).select("*", *(F.col(f"_stats.{n}") for n in stats)).drop("_stats")
    per_key = source.groupBy(*spec.keys).agg(*exprs)
    order = [*df.columns, *stats]
    cut = df.withColumn(BUCKET, F.coalesce(spec.bucket(), F.lit(-1).cast("long")))
    return attach_per_bucket(cut, per_key, spec.keys, BUCKET).select(*order)


def ranked(df: DataFrame, spec: SeriesSpec, needed: Sequence[str]) -> tuple[DataFrame, SeriesSpec]:
    """Rows with a hash of themselves, and the series in one certain order.

    Rows that share an instant come in the order of `tie`, then of the `needed` columns, then of the hash. So the order, and
    what is computed along it, is the same on every run and for every way of computing it. Rows still alike are copies.
    """
    told = df if SELF in df.columns else df.withColumn(SELF, F.xxhash64(*df.columns))
    return told, spec.ranked_by(*needed, SELF)


def beside(
    df: DataFrame, spec: SeriesSpec, needed: Sequence[str], work: Callable[[DataFrame, SeriesSpec], DataFrame]
) -> DataFrame:
    """Let `work` see only the identifying and the `needed` columns, and join the columns it adds back to the rows.

    Work that stores or reshuffles its input then moves a few columns; a wide table is moved once, for this join. `work` gets a
    series in certain order and keeps its ordering columns. A row meets what was computed for it: by these columns, and where
    copies of one row share them, by counting the copies on both sides.
    """
    told, order = ranked(df, spec, needed)
    ids = order.row_id
    made = work(told.select(*ids, *(c for c in dict.fromkeys(needed) if c not in ids)), order)
    new = [c for c in made.columns if c not in told.columns]
    if set(df.columns) <= set(made.columns):
        return made.select(*df.columns, *new)
    # The hash spreads rows of one instant; copies of one row are all that share a window here.
    copies = F.row_number().over(W.partitionBy(*ids).orderBy(F.lit(0)))
    side = made.withColumn(NTH, copies).select(*(F.col(c).alias(f"_of_{c}") for c in (*ids, NTH)), *new)
    on = F.lit(True)
    for c in (*ids, NTH):
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return told.withColumn(NTH, copies).join(side, on, "left").select(*df.columns, *new)


def resample(
    df: DataFrame,
    spec: SeriesSpec,
    aggs: Mapping[str, Column],
    complete: bool = True,
    whole_days: bool = True,
    span: str = "common",
) -> DataFrame:
    """Aggregate raw rows to the grid of `spec`; with `complete`, every key gets every step of the span.

    The `common` span reaches from the first to the last row of all keys; with `key` each has its own, so that one wrong date
    costs one key. Rows are read once and aggregated before they are shuffled, so a hot step costs no more than any other; the
    aggregates, a row per key and day with at most one entry per step, are stored, and give the keys and the span. Empty steps are
    added after the last shuffle: only key-days are joined, and each day's missing steps are exploded beside the present ones.
    """
    if span not in ("common", "key"):
        raise ValueError("span is common or key")
    timed = df.where(F.col(spec.ts).isNotNull())
    out = timed.withColumn(spec.ts, step_start(spec.ts, spec.step)).groupBy(*spec.keys, spec.ts).agg(*(c.alias(n) for n, c in aggs.items()))
    if not complete:
        return out
    step = int(spec.step.total_seconds())
    if step < 1 or 86400 % step:
        raise ValueError("a complete grid needs a step of whole seconds that divides a day")
    second = F.hour(spec.ts) * 3600 + F.minute(spec.ts) * 60 + F.second(spec.ts)
    present = out.groupBy(*spec.keys, F.to_date(spec.ts).alias("_day")).agg(
        F.collect_list(F.struct((second / step).cast("int").alias("i"), *aggs)).alias("_steps"),
        F.min(spec.ts).alias("_first"),
        F.max(spec.ts).alias("_last"),
    )
    present = materialise(present)
    ends = F.struct(F.min("_first").alias("lo"), F.max("_last").alias("hi")).alias("_span")
    if spec.keys and span == "key":
        days = present.groupBy(*spec.keys).agg(ends)
    elif spec.keys:
        days = present.select(*spec.keys).distinct().withColumn("_span", present.agg(ends).scalar())
    else:
        days = present.agg(ends)
    present = present.drop("_first", "_last")
    days = days.where("_span.lo is not null").withColumn(
        "_day", F.explode(F.sequence(F.to_date("_span.lo"), F.to_date("_span.hi")))
    )
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields if f.name in aggs]
    every = F.sequence(F.lit(0), F.lit(86400 // step - 1))
    known = F.coalesce("_steps", F.array().cast(present.schema["_steps"].dataType))
    missing = F.transform(F.array_except(every, known["i"]), lambda i: F.struct(i.alias("i"), *empty))
    grid = (
        spread_groups(days, *spec.keys, "_day")
        .join(present, [*spec.keys, "_day"], "left")
        .withColumn("_s", F.explode(F.concat(known, missing)))
        .withColumn(spec.ts, F.timestamp_add("SECOND", F.col("_s.i") * step, F.col("_day").cast("timestamp_ntz")))
    )
    if not whole_days:
        grid = grid.where(F.col(spec.ts).between(F.col("_span.lo"), F.col("_span.hi")))
    return grid.select(*spec.keys, spec.ts, *(F.col(f"_s.{n}").alias(n) for n in aggs))
