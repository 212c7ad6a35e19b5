"""Merging tables on their instant."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from loadspark.functions.calendar import local_to_utc, utc_to_local
from loadspark.operators.fills import forward_fill
from loadspark.operators.reshape import reorder
from loadspark.series import SeriesSpec


def full_merge(dfs: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Full outer joins on the same key, which is coalesced: one shuffle whatever the number of inputs.

    Rows are stacked, each with its columns as one struct under the number of its input, and grouped by key. An input that
    repeats a key gives every combination of its rows with those of the others, as joins do; rows of one key share a
    task. A null in the key matches nothing.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if len(dfs) == 1:
        return dfs[0]
    names = [[c for c in d.columns if c not in keys] for d in dfs]
    alone = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))

    def stacked(i: int, d: DataFrame) -> DataFrame:
        cells = F.struct(F.lit(i).alias("_input"), *names[i])
        lone = F.when(alone, F.monotonically_increasing_id())
        return d.select(*keys, F.when(lone.isNotNull(), F.lit(i)).alias("_lone_input"), lone.alias("_lone"), cells.alias(f"_s{i}"))

    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (stacked(i, d) for i, d in enumerate(dfs)))
    out = both.groupBy(*keys, "_lone_input", "_lone").agg(*(F.collect_list(f"_s{i}").alias(f"_s{i}") for i in range(len(dfs))))
    for i in range(len(dfs)):
        out = out.withColumn(f"_s{i}", F.explode_outer(f"_s{i}"))
    return out.select(*keys, *(F.col(f"_s{i}.{c}").alias(c) for i, part in enumerate(names) for c in part))


def stations_to_wide(long: DataFrame, ts: str, station: str, stations: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Rows (ts, station, variables...) to columns `{station}_{variable}`: one shuffle whatever the station count.

    Two rows of one station for the same instant fail the query rather than lose one.
    """

    def cell(v: str):
        twice = F.raise_error(F.concat(F.lit(f"{v}: two rows for station "), F.any_value(station))).cast("double")
        return F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.max(v)).alias(v)

    wide = long.groupBy(ts).pivot(station, list(stations)).agg(*(cell(v) for v in variables))
    return wide if len(variables) > 1 else wide.withColumnsRenamed({s: f"{s}_{variables[0]}" for s in stations})


def energy_to_utc(energy: DataFrame, ts: str = "timestamp", tz: str = "Europe/Zurich", gap: str = "drop") -> DataFrame:
    """Turn the local clock of the energy table into UTC.

    Local times skipped in spring do not exist. `gap='drop'` leaves such rows out, `'null'` keeps them without an
    instant, `'copy'` gives them the instant of the row before, which makes that instant repeat.
    """
    converted = energy.withColumn("_utc", local_to_utc(F.col(ts), tz))
    if gap == "copy":
        converted = forward_fill(converted, SeriesSpec(ts=ts), ["_utc"])
    elif gap == "drop":
        converted = converted.where(F.col("_utc").isNotNull() | F.col(ts).isNull())
    return reorder(converted.drop(ts).withColumnRenamed("_utc", ts), [ts])


def merge_sources(
    energy: DataFrame, others: Sequence[DataFrame], ts: str = "timestamp", tz: str = "Europe/Zurich", gap: str = "drop"
) -> DataFrame:
    """Energy (local clock) and weather tables (UTC) on one UTC instant, with the local wall clock beside it."""
    merged = full_merge([energy_to_utc(energy, ts, tz, gap), *others], ts).withColumnRenamed(ts, "utc_timestamp")
    with_local = merged.withColumn("local_timestamp", utc_to_local(F.col("utc_timestamp"), tz))
    return reorder(with_local, ["utc_timestamp", "local_timestamp"])


def merge_in_local_time(
    energy: DataFrame, weather: DataFrame, ts: str = "timestamp", tz: str = "Europe/Zurich"
) -> DataFrame:
    """Two tables on the local clock: the weather table is moved from UTC first."""
    return full_merge([energy, weather.withColumn(ts, utc_to_local(F.col(ts), tz))], ts)


def membership(df: DataFrame, col: str, values: DataFrame, out: str) -> DataFrame:
    """Flag rows whose `col` occurs in the one-column table `values`; a null occurs in no table, so its flag is false."""
    hits = values.select(F.col(values.columns[0]).alias(col)).distinct().withColumn("_hit", F.lit(True))
    return df.join(hits, col, "left").withColumn(out, F.col("_hit").isNotNull()).drop("_hit")


def union_months(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack monthly parts; a column missing from one part is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)

