"""CSV scans: the energy table with its two date formats, and weather files per station."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loadspark.operators.joins import stations_to_wide
from loadspark.operators.reshape import (
    ENERGY_NAMES,
    FORECAST_NAMES,
    MEASUREMENT_NAMES,
    STATIONS,
    drop_by_suffix,
    rename_map,
)

ENERGY_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ENERGY_NAMES)]
)
# Day-first dates with a two-digit year, else with a four-digit one.
DATE_FORMATS = ("d/M/yy H:mm", "d/M/yyyy H:mm")


def parse_first(col: Column, formats: Sequence[str]) -> Column:
    """The first format that fits, as a wall-clock timestamp; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(col, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def read_energy_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType = ENERGY_SCHEMA,
    null_value: str = "#N/A",
    formats: Sequence[str] = DATE_FORMATS,
) -> DataFrame:
    """Energy CSV with an explicit schema; `null_value` and empty cells are null."""
    raw = spark.read.schema(schema).option("header", True).option("nullValue", null_value).csv(path)
    return raw.withColumn("timestamp", parse_first(F.col("timestamp"), formats))


def utc_wall_clock(col: Column) -> Column:
    """ISO text with or without an offset to the UTC wall clock; text without one is taken as UTC."""
    iso = F.regexp_replace(col, r"([+-]\d{2})(\d{2})$", "$1:$2")
    offset = iso.rlike(r"([+-]\d{2}:\d{2}|Z)$")
    instant = iso.try_cast("timestamp").cast("timestamp_ntz")
    moved = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant)
    return F.when(offset, moved).otherwise(iso.try_cast("timestamp_ntz"))


def read_weather_csv(spark: SparkSession, path: str, ts: str = "timestamp") -> DataFrame:
    """Weather CSV: columns by header name, the instant as UTC wall clock, everything else double."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        utc_wall_clock(F.col(ts)).alias(ts), *(F.col(f"`{c}`").cast("double").alias(c) for c in raw.columns if c != ts)
    )


def latest_files(spark: SparkSession, pattern: str, key_regex: str | None = None) -> dict[str, str]:
    """The lexicographically largest path per key (the first group of `key_regex` in the file name).

    A folder of that name, as Spark writes one, counts as a file. Spark lists the files; only one path per key reaches the
    driver.
    """
    end = pattern.rsplit(".", 1)[-1] if "." in pattern.rsplit("/", 1)[-1] else ""
    inside = rf"(\.{end})/[^/]*$" if end.isalnum() else r"()$^"
    path = F.regexp_replace("path", inside, "$1")
    name = F.element_at(F.split(path, "/"), -1)
    key = F.regexp_extract(name, key_regex, 1) if key_regex else F.lit("")
    listed = spark.read.format("binaryFile").load(pattern).select(path.alias("path"), key.alias("key"))
    found = {r["key"]: r["path"] for r in listed.groupBy("key").agg(F.max("path").alias("path")).collect()}
    if not found:
        raise FileNotFoundError(f"no file matches {pattern}")
    return found


def file_headers(spark: SparkSession, paths: Sequence[str], ts: str, station: Column) -> dict[tuple[str, ...], list[str]]:
    """Which stations' files have which column names, from one pass over all files for the lines that begin with `ts`."""
    lines = spark.read.text(list(paths)).select(station.alias("station"), F.trim("value").alias("value"))
    heads = lines.where(F.col("value").rlike(rf'^\ufeff?"?{ts}"?(,|$)')).distinct().collect()
    names: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(heads, key=lambda r: r["station"]):
        columns = tuple(next(csv.reader([r["value"].lstrip("\ufeff")])))
        names.setdefault(columns, []).append(r["station"])
    several = [s for s in {r["station"] for r in heads} if sum(s in found for found in names.values()) > 1]
    if several:
        raise ValueError(f"files of {', '.join(sorted(several))} differ in their columns")
    return names


def read_station_files(
    spark: SparkSession,
    data_dir: str,
    kind: str,
    rename: Mapping[str, str],
    stations: Sequence[str] = tuple(STATIONS),
    minutes: Sequence[int] | None = None,
    ts: str = "timestamp",
) -> DataFrame:
    """The latest `{station}_{kind}_*.csv` of every station, merged on the instant as `{station}_{variable}` columns.

    Headers are read in one pass over all files; then files with the same header are one scan, the station taken from the
    file's path, so jobs and plan do not grow with the number of stations. The scan checks the names in each file again.
    The long table is spread wide by a single grouped pivot rather than a chain of joins. `minutes` keeps only some minutes
    of the hour.
    """
    latest = latest_files(spark, f"{data_dir}/*_{kind}_*.csv", rf"^(.+?)_{kind}_")
    missing = [s for s in stations if s not in latest]
    if missing:
        raise FileNotFoundError(f"no {kind} file for {', '.join(missing)}")
    variables = list(rename.values())
    station = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+?)_{kind}_[^/]*\.csv(/[^/]*)?$", 1)
    parts = []
    for columns, of in file_headers(spark, [latest[s] for s in stations], ts, station).items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        raw = reader.csv([latest[s] for s in of]).withColumn("station", station)
        part = drop_by_suffix(rename_map(raw, rename), "_0")
        have = [F.col(v).cast("double").alias(v) if v in part.columns else F.lit(None).cast("double").alias(v) for v in variables]
        parts.append(part.select(utc_wall_clock(F.col(ts)).alias(ts), "station", *have))
    long = reduce(DataFrame.unionByName, parts)
    if minutes is not None:
        long = long.where(F.minute(ts).isin(list(minutes)))
    return stations_to_wide(long, ts, "station", stations, variables)


def read_forecasts(spark: SparkSession, data_dir: str, stations: Sequence[str] = tuple(STATIONS)) -> DataFrame:
    return read_station_files(spark, data_dir, "forecast", FORECAST_NAMES, stations)


def read_measurements(spark: SparkSession, data_dir: str, stations: Sequence[str] = tuple(STATIONS)) -> DataFrame:
    """Ten-minute measurements; only the full and half hours meet the quarter-hour grid."""
    return read_station_files(spark, data_dir, "measurement", MEASUREMENT_NAMES, stations, minutes=(0, 30))
