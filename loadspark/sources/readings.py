"""Long readings (ts, site, measurement, prediction, value) in parquet, partitioned by month."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadspark.operators.reshape import FORECAST_NAMES, MEASUREMENT_NAMES, to_wide

READINGS_SCHEMA = "ts timestamp_ntz, site string, measurement string, field string, prediction int, value double"
# Lead times that are read, and the hour forecasts are issued.
LEAD_TIMES = tuple(range(14, 34))
ISSUE_HOUR = 9


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def write_readings(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store readings by month. There is no shuffle: every task writes its own files, so a busy month has many writers."""
    df.withColumn("month", month_of(F.col("ts"))).write.mode(mode).partitionBy("month").parquet(path)


def month_spans(start: date, stop: date) -> list[tuple[date, date]]:
    """Half-open calendar months between `start` and `stop`, the first and last cut to the range."""
    spans, at = [], start
    while at < stop:
        after = (at.replace(day=1) + timedelta(days=32)).replace(day=1)
        spans.append((at, min(after, stop)))
        at = after
    return spans


def month_counts(
    spark: SparkSession, path: str, start: date, stop: date, site: str | None = None, measurements: Sequence[str] | None = None
) -> DataFrame:
    """One row per calendar month of the range, the first and last cut to it: first day, day after, and readings found.

    A single scan of the months in the range; months without readings are there with 0.
    """
    spans = spark.createDataFrame([(f"{a:%Y-%m}", a, b) for a, b in month_spans(start, stop)], "month string, first date, stop date")
    at = datetime.combine(start, datetime.min.time()), datetime.combine(stop, datetime.min.time())
    rows = read_readings(spark, path, *at, site, measurements)
    found = rows.groupBy(month_of(F.col("ts")).alias("month")).agg(F.count(F.lit(1)).alias("readings"))
    return spans.join(found, "month", "left").select("month", "first", "stop", F.coalesce("readings", F.lit(0)).alias("readings"))


def issued_at(ts: Column, lead: Column, hour: int = ISSUE_HOUR) -> Column:
    """Whether a value for `ts` with this lead time in hours was issued at `hour`."""
    return F.pmod(F.hour(ts) + 24 - lead, F.lit(24)) == hour


def select_readings(
    df: DataFrame,
    start: datetime | None = None,
    stop: datetime | None = None,
    site: str | None = None,
    measurements: Sequence[str] | None = None,
    predictions: Sequence[int] | None = None,
    issue_hour: int | None = None,
    field: str | None = None,
) -> DataFrame:
    """Half-open time range and set filters, all of which the parquet scan can use."""
    out = df
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        out = out.where(F.col("ts") < F.lit(stop).cast("timestamp_ntz"))
    if "month" in df.columns:
        if start is not None:
            out = out.where(F.col("month") >= f"{start:%Y-%m}")
        if stop is not None:
            out = out.where(F.col("month") <= f"{stop - timedelta(microseconds=1):%Y-%m}")
    if site is not None:
        out = out.where(F.col("site") == site)
    if field is not None:
        out = out.where(F.col("field") == field)
    if measurements is not None:
        out = out.where(F.col("measurement").isin(list(measurements)))
    if predictions is not None:
        out = out.where(F.col("prediction").isin(list(predictions)))
    if issue_hour is not None:
        out = out.where(issued_at(F.col("ts"), F.col("prediction"), issue_hour))
    return out


def read_readings(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    stop: datetime | None = None,
    site: str | None = None,
    measurements: Sequence[str] | None = None,
    predictions: Sequence[int] | None = None,
    issue_hour: int | None = None,
    field: str | None = None,
) -> DataFrame:
    """One scan of the readings table: months outside the range are pruned, the rest is filtered in the scan."""
    table = spark.read.schema(f"{READINGS_SCHEMA}, month string").parquet(path)
    return select_readings(table, start, stop, site, measurements, predictions, issue_hour, field).drop("month")


def forecast_table(
    spark: SparkSession, path: str, start: datetime, stop: datetime, site: str, field: str = "Value"
) -> DataFrame:
    """Forecasts issued at nine, one column per raw measurement; a repeated cell fails the query."""
    names = sorted(FORECAST_NAMES)
    rows = read_readings(spark, path, start, stop, site, names, LEAD_TIMES, ISSUE_HOUR, field)
    return to_wide(rows.withColumnRenamed("ts", "timestamp"), ["timestamp"], "measurement", "value", names)


def measurement_table(
    spark: SparkSession, path: str, start: datetime, stop: datetime, site: str, field: str = "Value"
) -> DataFrame:
    """Measured weather, one column per raw measurement."""
    names = sorted(MEASUREMENT_NAMES)
    rows = read_readings(spark, path, start, stop, site, names, field=field)
    return to_wide(rows.withColumnRenamed("ts", "timestamp"), ["timestamp"], "measurement", "value", names)
