"""Series derived from the given tables, in Spark and, word for word, in SQL for the comparison."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadspark.functions.calendar import local_to_utc
from loadspark.operators.fills import forward_fill
from loadspark.operators.metrics import long_predictions
from loadspark.operators.rolling import add_lag
from loadspark.series import SeriesSpec, resample
from loadspark.session import materialise

SPEC15 = SeriesSpec(ts="ts", step=timedelta(minutes=15), bucket_rows=960)
USER = SeriesSpec(ts="ts", keys=("user_id",), step=timedelta(hours=1), bucket_rows=240)
STATION = SeriesSpec(ts="ts", keys=("station",), step=timedelta(hours=1), bucket_rows=240)
DAILY = SeriesSpec(ts="dd", step=timedelta(days=1), bucket_rows=365)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column, digits: int = 6) -> Column:
    """Rounded to even in plain double arithmetic, which both engines do alike; adding 0.0 drops the sign of zero."""
    return F.rint((F.col(c) if isinstance(c, str) else c) * 10.0**digits) / 10.0**digits + 0.0


def day_curve(ts: str = "ts", load: str = "load") -> Column:
    """Standing in for irradiance: a clear-sky like curve of the time of day under clouds that the load makes thinner."""
    wave = F.sin((F.hour(ts) + F.minute(ts) / 60 - 6) * math.pi / 12)
    clear = F.lit(0.5) + F.least(F.coalesce(F.col(load), F.lit(0.0)) / 511, F.lit(1.0)) * 0.5
    return F.when(wave > 0, wave).otherwise(0.0) * 900 * clear


def _aggs() -> dict[str, Column]:
    def of(kind: str) -> Column:
        return F.when(F.col("event_type") == kind, F.col("value"))

    return {"load": F.avg("value"), "forecast_load": F.avg(of("view")), "solar_remote": F.sum(of("click"))}


def series15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series on a 15-minute grid."""
    return resample(table(spark, sf_dir, "events"), SPEC15, _aggs()).withColumn("ghi", day_curve())


def user_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hourly series per user."""
    return resample(table(spark, sf_dir, "events"), USER, _aggs()).withColumn("ghi", day_curve())


def station_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hourly series per station, users being spread over ten stations."""
    events = table(spark, sf_dir, "events").withColumn("station", F.col("user_id") % 10)
    return resample(events, STATION, _aggs()).withColumn("ghi", day_curve())


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long readings; several may share an instant and a measurement."""
    return table(spark, sf_dir, "events").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        (F.col("user_id") % 10).alias("site"),
        F.col("event_type").alias("measurement"),
        (F.lit(14) + F.get_json_object("props", "$.k").cast("int") % 20).alias("prediction"),
        "value",
    )


def dst_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the local clock of the two days on which it changes."""
    day = F.when(F.col("event_id") % 192 < 96, F.lit("2023-03-26")).otherwise("2023-10-29").cast("timestamp_ntz")
    local = F.timestamp_add("MINUTE", (F.col("event_id") % 96) * 15, day)
    return table(spark, sf_dir, "events").select("event_id", "value", local.alias("local_ts"))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("dd"))
        .agg(F.sum("o_totalprice").alias("load"))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week-ago load and the operator's forecast against the load."""
    filled = materialise(forward_fill(series15(spark, sf_dir), SPEC15, ["load"]))
    past = add_lag(filled, SPEC15, "load", timedelta(days=7), out="week_ago")
    return long_predictions(past, "ts", "load", {"persistence": "week_ago", "operator": "forecast_load"})


def utc_of_dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dst_local(spark, sf_dir).withColumn("utc_ts", local_to_utc(F.col("local_ts")))


# --- the same in SQL ---------------------------------------------------------------------------------------------


def q6(expr: str, digits: int = 6) -> str:
    """The same in SQL."""
    r = f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits}"
    return f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END"


def grid_sql(step: str) -> str:
    return (
        "SELECT unnest(generate_series("
        "(SELECT CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) FROM events), "
        f"(SELECT CAST(CAST(max(ts) AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL {step} FROM events), "
        f"INTERVAL {step})) AS ts"
    )


_SQL_AGGS = """avg(value) AS load, avg(value) FILTER (WHERE event_type = 'view') AS forecast_load,
    sum(value) FILTER (WHERE event_type = 'click') AS solar_remote"""
def sql_curve(ts: str = "ts", load: str = "a.load") -> str:
    wave = f"greatest(0, sin(pi() * (hour({ts}) + minute({ts}) / 60 - 6) / 12))"
    return f"900 * {wave} * (0.5 + 0.5 * least(1, coalesce({load}, 0) / 511)) AS ghi"


_SQL_CURVE = sql_curve()

S15 = f"""s15 AS (
  SELECT ts, a.load, a.forecast_load, a.solar_remote, {_SQL_CURVE}
  FROM ({grid_sql('15 MINUTE')}) LEFT JOIN (
    SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, {_SQL_AGGS} FROM events GROUP BY 1) a USING (ts))"""


def _keyed(name: str, key: str, expr: str) -> str:
    return f"""{name} AS (
  SELECT {key}, ts, a.load, a.forecast_load, a.solar_remote, {_SQL_CURVE}
  FROM (SELECT DISTINCT {expr} AS {key} FROM events) CROSS JOIN ({grid_sql('1 HOUR')}) LEFT JOIN (
    SELECT {expr} AS {key}, time_bucket(INTERVAL 1 HOUR, ts) AS ts, {_SQL_AGGS} FROM events GROUP BY 1, 2) a
    USING ({key}, ts))"""


UH = _keyed("uh", "user_id", "user_id")
SH = _keyed("sh", "station", "user_id % 10")

F15 = (
    S15
    + """, f15 AS (
  SELECT * REPLACE (last_value(load IGNORE NULLS) OVER (ORDER BY ts) AS load) FROM s15)"""
)
PRED = (
    F15
    + """, pred AS (
  SELECT 'persistence' AS model, a.ts, a.load AS y_true, b.load AS y_pred
  FROM f15 a LEFT JOIN f15 b ON b.ts = a.ts - INTERVAL 7 DAY
  UNION ALL SELECT 'operator', ts, load, forecast_load FROM f15)"""
)
READ = """r AS (
  SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, user_id % 10 AS site, event_type AS measurement,
    14 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS prediction, value FROM events)"""
DST = """dst AS (
  SELECT event_id, value, (CASE WHEN event_id % 192 < 96 THEN TIMESTAMP '2023-03-26' ELSE TIMESTAMP '2023-10-29' END)
    + to_minutes(CAST((event_id % 96) * 15 AS BIGINT)) AS local_ts FROM events)"""
TO_UTC = """CASE WHEN local_ts >= TIMESTAMP '2023-03-26 02:00' AND local_ts < TIMESTAMP '2023-03-26 03:00' THEN NULL
    WHEN local_ts >= TIMESTAMP '2023-03-26 03:00' AND local_ts < TIMESTAMP '2023-10-29 03:00'
    THEN local_ts - INTERVAL 2 HOUR ELSE local_ts - INTERVAL 1 HOUR END"""
TO_LOCAL = """CASE WHEN {0} >= TIMESTAMP '2023-03-26 01:00' AND {0} < TIMESTAMP '2023-10-29 01:00'
    THEN {0} + INTERVAL 2 HOUR ELSE {0} + INTERVAL 1 HOUR END"""
DAILY_SQL = """daily AS (SELECT CAST(o_orderdate AS DATE) AS dd, sum(o_totalprice) AS load FROM orders GROUP BY 1)"""

HOLIDAYS = """easter AS (
  SELECT y, CAST(make_date(y, CAST(s // 31 AS BIGINT), CAST(s % 31 + 1 AS BIGINT)) AS DATE) AS sunday FROM (
    SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS s FROM (
      SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (
        SELECT *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h FROM (
          SELECT DISTINCT year(o_orderdate) AS y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM orders))))),
hol AS (
  SELECT make_date(y, m, d) AS hd FROM easter CROSS JOIN
    (VALUES (1, 1), (8, 1), (12, 25), (12, 26), (8, 15), (11, 1)) AS f(m, d)
  UNION SELECT CAST(sunday + to_days(k) AS DATE) FROM easter CROSS JOIN (VALUES (1), (39), (50), (60)) AS e(k))"""
