"""Queries over ordered series: grids, fills, lags, rolling frames, daily features, splits by position."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadspark.catalog.registry import query
from loadspark.catalog.views import (
    DAILY,
    DAILY_SQL,
    PRED,
    S15,
    SH,
    SPEC15,
    STATION,
    UH,
    USER,
    daily_orders,
    predictions,
    q6,
    r6,
    series15,
    station_hourly,
    table,
    user_hourly,
)
from loadspark.functions.solar import add_poa_irradiance
from loadspark.operators.analysis import (
    efficiency_profile,
    ghi_correlation,
    importance_share,
    lag_autocorr,
    production_profile,
)
from loadspark.operators.capacity import estimate_capacity, isotonic_fit, reconstruct
from loadspark.operators.clean import cells_filled, clean
from loadspark.operators.fills import backward_fill, fill_both, forward_fill
from loadspark.operators.joins import full_merge
from loadspark.operators.lags import add_lag_features, add_yield_ratio, daily_stats, mean_over_days
from loadspark.operators.metrics import compare_models, error_metrics, hourly_error_metrics, series_range
from loadspark.operators.models import contiguous_folds
from loadspark.operators.reshape import every_nth, normalise, slice_rows, to_long
from loadspark.operators.rolling import (
    Roll,
    add_lag,
    add_persistence,
    broadcast_bucket_mean,
    rolling,
    rolling_many,
    transitions,
)
from loadspark.operators.split import between_dates
from loadspark.series import SeriesSpec, with_row_index
from loadspark.session import materialise

Spark, Frame = SparkSession, DataFrame
VALUES = ["load", "forecast_load", "solar_remote"]


def _users(spark: Spark, sf: str, *cols: str) -> Frame:
    """User series as a stored table, for queries that go over it more than once."""
    return materialise(user_hourly(spark, sf).select("user_id", "ts", *(cols or ("load",))))


def _r(df: Frame, keep: list[str], rounded: list[str], digits: int = 6) -> Frame:
    return df.select(*keep, *(r6(c, digits).alias(c) for c in rounded))


def _q(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"{q6(c, digits)} AS {c}" for c in cols)


@query("resample_15min", f"WITH {S15} SELECT ts, {_q([*VALUES, 'ghi'])} FROM s15")
def resample_15min(spark: Spark, sf: str) -> Frame:
    return _r(series15(spark, sf), ["ts"], [*VALUES, "ghi"])


@query("resample_user_hourly", f"WITH {UH} SELECT user_id, ts, {_q(VALUES)} FROM uh")
def resample_user_hourly(spark: Spark, sf: str) -> Frame:
    return _r(user_hourly(spark, sf), ["user_id", "ts"], VALUES)


@query(
    "persistence_mae",
    f"""WITH {PRED} SELECT {q6('avg(abs(y_true - y_pred))')} AS mae, {q6('sqrt(avg((y_true - y_pred) ** 2))')} AS rmse,
    count(y_true - y_pred) AS n, count(*) - count(y_true - y_pred) AS skipped FROM pred WHERE model = 'persistence'""",
)
def persistence_mae(spark: Spark, sf: str) -> Frame:
    pred = predictions(spark, sf).where("model = 'persistence'")
    return _r(error_metrics(pred).drop("model"), ["n", "skipped"], ["mae", "rmse"])


@query(
    "persistence_by_user",
    f"""WITH {UH}, f AS (SELECT user_id, ts, last_value(load IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS load
      FROM uh)
    SELECT a.user_id, {q6('avg(abs(a.load - b.load))')} AS mae, {q6('sqrt(avg((a.load - b.load) ** 2))')} AS rmse,
      count(a.load - b.load) AS n FROM f a LEFT JOIN f b ON a.user_id = b.user_id AND b.ts = a.ts - INTERVAL 7 DAY
    GROUP BY 1""",
)
def persistence_by_user(spark: Spark, sf: str) -> Frame:
    filled = materialise(forward_fill(_users(spark, sf), USER, ["load"]))
    past = add_persistence(filled, USER, "load", 7)
    pred = past.select("user_id", F.col("load").alias("y_true"), F.col("load_persistence_7d").alias("y_pred"))
    return _r(error_metrics(pred, "user_id"), ["user_id", "n"], ["mae", "rmse"])


@query(
    "forward_fill",
    f"""WITH {UH} SELECT user_id, ts,
    {q6('last_value(load IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts)')} AS load,
    {q6('last_value(solar_remote IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts)')} AS solar_remote FROM uh""",
)
def forward_fill_query(spark: Spark, sf: str) -> Frame:
    cols = ["load", "solar_remote"]
    return _r(forward_fill(_users(spark, sf, *cols), USER, cols), ["user_id", "ts"], cols)


@query(
    "forward_fill_limited",
    f"""WITH {UH}, l AS (SELECT user_id, ts, load, last_value(load IGNORE NULLS) OVER w AS v,
      last_value(CASE WHEN load IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS seen
      FROM uh WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, ts, {q6("CASE WHEN ts - seen <= INTERVAL 12 HOUR THEN v END")} AS load FROM l""",
)
def forward_fill_limited(spark: Spark, sf: str) -> Frame:
    return _r(forward_fill(_users(spark, sf), USER, ["load"], timedelta(hours=12)), ["user_id", "ts"], ["load"])


_BACK = "first_value(load IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_FORW = "last_value(load IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts)"


@query("backward_fill", f"WITH {UH} SELECT user_id, ts, {q6(_BACK)} AS load FROM uh")
def backward_fill_query(spark: Spark, sf: str) -> Frame:
    return _r(backward_fill(_users(spark, sf), USER, ["load"]), ["user_id", "ts"], ["load"])


@query("bfill_ffill", f"WITH {UH} SELECT user_id, ts, {q6(f'coalesce({_BACK}, {_FORW})')} AS load FROM uh")
def bfill_ffill(spark: Spark, sf: str) -> Frame:
    return _r(fill_both(_users(spark, sf), USER, ["load"]), ["user_id", "ts"], ["load"])


@query(
    "clean_series",
    f"""WITH {S15}, f AS (SELECT ts, last_value(load IGNORE NULLS) OVER w AS load,
      last_value(CASE WHEN forecast_load - 100 < 0 THEN 0 ELSE forecast_load - 100 END IGNORE NULLS) OVER w AS forecast_load,
      last_value(solar_remote IGNORE NULLS) OVER w AS solar_remote, ghi FROM s15 WINDOW w AS (ORDER BY ts))
    SELECT ts, {_q([*VALUES, 'ghi'])} FROM f
    WHERE load IS NOT NULL AND forecast_load IS NOT NULL AND solar_remote IS NOT NULL""",
)
def clean_series(spark: Spark, sf: str) -> Frame:
    shifted = series15(spark, sf).withColumn("forecast_load", F.col("forecast_load") - 100)
    return _r(clean(shifted, SPEC15, ["forecast_load"]), ["ts"], [*VALUES, "ghi"])


@query(
    "cells_filled",
    f"""WITH {S15}, f AS (SELECT ts, last_value(load IGNORE NULLS) OVER w AS load,
      last_value(forecast_load IGNORE NULLS) OVER w AS forecast_load,
      last_value(solar_remote IGNORE NULLS) OVER w AS solar_remote FROM s15 WINDOW w AS (ORDER BY ts))
    SELECT (SELECT 3 * count(*) - count(load) - count(forecast_load) - count(solar_remote) FROM s15) AS cells_filled""",
)
def cells_filled_query(spark: Spark, sf: str) -> Frame:
    before = series15(spark, sf)
    return cells_filled(before, clean(before, SPEC15, []))


@query(
    "row_index",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx
    FROM events""",
)
def row_index(spark: Spark, sf: str) -> Frame:
    spec = SeriesSpec("ts", ("user_id",), timedelta(hours=1), 48, ("event_id",), most_rows=1 << 20)
    return with_row_index(table(spark, sf, "events").select("event_id", "user_id", "ts"), spec).drop("ts")


@query(
    "event_lag_rows",
    """SELECT event_id, value, lag(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag FROM events""",
)
def event_lag_rows(spark: Spark, sf: str) -> Frame:
    spec = SeriesSpec("ts", ("user_id",), timedelta(hours=1), 48, ("event_id",), most_rows=1 << 20)
    return add_lag(table(spark, sf, "events"), spec, "value", 3, "rows").select("event_id", "value", "value_lag")


@query(
    "lag_time",
    f"""WITH {UH} SELECT user_id, ts, {q6('lag(load, 24) OVER w')} AS day_before, {q6('lag(load, 168) OVER w')} AS week_before
    FROM uh WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def lag_time(spark: Spark, sf: str) -> Frame:
    series = _users(spark, sf)
    out = add_lag(series, USER, "load", timedelta(days=1), out="day_before")
    out = add_lag(out, USER, "load", timedelta(days=7), out="week_before")
    return _r(out, ["user_id", "ts"], ["day_before", "week_before"])


@query(
    "rolling_mae",
    f"""WITH {UH}, f AS (SELECT user_id, ts, last_value(load IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS load
      FROM uh), e AS (SELECT user_id, ts, abs(lag(load, 24) OVER (PARTITION BY user_id ORDER BY ts) - load) AS err FROM f)
    SELECT user_id, ts, {q6("CASE WHEN count(err) OVER w >= 24 THEN avg(err) OVER w END")} AS mae FROM e
    WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
)
def rolling_mae(spark: Spark, sf: str) -> Frame:
    filled = materialise(forward_fill(_users(spark, sf), USER, ["load"]))
    past = materialise(add_lag(filled, USER, "load", 24, "rows", "day_before"))
    errors = past.withColumn("err", F.abs(F.col("day_before") - F.col("load")))
    return _r(rolling(errors, USER, "err", 24, out="mae"), ["user_id", "ts"], ["mae"])


def _frame(rows: int, order: str = "PARTITION BY user_id ORDER BY ts") -> str:
    return f"WINDOW w AS ({order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


@query(
    "rolling_quantiles_by_user",
    f"""WITH {UH} SELECT user_id, ts,
    {q6("CASE WHEN count(load) OVER w >= 6 THEN quantile_cont(load, 0.5) OVER w END")} AS med,
    {q6("CASE WHEN count(load) OVER w >= 6 THEN quantile_cont(load, 0.9) OVER w END")} AS p90
    FROM uh {_frame(168)}""",
)
def rolling_quantiles_by_user(spark: Spark, sf: str) -> Frame:
    rolls = [Roll("load", "med", "median"), Roll("load", "p90", "quantile", 0.9)]
    series = _users(spark, sf)
    return _r(rolling_many(series, USER, rolls, 168, 6), ["user_id", "ts"], ["med", "p90"])


@query(
    "rolling_median",
    f"""WITH {S15} SELECT ts, {q6("CASE WHEN count(load) OVER w >= 96 THEN quantile_cont(load, 0.5) OVER w END")} AS med
    FROM s15 {_frame(2880, 'ORDER BY ts')}""",
)
def rolling_median(spark: Spark, sf: str) -> Frame:
    series = series15(spark, sf).select("ts", "load")
    return _r(rolling(series, SPEC15, "load", 2880, "median", min_samples=96, out="med"), ["ts"], ["med"])


@query(
    "rolling_p90",
    f"""WITH {SH}, p AS (SELECT station, ts,
      CASE WHEN count(load) OVER w >= 24 THEN quantile_cont(load, 0.9) OVER w END AS p90
      FROM sh {_frame(360, 'PARTITION BY station ORDER BY ts')})
    SELECT station, ts, {q6('last_value(p90 IGNORE NULLS) OVER (PARTITION BY station ORDER BY ts)')} AS p90 FROM p""",
)
def rolling_p90(spark: Spark, sf: str) -> Frame:
    series = station_hourly(spark, sf).select("station", "ts", "load")
    rolled = rolling(series, STATION, "load", 360, "quantile", 0.9, 24, "p90")
    return _r(forward_fill(rolled, STATION, ["p90"]), ["station", "ts"], ["p90"])


@query(
    "rolling_mean_std",
    f"""WITH {UH} SELECT user_id, ts, {q6("CASE WHEN count(load) OVER w >= 2 THEN avg(load) OVER w END")} AS m,
    {q6("CASE WHEN count(load) OVER w >= 2 THEN stddev_samp(load) OVER w END", 4)} AS s FROM uh {_frame(72)}""",
)
def rolling_mean_std(spark: Spark, sf: str) -> Frame:
    rolls = [Roll("load", "m", "mean"), Roll("load", "s", "std")]
    out = rolling_many(_users(spark, sf), USER, rolls, 72, 2)
    return out.select("user_id", "ts", r6("m").alias("m"), r6("s", 4).alias("s"))


def _told_frame(rows: int) -> str:
    return f"(PARTITION BY user_id ORDER BY ts, value ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


@query(
    "rolling_repeated_instants",
    f"""WITH e AS (SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, value FROM events)
    SELECT user_id, ts, value, {q6(f'avg(value) OVER {_told_frame(24)}', 10)} AS m24, {q6(f'avg(value) OVER {_told_frame(300)}', 10)} AS m300,
      {q6(f'quantile_cont(value, 0.9) OVER {_told_frame(300)}', 10)} AS q300 FROM e""",
)
def rolling_repeated_instants(spark: Spark, sf: str) -> Frame:
    """Frames over raw readings, many of which share an instant: every row has a value of its own for any window length."""
    raw = table(spark, sf, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "value")
    out = rolling(raw, USER, "value", 24, min_samples=1, out="m24")
    rolls = [Roll("value", "m300"), Roll("value", "q300", "quantile", 0.9)]
    out = rolling_many(out, USER, rolls, 300, 1)
    return _r(out, ["user_id", "ts", "value"], ["m24", "m300", "q300"], 10)


@query(
    "flag_transitions",
    f"""WITH {UH}, f AS (SELECT user_id, ts,
      last_value(load IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) > 100 AS high FROM uh),
    p AS (SELECT *, lag(high) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM f)
    SELECT user_id, ts, high FROM p WHERE high <> prev""",
)
def flag_transitions(spark: Spark, sf: str) -> Frame:
    filled = materialise(forward_fill(_users(spark, sf), USER, ["load"]))
    return transitions(filled.select("user_id", "ts", (F.col("load") > 100).alias("high")), USER, "high")


@query(
    "hourly_broadcast",
    f"""WITH {S15} SELECT ts, {q6("avg(load) OVER (PARTITION BY date_trunc('hour', ts - INTERVAL 15 MINUTE))", 8)} AS load_hourly
    FROM s15""",
)
def hourly_broadcast(spark: Spark, sf: str) -> Frame:
    return _r(broadcast_bucket_mean(series15(spark, sf), SPEC15, "load"), ["ts"], ["load_hourly"], 8)


@query(
    "hourly_mae",
    f"""WITH {PRED}, h AS (SELECT model, date_trunc('hour', ts) AS hour, avg(y_true) AS y_true, avg(y_pred) AS y_pred
      FROM pred GROUP BY 1, 2)
    SELECT model, {q6('avg(abs(y_true - y_pred))')} AS mae, {q6('sqrt(avg((y_true - y_pred) ** 2))')} AS rmse,
      count(y_true - y_pred) AS n FROM h GROUP BY 1""",
)
def hourly_mae(spark: Spark, sf: str) -> Frame:
    return _r(hourly_error_metrics(predictions(spark, sf)), ["model", "n"], ["mae", "rmse"])


@query(
    "model_comparison",
    f"""WITH {PRED} SELECT model, {q6('avg(abs(y_true - y_pred))', 4)} AS MAE,
    {q6('sqrt(avg((y_true - y_pred) ** 2))', 4)} AS RMSE FROM pred GROUP BY 1""",
)
def model_comparison(spark: Spark, sf: str) -> Frame:
    return compare_models(predictions(spark, sf))


@query(
    "errors_in_range",
    f"""WITH {PRED} SELECT model, {q6('avg(abs(y_true - y_pred))')} AS mae FROM pred
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1""",
)
def errors_in_range(spark: Spark, sf: str) -> Frame:
    pred = between_dates(predictions(spark, sf), "ts", date(2024, 1, 10), date(2024, 1, 20))
    return _r(error_metrics(pred), ["model"], ["mae"])


_STATS = [f"{v}_daily_{s}" for v in ("load", "solar_remote") for s in ("min", "max", "mean", "std")]


def _daily_aggs(variables: list[str]) -> str:
    stats = (("min", "min"), ("max", "max"), ("mean", "avg"), ("std", "stddev_samp"))
    return ", ".join(f"{fn}({v}) AS {v}_daily_{s}" for v in variables for s, fn in stats)


_DAILY_AGGS = _daily_aggs(["load", "solar_remote"])


@query(
    "daily_stats",
    f"""WITH {UH}, d AS (SELECT user_id, CAST(ts AS DATE) AS day, {_DAILY_AGGS} FROM uh GROUP BY 1, 2)
    SELECT user_id, CAST(day AS VARCHAR) AS day, {_q(_STATS)} FROM d""",
)
def daily_stats_query(spark: Spark, sf: str) -> Frame:
    stats = daily_stats(user_hourly(spark, sf), USER, ["load", "solar_remote"])
    return _r(stats.withColumn("day", F.col("day").cast("string")), ["user_id", "day"], _STATS)


def lag_sql(key: str, series: str, name: str, variables: list[str]) -> tuple[str, list[str]]:
    """`name`(key, ts, lag features) in SQL, and the names of the features."""
    week = "OVER (PARTITION BY {0} ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)".format(key)
    weekly = ", ".join(
        [f"avg({v}_daily_{s}) {week} AS {v}_w_{s}" for v in variables for s in ("min", "max", "mean")]
        + [f"stddev_samp({v}_daily_mean) {week} AS {v}_w_std" for v in variables]
    )
    picked, names = [], []
    for v in variables:
        for k, alias in ((2, "b"), (3, "c")):
            for s in ("min", "max", "mean", "std"):
                picked.append(f"{q6(f'{alias}.{v}_daily_{s}', 8)} AS {v}_{s}_{k}d")
                names.append(f"{v}_{s}_{k}d")
            cv = f"CASE WHEN abs({alias}.{v}_daily_mean) > 1e-10 THEN {alias}.{v}_daily_std / abs({alias}.{v}_daily_mean) END"
            picked.append(f"{q6(cv, 8)} AS {v}_cv_{k}d")
            names.append(f"{v}_cv_{k}d")
        for s in ("min", "max", "mean", "std"):
            picked.append(f"{q6(f'b.{v}_w_{s}', 8)} AS {v}_week_{s}")
            names.append(f"{v}_week_{s}")
        cv = f"CASE WHEN abs(b.{v}_w_mean) > 1e-10 THEN b.{v}_w_std / abs(b.{v}_w_mean) END"
        picked.append(f"{q6(cv, 8)} AS {v}_cv_week")
        names.append(f"{v}_cv_week")
    sql = f"""{name}_d AS (SELECT {key}, CAST(ts AS DATE) AS day, {_daily_aggs(variables)} FROM {series} GROUP BY 1, 2),
    {name}_w AS (SELECT *, {weekly} FROM {name}_d), {name} AS (
    SELECT a.{key}, a.ts, {', '.join(picked)} FROM {series} a
    LEFT JOIN {name}_w b ON b.{key} = a.{key} AND b.day = CAST(a.ts AS DATE) - 2
    LEFT JOIN {name}_w c ON c.{key} = a.{key} AND c.day = CAST(a.ts AS DATE) - 3)"""
    return sql, names


_LAG_SQL, _LAG_NAMES = lag_sql("user_id", "uh", "lf", ["load", "solar_remote"])


@query("lag_features", f"WITH {UH}, {_LAG_SQL} SELECT * FROM lf")
def lag_features(spark: Spark, sf: str) -> Frame:
    out = add_lag_features(_users(spark, sf, "load", "solar_remote"), USER, ["load", "solar_remote"])
    return out.select(
        "user_id", "ts", *(r6(c, 8).alias(c) for c in _LAG_NAMES)
    )


YIELD_SQL = """dy AS (SELECT {key} CAST(ts AS DATE) AS day, CASE WHEN count(*) FILTER (WHERE ghi > 200) > 0 THEN
    coalesce(sum(solar_remote) FILTER (WHERE ghi > 200), 0) / sum(ghi) FILTER (WHERE ghi > 200) END AS ratio
    FROM {src} GROUP BY ALL)"""


@query(
    "yield_ratio",
    f"""WITH {SH}, {YIELD_SQL.format(key='station,', src='sh')}, y AS (SELECT station, day, avg(ratio) OVER (
      PARTITION BY station ORDER BY day RANGE BETWEEN INTERVAL 31 DAY PRECEDING AND INTERVAL 2 DAY PRECEDING) AS v FROM dy)
    SELECT a.station, a.ts, {q6('y.v')} AS solar_remote_yield_ratio FROM sh a
    LEFT JOIN y ON y.station = a.station AND y.day = CAST(a.ts AS DATE)""",
)
def yield_ratio(spark: Spark, sf: str) -> Frame:
    out = add_yield_ratio(station_hourly(spark, sf), STATION, ghi="ghi")
    return _r(out, ["station", "ts"], ["solar_remote_yield_ratio"])


@query(
    "yield_ratio_rows",
    f"""WITH {SH}, {YIELD_SQL.format(key='station,', src='sh')}, j AS (SELECT a.station, a.ts, dy.ratio FROM sh a
      LEFT JOIN dy ON dy.station = a.station AND dy.day = CAST(a.ts AS DATE))
    SELECT station, ts, {q6('avg(ratio) OVER (PARTITION BY station ORDER BY ts ROWS BETWEEN 31 PRECEDING AND 2 PRECEDING)')}
      AS solar_remote_yield_ratio FROM j""",
)
def yield_ratio_rows(spark: Spark, sf: str) -> Frame:
    out = add_yield_ratio(station_hourly(spark, sf), STATION, ghi="ghi", mode="rows")
    return _r(out, ["station", "ts"], ["solar_remote_yield_ratio"])


@query(
    "daily_mean",
    f"""WITH {UH} SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {q6('avg(load)')} AS load FROM uh GROUP BY 1, 2""",
)
def daily_mean(spark: Spark, sf: str) -> Frame:
    out = mean_over_days(user_hourly(spark, sf), USER, ["load"])
    return _r(out.withColumn("day", F.col("day").cast("string")), ["user_id", "day"], ["load"])


@query(
    "daily_total_normalised",
    f"""WITH {S15}, d AS (SELECT CAST(ts AS DATE) AS day, avg(load) AS load, avg(solar_remote) AS solar_remote FROM s15 GROUP BY 1),
    m AS (SELECT max(coalesce(load, 0) + coalesce(solar_remote, 0)) AS top FROM d),
    n AS (SELECT CAST(day AS VARCHAR) AS day, coalesce(load, 0) / top AS load, coalesce(solar_remote, 0) / top AS solar_remote
      FROM d, m)
    SELECT day, series, {q6('value')} AS value FROM (UNPIVOT n ON load, solar_remote INTO NAME series VALUE value)""",
)
def daily_total_normalised(spark: Spark, sf: str) -> Frame:
    cols = ["load", "solar_remote"]
    daily = mean_over_days(series15(spark, sf), SPEC15, cols).withColumn("day", F.col("day").cast("string"))
    long = to_long(normalise(daily, cols, "total_max", SeriesSpec(ts="day")), ["day"], cols, "series", "value")
    return _r(long, ["day", "series"], ["value"])


@query(
    "lag_autocorr",
    f"""WITH {SH}, f AS (SELECT station, ts, last_value(load IGNORE NULLS) OVER (PARTITION BY station ORDER BY ts) AS load FROM sh),
    i AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts) AS i, isodow(ts) > 5 AS off FROM f)
    SELECT a.station, k AS lag_days, {q6('corr(a.load, b.load)', 4)} AS "all",
      {q6('corr(a.load, b.load) FILTER (WHERE NOT a.off)', 4)} AS weekday,
      {q6('corr(a.load, b.load) FILTER (WHERE a.off)', 4)} AS weekend
    FROM i a CROSS JOIN generate_series(2, 7) AS g(k) JOIN i b ON b.station = a.station AND b.i = a.i - 24 * k
    GROUP BY 1, 2""",
)
def lag_autocorr_query(spark: Spark, sf: str) -> Frame:
    filled = forward_fill(station_hourly(spark, sf).select("station", "ts", "load"), STATION, ["load"])
    return lag_autocorr(filled.withColumn("local_is_weekend", F.weekday("ts") >= 5), STATION)


@query(
    "systematic_sample",
    f"""WITH {UH}, i AS (SELECT user_id, ts, load, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM uh)
    SELECT user_id, ts, {q6('load')} AS load FROM i WHERE i % 24 = 0 AND i < 24 * 20""",
)
def systematic_sample(spark: Spark, sf: str) -> Frame:
    sampled = every_nth(_users(spark, sf), USER, 24, 20)
    return _r(sampled, ["user_id", "ts"], ["load"])


@query(
    "contiguous_folds",
    """WITH i AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
    SELECT event_id, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1)
      ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM i""",
)
def contiguous_folds_query(spark: Spark, sf: str) -> Frame:
    spec = SeriesSpec("ts", (), timedelta(minutes=15), 96, ("event_id",))
    return contiguous_folds(table(spark, sf, "events").select("event_id", "ts"), spec, 7).select("event_id", "fold")


@query(
    "reconstruction_error",
    f"""WITH {SH}, p AS (SELECT station, ts, load, forecast_load AS pred_operator, ghi * 0.5 + 10 AS pred_curve FROM sh
      WHERE load IS NOT NULL AND forecast_load IS NOT NULL)
    SELECT station, ts, {_q(['load', 'pred_operator', 'pred_curve'], 8)}, {q6('pred_operator - load', 8)} AS err_operator,
      {q6('pred_curve - load', 8)} AS err_curve,
      {q6('CASE WHEN count(*) OVER w >= 24 THEN avg(abs(pred_operator - load)) OVER w END', 8)} AS mae_operator,
      {q6('CASE WHEN count(*) OVER w >= 24 THEN avg(abs(pred_curve - load)) OVER w END', 8)} AS mae_curve
    FROM p {_frame(24, 'PARTITION BY station ORDER BY ts')}""",
)
def reconstruction_error(spark: Spark, sf: str) -> Frame:
    methods = {"operator": "forecast_load", "curve": "ghi * 0.5 + 10"}
    out = reconstruct(station_hourly(spark, sf), STATION, methods, "load")
    made = [f"{p}_{m}" for p in ("pred", "err", "mae") for m in methods]
    return _r(out, ["station", "ts"], ["load", *made], 8)


@query(
    "efficiency_profile",
    f"""WITH {S15}, b AS (SELECT hour(ts) AS hour, load / ghi AS load, solar_remote / ghi AS solar_remote FROM s15 WHERE ghi > 50),
    m AS (SELECT avg(load) AS ml, avg(solar_remote) AS ms FROM b),
    h AS (SELECT hour, avg(load / ml) AS load, avg(solar_remote / ms) AS solar_remote FROM b, m GROUP BY 1)
    SELECT hour, station, {q6('v')} AS normalised_ratio FROM h UNPIVOT INCLUDE NULLS (v FOR station IN (load, solar_remote))""",
)
def efficiency_profile_query(spark: Spark, sf: str) -> Frame:
    out = efficiency_profile(series15(spark, sf), SPEC15, ["load", "solar_remote"], "ghi")
    return _r(out, ["hour", "station"], ["normalised_ratio"])


@query(
    "minmax_profile",
    f"""WITH {S15}, h AS (SELECT hour(ts) AS hour, avg(load) AS load, avg(solar_remote) AS solar_remote FROM s15
      WHERE ghi > 50 GROUP BY 1),
    n AS (SELECT hour, (load - min(load) OVER ()) / (max(load) OVER () - min(load) OVER ()) AS load,
      (solar_remote - min(solar_remote) OVER ()) / (max(solar_remote) OVER () - min(solar_remote) OVER ()) AS solar_remote FROM h)
    SELECT hour, station, {q6('v')} AS normalised_production FROM n
      UNPIVOT INCLUDE NULLS (v FOR station IN (load, solar_remote))""",
)
def minmax_profile(spark: Spark, sf: str) -> Frame:
    out = production_profile(series15(spark, sf), SPEC15, ["load", "solar_remote"], "ghi")
    return _r(out, ["hour", "station"], ["normalised_production"])


@query(
    "ghi_correlation",
    f"""WITH {S15}, b AS (SELECT * FROM s15 WHERE ghi > 50)
    SELECT 'load' AS station, {q6('corr(load, ghi)')} AS pearson_r, 'Utility-scale (gross)' AS type FROM b
    UNION ALL SELECT 'solar_remote', {q6('corr(solar_remote, ghi)')}, 'Prosumer (net?)' FROM b""",
)
def ghi_correlation_query(spark: Spark, sf: str) -> Frame:
    out = ghi_correlation(series15(spark, sf), ["load", "solar_remote"], "ghi")
    return _r(out, ["station", "type"], ["pearson_r"])


@query(
    "series_range",
    """SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS rows FROM events GROUP BY 1""",
)
def series_range_query(spark: Spark, sf: str) -> Frame:
    return series_range(table(spark, sf, "events"), USER)


_MERGED = {"view": "viewed", "click": "clicked", "purchase": "bought", "signup": "joined", "error": "failed"}


@query(
    "full_outer_merge",
    "WITH h AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, event_type, avg(value) AS v FROM events GROUP BY 1, 2), "
    + ", ".join(f"{n}_t AS (SELECT ts, v AS {n} FROM h WHERE event_type = '{k}')" for k, n in _MERGED.items())
    + f" SELECT ts, {_q(list(_MERGED.values()))} FROM "
    + " ".join(f"{'FULL JOIN ' if i else ''}{n}_t{' USING (ts)' if i else ''}" for i, n in enumerate(_MERGED.values())),
)
def full_outer_merge(spark: Spark, sf: str) -> Frame:
    hourly = table(spark, sf, "events").withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))

    def of(kind: str, name: str) -> Frame:
        return hourly.where(F.col("event_type") == kind).groupBy("ts").agg(F.avg("value").alias(name))

    return _r(full_merge([of(k, n) for k, n in _MERGED.items()], "ts"), ["ts"], list(_MERGED.values()))


@query(
    "positional_slice",
    f"""WITH {S15}, n AS (SELECT ts, load, row_number() OVER (ORDER BY ts) - 1 AS i FROM s15)
    SELECT ts, {q6('load')} AS load FROM n WHERE i >= 15 * 96""",
)
def positional_slice(spark: Spark, sf: str) -> Frame:
    """The series from its 1,440th row on."""
    return _r(slice_rows(materialise(series15(spark, sf)), SPEC15, 15 * 96), ["ts"], ["load"])


@query(
    "positional_slice_by_user",
    """WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
      count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id, user_id FROM n WHERE i >= 5 AND i < n - 3""",
)
def positional_slice_by_user(spark: Spark, sf: str) -> Frame:
    spec = SeriesSpec("ts", ("user_id",), timedelta(hours=1), 48, ("event_id",), most_rows=1 << 20)
    return slice_rows(table(spark, sf, "events").select("event_id", "user_id", "ts"), spec, 5, -3).drop("ts")


@query(
    "importance_share",
    f"""WITH t AS (SELECT user_id, stddev_samp(value) AS importance FROM events GROUP BY 1),
    k AS (SELECT 'user_' || CAST(user_id AS VARCHAR) AS feature, importance FROM t ORDER BY importance DESC NULLS LAST, 1 LIMIT 15)
    SELECT feature, {q6('importance')} AS importance, {q6('100 * importance / max(importance) OVER ()')} AS importance_norm FROM k""",
)
def importance_share_query(spark: Spark, sf: str) -> Frame:
    """The fifteen users whose values spread most, as percent of the first."""
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("feature")
    spreads = table(spark, sf, "events").groupBy(name).agg(F.stddev_samp("value").alias("importance"))
    return _r(importance_share(spreads), ["feature"], ["importance", "importance_norm"])


@query(
    "isotonic_daily",
    f"""WITH {DAILY_SQL}, s AS (SELECT dd, row_number() OVER (ORDER BY dd) AS i, sum(load) OVER (ORDER BY dd) AS t FROM daily),
    z AS (SELECT i, t FROM s UNION ALL SELECT 0, 0),
    pairs AS (SELECT a.i + 1 AS a, b.i AS b, (b.t - a.t) / (b.i - a.i) AS m FROM z a JOIN z b ON b.i > a.i),
    low AS (SELECT a, b, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM pairs),
    fit AS (SELECT b AS i, max(m) AS f FROM low GROUP BY 1)
    SELECT CAST(dd AS VARCHAR) AS dd, {q6('f', 3)} AS fitted FROM s JOIN fit USING (i)""",
)
def isotonic_daily(spark: Spark, sf: str) -> Frame:
    out = isotonic_fit(daily_orders(spark, sf), DAILY, {"load": "fitted"})
    return out.select(F.col("dd").cast("string").alias("dd"), r6("fitted", 3).alias("fitted"))


_PHI, _BETA = "radians(46.23)", "radians(30)"
POA_SQL = f"""a AS (SELECT ts, ghi, 2 * pi() * (dayofyear(ts) - 1) / 365 AS b,
    hour(ts) + minute(ts) / 60 + second(ts) / 3600 AS h FROM s15),
  e AS (SELECT *, 0.006918 - 0.399912 * cos(b) + 0.070257 * sin(b) - 0.006758 * cos(2 * b) + 0.000907 * sin(2 * b)
      - 0.002697 * cos(3 * b) + 0.00148 * sin(3 * b) AS decl,
    229.18 * (0.000075 + 0.001868 * cos(b) - 0.032077 * sin(b) - 0.014615 * cos(2 * b) - 0.040849 * sin(2 * b)) AS eot,
    1367 * (1.00011 + 0.034221 * cos(b) + 0.00128 * sin(b) + 0.000719 * cos(2 * b) + 0.000077 * sin(2 * b)) AS top FROM a),
  w AS (SELECT *, radians(15 * (h + 7.36 / 15 + eot / 60 - 12)) AS ha FROM e),
  c AS (SELECT *, sin({_PHI}) * sin(decl) + cos({_PHI}) * cos(decl) * cos(ha) AS cz FROM w),
  k AS (SELECT *, least(1, greatest(0, ghi / (top * greatest(cz, 0.065)))) AS kt,
    cz * cos({_BETA}) - sin({_BETA}) * (sin(decl) * cos({_PHI}) - cos(decl) * sin({_PHI}) * cos(ha)) AS ci FROM c),
  d AS (SELECT *, cz >= cos(radians(87)) AS up, ghi * CASE WHEN kt <= 0.22 THEN 1 - 0.09 * kt WHEN kt <= 0.8 THEN
    0.9511 - 0.1604 * kt + 4.388 * kt ** 2 - 16.638 * kt ** 3 + 12.336 * kt ** 4 ELSE 0.165 END AS part FROM k),
  x AS (SELECT *, CASE WHEN up THEN part ELSE ghi END AS dhi, CASE WHEN up THEN (ghi - part) / cz ELSE 0 END AS dni FROM d)"""
POA_TOTAL = f"""greatest(0, greatest(dni, 0) * greatest(ci, 0)
      + greatest(dhi, 0) * (1 + cos({_BETA})) / 2 + ghi * 0.25 * (1 - cos({_BETA})) / 2)"""


@query(
    "capacity_curve",
    f"""WITH {S15}, r AS (SELECT ts, CASE WHEN ghi > 200 THEN coalesce(solar_remote, 0) / (ghi / 1000 * 0.25) END AS ratio,
      CASE WHEN ghi > 200 THEN coalesce(solar_remote, 0) / ghi END AS y FROM s15),
    q AS (SELECT ts, CASE WHEN count(ratio) OVER w >= 96 THEN quantile_cont(ratio, 0.9) OVER w END AS p,
      CASE WHEN count(y) OVER w >= 96 THEN quantile_cont(y, 0.5) OVER w END AS m FROM r {_frame(960, 'ORDER BY ts')}),
    g AS (SELECT ts, last_value(p IGNORE NULLS) OVER (ORDER BY ts) AS p, last_value(m IGNORE NULLS) OVER (ORDER BY ts) AS m FROM q),
    s AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, sum(p) OVER (ORDER BY ts) AS t FROM g WHERE p IS NOT NULL),
    z AS (SELECT i, t FROM s UNION ALL SELECT 0, 0),
    pairs AS (SELECT a.i + 1 AS a, b.i AS b, (b.t - a.t) / (b.i - a.i) AS v FROM z a JOIN z b ON b.i > a.i),
    low AS (SELECT a, b, min(v) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM pairs),
    fit AS (SELECT b AS i, max(v) AS f FROM low GROUP BY 1)
    SELECT g.ts, {q6('fit.f', 4)} AS capacity, {q6('g.m')} AS yield FROM g LEFT JOIN s USING (ts) LEFT JOIN fit USING (i)""",
)
def capacity_curve(spark: Spark, sf: str) -> Frame:
    out = estimate_capacity(series15(spark, sf), SPEC15, 200.0, 10, 96, ["solar_remote"], "ghi")
    return out.select(
        "ts", r6("estimated_solar_capacity_ghi", 4).alias("capacity"), r6("solar_yield_30d").alias("yield")
    )


@query(
    "poa_irradiance",
    f"""WITH {S15}, {POA_SQL} SELECT ts, {q6(POA_TOTAL)} AS poa FROM x""",
)
def poa_irradiance_query(spark: Spark, sf: str) -> Frame:
    grid = series15(spark, sf).select("ts", "ghi")
    return add_poa_irradiance(grid, "ts", "ghi", "poa").select("ts", r6("poa").alias("poa"))
