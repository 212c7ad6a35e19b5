"""Queries over unordered rows: calendar, joins, pivots, profiles, correlations, splits, samples, models."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadspark.catalog.registry import query
from loadspark.catalog.views import (
    DST,
    HOLIDAYS,
    READ,
    S15,
    TO_LOCAL,
    TO_UTC,
    dst_local,
    q6,
    r6,
    readings,
    series15,
    table,
)
from loadspark.functions.calendar import (
    add_cyclical,
    add_dst,
    add_holidays,
    add_temporal,
    add_working_day,
    holiday_dim,
    season,
    utc_to_local,
)
from loadspark.functions.columns import guarded_ratio, sum_horizontal
from loadspark.operators.analysis import (
    binned_mi,
    calendar_summary,
    corr_table,
    day_type_profile,
    profile_mean,
    standard_day_types,
)
from loadspark.operators.capacity import monthly_factor
from loadspark.operators.clean import clip_lower, column_profile, drop_null_rows, nan_to_null
from loadspark.operators.joins import (
    energy_to_utc,
    membership,
    merge_in_local_time,
    merge_sources,
    stations_to_wide,
    union_months,
)
from loadspark.operators.quantiles import group_quantile
from loadspark.operators.reshape import normalise, pairwise_delta, sample_n, to_long, to_wide, top_k
from loadspark.operators.split import (
    between_dates,
    clip_warmup,
    exclude_intervals,
    expanding_folds,
    holdout_mask,
    split_temporal,
)
from loadspark.series import SeriesSpec
from loadspark.sources.readings import select_readings

Spark, Frame = SparkSession, DataFrame
ORDERS = SeriesSpec(ts="o_orderdate", step=timedelta(days=1), bucket_rows=365, tie=("o_orderkey",))
SPLITS = [datetime(1996, 1, 1), datetime(1997, 4, 1), datetime(1999, 7, 1), datetime(2001, 6, 1)]
KINDS = ["click", "error", "purchase", "signup", "view"]


def _q(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"{q6(c, digits)} AS {c}" for c in cols)


# --- calendar ------------------------------------------------------------------------------------------------------


@query(
    "calendar_features",
    """SELECT o_orderkey, hour(t) AS local_hour, isodow(t) AS local_day_of_week, month(t) AS local_month,
    dayofyear(t) AS local_day_of_year, weekofyear(t) AS local_week_of_year, isodow(t) > 5 AS local_is_weekend
    FROM (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey * 7 % 1440 AS BIGINT)) AS t FROM orders)""",
)
def calendar_features(spark: Spark, sf: str) -> Frame:
    t = F.timestamp_add("MINUTE", F.col("o_orderkey") * 7 % 1440, F.col("o_orderdate"))
    out = add_temporal(table(spark, sf, "orders").select("o_orderkey", t.alias("local_timestamp")))
    return out.drop("local_timestamp")


@query(
    "holiday_flag",
    f"""WITH {HOLIDAYS} SELECT o_orderkey, CAST(o_orderdate AS DATE) IN (SELECT hd FROM hol) AS local_is_holiday FROM orders""",
)
def holiday_flag(spark: Spark, sf: str) -> Frame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return add_holidays(orders, "o_orderdate").drop("o_orderdate")


@query(
    "holiday_flag_table",
    f"""WITH {HOLIDAYS} SELECT o_orderkey, CAST(o_orderdate AS DATE) IN (SELECT hd FROM hol) AS local_is_holiday FROM orders""",
)
def holiday_flag_table(spark: Spark, sf: str) -> Frame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return add_holidays(orders, "o_orderdate", holiday_dim(spark, 1900, 2100)).drop("o_orderdate")


@query(
    "working_days_summary",
    f"""WITH {HOLIDAYS}, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
    f AS (SELECT isodow(d) > 5 AS w, d IN (SELECT hd FROM hol) AS h FROM d)
    SELECT count(*) FILTER (WHERE w) AS weekend_days, count(*) FILTER (WHERE h) AS holidays,
      count(*) FILTER (WHERE NOT w AND NOT h) AS working_days FROM f""",
)
def working_days_summary(spark: Spark, sf: str) -> Frame:
    flagged = add_holidays(add_temporal(table(spark, sf, "orders"), "o_orderdate"), "o_orderdate")
    return calendar_summary(add_working_day(flagged), "o_orderdate")


@query(
    "cyclical_features",
    "SELECT event_id, "
    + ", ".join(
        f"{q6(f'{fn}({angle} * 2 * pi() / {n})')} AS utc_{fn}_{name}"
        for name, angle, n in (
            ("hour", "hour(ts)", 24),
            ("dow", "(isodow(ts) - 1)", 7),
            ("month", "(month(ts) - 1)", 12),
            ("doy", "(dayofyear(ts) - 1)", 366),
        )
        for fn in ("sin", "cos")
    )
    + " FROM events",
)
def cyclical_features(spark: Spark, sf: str) -> Frame:
    out = add_cyclical(table(spark, sf, "events").select("event_id", "ts"), "ts")
    return out.select("event_id", *(r6(c).alias(c) for c in out.columns if c.startswith("utc_")))


@query("dst_to_utc", f"WITH {DST} SELECT event_id, local_ts, {TO_UTC} AS utc_ts FROM dst")
def dst_to_utc(spark: Spark, sf: str) -> Frame:
    moved = energy_to_utc(dst_local(spark, sf).withColumn("timestamp", F.col("local_ts")), gap="null")
    return moved.select("event_id", "local_ts", F.col("timestamp").alias("utc_ts"))


@query(
    "dst_gap_copy",
    f"""WITH {DST}, u AS (SELECT event_id, local_ts, {TO_UTC} AS u FROM dst)
    SELECT event_id, local_ts, last_value(u IGNORE NULLS) OVER (ORDER BY local_ts) AS utc_ts FROM u""",
)
def dst_gap_copy(spark: Spark, sf: str) -> Frame:
    moved = energy_to_utc(dst_local(spark, sf).withColumn("timestamp", F.col("local_ts")), gap="copy")
    return moved.select("event_id", "local_ts", F.col("timestamp").alias("utc_ts"))


_LOCAL = TO_LOCAL.format("local_ts")


@query(
    "dst_flag",
    f"""WITH {DST} SELECT event_id, local_ts AS utc_timestamp, {_LOCAL} AS local_timestamp,
    {_LOCAL} - local_ts = INTERVAL 2 HOUR AS local_is_summer_time FROM dst""",
)
def dst_flag(spark: Spark, sf: str) -> Frame:
    both = dst_local(spark, sf).select(
        "event_id", F.col("local_ts").alias("utc_timestamp"), utc_to_local(F.col("local_ts")).alias("local_timestamp")
    )
    return add_dst(both)


# --- joins, pivots, readings ---------------------------------------------------------------------------------------

_WEATHER = """weather AS (SELECT (CASE WHEN event_id % 192 < 96 THEN TIMESTAMP '2023-03-26' ELSE TIMESTAMP '2023-10-29' END)
    + to_minutes(CAST((event_id % 48) * 30 AS BIGINT)) AS ts, avg(value) AS temperature FROM events GROUP BY 1)"""


def _energy(spark: Spark, sf: str) -> Frame:
    return dst_local(spark, sf).groupBy(F.col("local_ts").alias("timestamp")).agg(F.sum("value").alias("load"))


def _weather(spark: Spark, sf: str) -> Frame:
    day = F.when(F.col("event_id") % 192 < 96, F.lit("2023-03-26")).otherwise("2023-10-29").cast("timestamp_ntz")
    slot = F.timestamp_add("MINUTE", (F.col("event_id") % 48) * 30, day)
    return table(spark, sf, "events").groupBy(slot.alias("timestamp")).agg(F.avg("value").alias("temperature"))


@query(
    "merge_sources",
    f"""WITH {DST}, {_WEATHER}, e AS (SELECT local_ts, sum(value) AS load FROM dst GROUP BY 1),
    u AS (SELECT {TO_UTC} AS ts, load FROM e), m AS (SELECT ts, load, temperature FROM
      (SELECT * FROM u WHERE ts IS NOT NULL) FULL JOIN weather USING (ts))
    SELECT ts AS utc_timestamp, {TO_LOCAL.format('ts')} AS local_timestamp, {_q(['load', 'temperature'])} FROM m""",
)
def merge_sources_query(spark: Spark, sf: str) -> Frame:
    out = merge_sources(_energy(spark, sf), [_weather(spark, sf)])
    return out.select("utc_timestamp", "local_timestamp", r6("load").alias("load"), r6("temperature").alias("temperature"))


@query(
    "merge_in_local_time",
    f"""WITH {DST}, {_WEATHER}, e AS (SELECT local_ts AS ts, sum(value) AS load FROM dst GROUP BY 1),
    l AS (SELECT {TO_LOCAL.format('ts')} AS ts, temperature FROM weather)
    SELECT ts AS timestamp, {_q(['load', 'temperature'])} FROM e FULL JOIN l USING (ts)""",
)
def merge_in_local_time_query(spark: Spark, sf: str) -> Frame:
    out = merge_in_local_time(_energy(spark, sf), _weather(spark, sf))
    return out.select("timestamp", r6("load").alias("load"), r6("temperature").alias("temperature"))


@query(
    "issue_hour_pivot",
    f"""WITH {READ} SELECT ts, site, """
    + ", ".join(f"{q6(f'''avg(value) FILTER (WHERE measurement = '{k}')''')} AS {k}" for k in KINDS)
    + " FROM r WHERE (hour(ts) + 24 - prediction) % 24 = 9 GROUP BY 1, 2",
)
def issue_hour_pivot(spark: Spark, sf: str) -> Frame:
    rows = select_readings(readings(spark, sf), issue_hour=9)
    wide = to_wide(rows, ["ts", "site"], "measurement", "value", KINDS, on_duplicate="avg")
    return wide.select("ts", "site", *(r6(k).alias(k) for k in KINDS))


@query(
    "readings_range",
    f"""WITH {READ} SELECT ts, site, measurement, prediction, value FROM r
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND measurement IN ('view', 'click')
    AND prediction IN (14, 15, 16, 17, 18, 19, 20)""",
)
def readings_range(spark: Spark, sf: str) -> Frame:
    return select_readings(
        readings(spark, sf),
        datetime(2024, 1, 5),
        datetime(2024, 1, 25),
        measurements=["view", "click"],
        predictions=list(range(14, 21)),
    )


_SITES = [str(i) for i in range(10)]
_CELLS = dict(zip(KINDS, ["radiation", "precipitation", "humidity", "sunshine_duration", "temperature"]))
_BY_SITE = ", ".join(
    f"max(v) FILTER (WHERE site = {s} AND measurement = '{k}') AS \"{s}_forecast_{v}\"" for s in _SITES for k, v in _CELLS.items()
)


def _stations_wide(spark: Spark, sf: str) -> Frame:
    per_site = to_wide(
        readings(spark, sf).withColumn("site", F.col("site").cast("string")),
        ["ts", "site"],
        "measurement",
        "value",
        {k: f"forecast_{v}" for k, v in _CELLS.items()},
        on_duplicate="max",
    )
    return stations_to_wide(per_site, "ts", "site", _SITES, [f"forecast_{v}" for v in _CELLS.values()])


@query(
    "stations_to_wide",
    f"""WITH {READ}, m AS (SELECT ts, site, measurement, max(value) AS v FROM r GROUP BY 1, 2, 3)
    SELECT ts, {_BY_SITE} FROM m GROUP BY 1""",
)
def stations_to_wide_query(spark: Spark, sf: str) -> Frame:
    return _stations_wide(spark, sf)


@query(
    "pairwise_delta",
    f"""WITH {READ}, m AS (SELECT ts, site, measurement, max(value) AS v FROM r GROUP BY 1, 2, 3),
    w AS (SELECT ts, {_BY_SITE} FROM m GROUP BY 1)
    SELECT ts, """
    + ", ".join(
        f'{q6(f"""{chr(34)}0_forecast_{v}{chr(34)} - {chr(34)}{s}_forecast_{v}{chr(34)}""")} AS delta_{v}_{s}'
        for v in _CELLS.values()
        for s in _SITES[1:]
    )
    + " FROM w",
)
def pairwise_delta_query(spark: Spark, sf: str) -> Frame:
    out = pairwise_delta(_stations_wide(spark, sf), "0", _SITES[1:], list(_CELLS.values()))
    return out.select("ts", *(r6(c).alias(c) for c in out.columns if c.startswith("delta_")))


@query(
    "months_union",
    """SELECT event_id, value, CASE WHEN event_type IN ('click', 'signup') THEN user_id END AS user_id,
    CASE WHEN event_type IN ('purchase', 'signup') THEN props END AS props FROM events""",
)
def months_union(spark: Spark, sf: str) -> Frame:
    """Parts with different columns, one for each event type."""
    has = {"click": ["user_id"], "error": [], "purchase": ["props"], "signup": ["user_id", "props"], "view": []}
    events = table(spark, sf, "events")
    return union_months([events.where(F.col("event_type") == k).select("event_id", "value", *more) for k, more in has.items()])


@query(
    "membership",
    """SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) AS is_rich FROM orders""",
)
def membership_query(spark: Spark, sf: str) -> Frame:
    rich = table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey")
    return membership(table(spark, sf, "orders"), "o_custkey", rich, "is_rich").select("o_orderkey", "is_rich")


# --- projections, nulls, reshaping ---------------------------------------------------------------------------------


@query(
    "clip_lower",
    f"""SELECT event_id, {q6('CASE WHEN v < 0 THEN 0 ELSE v END')} AS v FROM (
    SELECT event_id, CASE WHEN event_type <> 'error' THEN value - 200 END AS v FROM events)""",
)
def clip_lower_query(spark: Spark, sf: str) -> Frame:
    v = F.when(F.col("event_type") != "error", F.col("value") - 200)
    out = clip_lower(table(spark, sf, "events").select("event_id", v.alias("v")), ["v"])
    return out.select("event_id", r6("v").alias("v"))


@query(
    "drop_null_rows",
    """SELECT event_id, value FROM events WHERE event_type <> 'error' AND value >= 1""",
)
def drop_null_rows_query(spark: Spark, sf: str) -> Frame:
    v = F.when(F.col("event_type") != "error", F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value")))
    events = table(spark, sf, "events").select("event_id", v.alias("value"))
    return drop_null_rows(nan_to_null(events))


@query(
    "guarded_ratio",
    f"""SELECT l_orderkey, l_linenumber,
    {q6('CASE WHEN l_quantity > 25 THEN l_extendedprice / (l_quantity / 1000 * 0.25) END', 3)} AS ratio FROM lineitem""",
)
def guarded_ratio_query(spark: Spark, sf: str) -> Frame:
    q = F.col("l_quantity")
    ratio = guarded_ratio(F.col("l_extendedprice"), q / 1000 * 0.25, q, 25)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(ratio, 3).alias("ratio"))


@query(
    "sum_horizontal",
    f"""SELECT l_orderkey, l_linenumber,
    {q6("coalesce(CASE WHEN l_returnflag = 'R' THEN l_tax END, 0) + l_discount + l_quantity")} AS total FROM lineitem""",
)
def sum_horizontal_query(spark: Spark, sf: str) -> Frame:
    parts = [F.when(F.col("l_returnflag") == "R", F.col("l_tax")), F.col("l_discount"), F.col("l_quantity")]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(sum_horizontal(parts)).alias("total"))


@query(
    "unpivot_series",
    f"""WITH {S15} SELECT ts, series, {q6('value')} AS value FROM (SELECT ts, load, forecast_load, ghi FROM s15)
    UNPIVOT INCLUDE NULLS (value FOR series IN (load, forecast_load, ghi))""",
)
def unpivot_series(spark: Spark, sf: str) -> Frame:
    long = to_long(series15(spark, sf), ["ts"], ["load", "forecast_load", "ghi"], "series", "value")
    return long.select("ts", "series", r6("value").alias("value"))


@query(
    "unpivot_lineitem",
    """SELECT measure, count(*) AS n, round(sum(value), 2) AS total FROM (
    UNPIVOT (SELECT l_orderkey, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax
    INTO NAME measure VALUE value) GROUP BY 1""",
)
def unpivot_lineitem(spark: Spark, sf: str) -> Frame:
    long = to_long(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")
    return long.groupBy("measure").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("normalise_max", f"SELECT c_custkey, {q6('c_acctbal / max(c_acctbal) OVER ()')} AS c_acctbal FROM customer")
def normalise_max(spark: Spark, sf: str) -> Frame:
    out = normalise(table(spark, sf, "customer"), ["c_acctbal"], "max", SeriesSpec(ts="c_custkey"))
    return out.select("c_custkey", r6("c_acctbal").alias("c_acctbal"))


@query(
    "normalise_minmax_by_key",
    f"""SELECT o_orderkey, CASE WHEN max(o_totalprice) OVER w = min(o_totalprice) OVER w THEN CAST(0 AS DOUBLE) ELSE
    {q6('(o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w)')} END
    AS o_totalprice FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""",
)
def normalise_minmax_by_key(spark: Spark, sf: str) -> Frame:
    spec = SeriesSpec(ts="o_orderdate", keys=("o_orderpriority",), step=timedelta(days=1))
    out = normalise(table(spark, sf, "orders"), ["o_totalprice"], "minmax", spec)
    return out.select("o_orderkey", r6("o_totalprice").alias("o_totalprice"))


@query("normalise_mean", f"SELECT p_partkey, {q6('p_retailprice / avg(p_retailprice) OVER ()')} AS p_retailprice FROM part")
def normalise_mean(spark: Spark, sf: str) -> Frame:
    out = normalise(table(spark, sf, "part"), ["p_retailprice"], "mean", SeriesSpec(ts="p_partkey"))
    return out.select("p_partkey", r6("p_retailprice").alias("p_retailprice"))


@query(
    "seeded_sample",
    "SELECT * FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 5000",
)
def seeded_sample(spark: Spark, sf: str) -> Frame:
    return sample_n(table(spark, sf, "orders"), 5000, 42, ["o_orderkey"])


# --- profiles and correlations -------------------------------------------------------------------------------------

_PROFILE = [("event_id", "n"), ("ts", ""), ("user_id", "n"), ("event_type", "t"), ("value", "n"), ("props", "t")]


def _profile_sql() -> str:
    parts = []
    for c, kind in _PROFILE:
        x = "CASE WHEN event_type <> 'error' THEN value END" if c == "value" else c
        parts.append(
            f"""SELECT '{c}' AS "column", count(*) - count({x}) AS null_count,
            {f"count(*) FILTER (WHERE {x} = '')" if kind == 't' else 0} AS empty_count,
            {f"count(*) FILTER (WHERE {x} < 0)" if kind == 'n' else 0} AS negative_count,
            CAST(min({x}) AS VARCHAR) AS min_value, CAST(max({x}) AS VARCHAR) AS max_value,
            round((count(*) - count({x})) / count(*) * 100, 1) AS null_pct,
            CASE WHEN (count(*) - count({x})) / count(*) * 100 > 10 THEN 'high (>10%)'
              WHEN (count(*) - count({x})) / count(*) * 100 > 1 THEN 'medium (1-10%)' ELSE 'low (<1%)' END AS severity
            FROM events"""
        )
    return " UNION ALL ".join(parts)


@query("column_profile", _profile_sql())
def column_profile_query(spark: Spark, sf: str) -> Frame:
    return column_profile(
        table(spark, sf, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    )


_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey"]


def _scaled(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / (stddev_samp({x}) * stddev_samp({y}))"


@query(
    "corr_table",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {q6(_scaled(f, 'l_extendedprice'), 3)} AS pearson_r FROM lineitem" for f in _FEATURES
    ),
)
def corr_table_query(spark: Spark, sf: str) -> Frame:
    return corr_table(table(spark, sf, "lineitem"), _FEATURES, "l_extendedprice")


_SEASON = """CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'Winter' WHEN month(l_shipdate) IN (3, 4, 5) THEN 'Spring'
    WHEN month(l_shipdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END"""


@query(
    "corr_by_season",
    " UNION ALL ".join(
        f"SELECT {_SEASON} AS season, '{f}' AS feature, {q6(_scaled(f, 'l_extendedprice'), 3)} AS pearson_r FROM lineitem GROUP BY 1"
        for f in _FEATURES
    ),
)
def corr_by_season(spark: Spark, sf: str) -> Frame:
    rows = table(spark, sf, "lineitem").withColumn("season", season(F.col("l_shipdate")))
    return corr_table(rows, _FEATURES, "l_extendedprice", by=["season"])


@query(
    "top_features",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {q6(f'corr({f}, l_extendedprice)')} AS pearson_r FROM lineitem" for f in _FEATURES
    )
    + ") ORDER BY pearson_r DESC LIMIT 3",
)
def top_features(spark: Spark, sf: str) -> Frame:
    return top_k(corr_table(table(spark, sf, "lineitem"), _FEATURES, "l_extendedprice", scaled=False, digits=6), "pearson_r", 3)


def _bin(c: str) -> str:
    return f"least(31, CAST(floor(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 32) AS INTEGER))"


@query(
    "binned_mi",
    f"""WITH b AS (SELECT {_bin('l_extendedprice')} AS y, {', '.join(f'{_bin(f)} AS {f}' for f in _FEATURES[:3])} FROM lineitem),
    l AS (SELECT feature, x, y, count(*) AS n FROM (UNPIVOT b ON {', '.join(_FEATURES[:3])} INTO NAME feature VALUE x)
      GROUP BY 1, 2, 3),
    t AS (SELECT *, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny,
      sum(n) OVER (PARTITION BY feature) AS nt FROM l)
    SELECT feature, {q6('sum(n / nt * ln(n * nt / (nx * ny)))')} AS importance FROM t GROUP BY 1""",
)
def binned_mi_query(spark: Spark, sf: str) -> Frame:
    out = binned_mi(table(spark, sf, "lineitem"), _FEATURES[:3], "l_extendedprice")
    return out.select("feature", r6("importance").alias("importance"))


_TYPES = {
    "Holiday": "h",
    "Not working day": "(w OR h)",
    "Weekday": "NOT w",
    "Weekend": "w",
    "Working day": "NOT (w OR h)",
}


@query(
    "day_type_profile",
    f"""WITH {HOLIDAYS.replace('orders', 'lineitem').replace('o_orderdate', 'l_shipdate')},
    f AS (SELECT l_linenumber, l_extendedprice AS load, isodow(l_shipdate) > 5 AS w,
      CAST(l_shipdate AS DATE) IN (SELECT hd FROM hol) AS h FROM lineitem)
    """
    + " UNION ALL ".join(
        f"""SELECT l_linenumber, '{n}' AS day_type, {q6('avg(load)', 4)} AS mean_load, {q6('stddev_samp(load)', 4)} AS std_load
        FROM f WHERE {c} GROUP BY 1"""
        for n, c in _TYPES.items()
    ),
)
def day_type_profile_query(spark: Spark, sf: str) -> Frame:
    rows = table(spark, sf, "lineitem").select("l_linenumber", "l_shipdate", F.col("l_extendedprice").alias("load"))
    flagged = add_working_day(add_holidays(add_temporal(rows, "l_shipdate"), "l_shipdate"))
    out = day_type_profile(flagged, standard_day_types(), "load", "l_linenumber")
    return out.select("l_linenumber", "day_type", r6("mean_load", 4).alias("mean_load"), r6("std_load", 4).alias("std_load"))


@query(
    "month_hour_heatmap",
    f"""SELECT month(ts) AS month, hour(ts) AS hour, {q6('avg(value)')} AS value FROM events GROUP BY 1, 2""",
)
def month_hour_heatmap(spark: Spark, sf: str) -> Frame:
    out = profile_mean(table(spark, sf, "events"), {"month": F.month("ts"), "hour": F.hour("ts")}, ["value"])
    return out.select("month", "hour", r6("value").alias("value"))


@query(
    "weekday_profile",
    f"""SELECT isodow(o_orderdate) AS weekday, {q6('avg(o_totalprice)', 4)} AS o_totalprice FROM orders GROUP BY 1""",
)
def weekday_profile(spark: Spark, sf: str) -> Frame:
    out = profile_mean(table(spark, sf, "orders"), {"weekday": F.weekday("o_orderdate") + 1}, ["o_totalprice"])
    return out.select("weekday", r6("o_totalprice", 4).alias("o_totalprice"))


@query(
    "monthly_eta",
    f"""SELECT month(l_shipdate) AS month, {q6('median(l_extendedprice / (l_quantity * g / 1000 * 0.25))')} AS eta_month
    FROM (SELECT *, (l_tax + 0.01) * 10000 AS g FROM lineitem) WHERE g > 200 GROUP BY 1""",
)
def monthly_eta(spark: Spark, sf: str) -> Frame:
    rows = table(spark, sf, "lineitem").withColumn("g", (F.col("l_tax") + 0.01) * 10000)
    out = monthly_factor(rows, SeriesSpec(ts="l_shipdate"), "l_extendedprice", "l_quantity", "g")
    return out.select("month", r6("eta_month").alias("eta_month"))


@query(
    "group_quantile",
    f"""SELECT l_returnflag, {q6('quantile_cont(l_extendedprice, 0.9)', 4)} AS p90 FROM lineitem GROUP BY 1""",
)
def group_quantile_query(spark: Spark, sf: str) -> Frame:
    out = group_quantile(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.9, "p90")
    return out.select("l_returnflag", r6("p90", 4).alias("p90"))


# --- splits --------------------------------------------------------------------------------------------------------


@query(
    "temporal_split",
    """WITH s AS (SELECT o_orderkey, o_orderdate AS d, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'test'
      END AS part, (SELECT min(o_orderdate) FROM orders) AS first FROM orders)
    SELECT o_orderkey, part FROM s WHERE (part = 'train' AND d >= first + INTERVAL 9 DAY)
      OR (part = 'test' AND d >= TIMESTAMP '1999-01-10'
        AND NOT d BETWEEN TIMESTAMP '2000-02-01' AND TIMESTAMP '2000-03-01')""",
)
def temporal_split(spark: Spark, sf: str) -> Frame:
    at = datetime(1999, 1, 1)
    train, test = split_temporal(table(spark, sf, "orders"), ORDERS, at)
    train = clip_warmup(train, ORDERS, days=9)
    test = exclude_intervals(
        clip_warmup(test, ORDERS, at, 9), "o_orderdate", [(datetime(2000, 2, 1), datetime(2000, 3, 1))]
    )
    return train.select("o_orderkey", F.lit("train").alias("part")).unionByName(
        test.select("o_orderkey", F.lit("test").alias("part"))
    )


@query(
    "warmup_by_key",
    """SELECT event_id FROM (SELECT event_id, ts, min(ts) OVER (PARTITION BY user_id) AS first FROM events)
    WHERE ts >= first + INTERVAL 9 DAY""",
)
def warmup_by_key(spark: Spark, sf: str) -> Frame:
    return clip_warmup(table(spark, sf, "events"), SeriesSpec("ts", ("user_id",)), days=9).select("event_id")


@query(
    "between_dates",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'""",
)
def between_dates_query(spark: Spark, sf: str) -> Frame:
    rows = between_dates(table(spark, sf, "orders"), "o_orderdate", datetime(1996, 3, 1).date(), datetime(1998, 2, 28).date())
    return rows.select("o_orderkey", "o_totalprice")


@query(
    "expanding_folds",
    " UNION ALL ".join(
        f"""SELECT o_orderkey, {i} AS fold, CASE WHEN o_orderdate < TIMESTAMP '{at}' THEN 'fit' ELSE 'val' END AS role
        FROM orders WHERE o_orderdate < TIMESTAMP '{at}' + INTERVAL 90 DAY"""
        for i, at in enumerate(SPLITS)
    ),
)
def expanding_folds_query(spark: Spark, sf: str) -> Frame:
    return expanding_folds(table(spark, sf, "orders"), ORDERS, SPLITS).select("o_orderkey", "fold", "role")


@query(
    "holdout_mask",
    """SELECT o_orderkey, o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY AS is_val FROM orders""",
)
def holdout_mask_query(spark: Spark, sf: str) -> Frame:
    return holdout_mask(table(spark, sf, "orders"), ORDERS).select("o_orderkey", "is_val")
