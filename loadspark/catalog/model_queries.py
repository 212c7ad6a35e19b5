"""Queries that fit models or run the whole feature chain."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadspark.catalog.registry import query
from loadspark.catalog.series_queries import POA_SQL, POA_TOTAL, YIELD_SQL, lag_sql
from loadspark.catalog.views import HOLIDAYS, daily_orders, day_curve, grid_sql, q6, r6, sql_curve, table
from loadspark.functions.calendar import add_cyclical, add_temporal, utc_to_local
from loadspark.functions.solar import add_poa_irradiance
from loadspark.operators.capacity import GHI, estimate_capacity, production_errors
from loadspark.operators.fills import fill_both
from loadspark.operators.lags import LAG_VARIABLES, add_lag_features
from loadspark.operators.metrics import error_metrics
from loadspark.operators.models import (
    ALPHAS,
    assemble,
    fit_gbt,
    fit_scaler,
    random_search,
    rank_coefficients,
    rank_importance,
    ridge_cv,
)
from loadspark.operators.reshape import SOLAR_COLUMNS, model_features
from loadspark.operators.split import holdout_mask
from loadspark.operators.trees import fit_leafwise
from loadspark.plans.prepare import build_features, split_prepared
from loadspark.plans.train import evaluate, predictions
from loadspark.series import SeriesSpec, resample
from loadspark.session import materialise

Spark, Frame = SparkSession, DataFrame
LINES = SeriesSpec("l_shipdate", (), timedelta(days=1), 90, ("l_orderkey", "l_linenumber"))
UTC = SeriesSpec(bucket_rows=960)
KINDS = dict(zip(SOLAR_COLUMNS, ["view", "purchase", "signup", "click"]))


def clean_table(spark: Spark, sf: str) -> Frame:
    """A table with the columns of the clean energy and weather table, on the quarter-hour grid of the events."""
    of = {c: F.avg(F.when(F.col("event_type") == kind, F.col("value"))) for c, kind in KINDS.items()}
    aggs = {"load": F.avg("value"), "forecast_load": (F.min("value") + F.max("value")) / 2, **of, "sion_measured_temperature": F.max("value")}
    events = table(spark, sf, "events").withColumnRenamed("ts", "utc_timestamp")
    grid = fill_both(resample(events, UTC, aggs), UTC, list(aggs))
    sun = day_curve("utc_timestamp", "load")
    return grid.withColumns(
        {
            "local_timestamp": utc_to_local(F.col("utc_timestamp")),
            GHI: sun,
            "sion_measured_global_radiation": sun * 0.9,
            **{c: F.col(c) * sun / 1000 for c in KINDS},
        }
    )


def feature_table(spark: Spark, sf: str) -> Frame:
    return materialise(build_features(materialise(clean_table(spark, sf)), UTC))


_CLEAN_COLUMNS = ["load", "forecast_load", *KINDS, "sion_measured_temperature"]
_FILLED = ", ".join(
    f"coalesce(first_value({c} IGNORE NULLS) OVER ahead, last_value({c} IGNORE NULLS) OVER behind) AS {c}" for c in _CLEAN_COLUMNS
)
#: The clean table in SQL: `cl` with the instant as ts, ghi, the solar columns and their sum.
CLEAN = f"""raw AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS ts, avg(value) AS load, (min(value) + max(value)) / 2 AS forecast_load,
    {", ".join(f"avg(value) FILTER (WHERE event_type = '{k}') AS {c}" for c, k in KINDS.items())},
    max(value) AS sion_measured_temperature FROM events GROUP BY 1),
  fl AS (SELECT ts, {_FILLED} FROM ({grid_sql('15 MINUTE')}) LEFT JOIN raw USING (ts)
    WINDOW ahead AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), behind AS (ORDER BY ts)),
  sn AS (SELECT *, {sql_curve('ts', 'load')} FROM fl),
  cl AS (SELECT ts, ghi, load, forecast_load, sion_measured_temperature, ghi * 0.9 AS sion_measured_global_radiation,
    {", ".join(f"{c} * ghi / 1000 AS {c}" for c in KINDS)}, ({" + ".join(KINDS)}) * ghi / 1000 AS total FROM sn)"""
_POA_OF = POA_SQL.replace("FROM s15", "FROM cl")
_BACK = "ROWS BETWEEN 2879 PRECEDING AND CURRENT ROW"


def _known(expr: str) -> str:
    return f"CASE WHEN count({expr}) OVER w >= 96 THEN quantile_cont({expr}, {{q}}) OVER w END"


def fit_sql(name: str, source: str, ratio: str) -> str:
    """`name`(ts, fit): the rolling 90 % quantile of a column of `source`, carried on and made non-decreasing."""
    n = name
    return f"""{n}_q AS (SELECT ts, {_known(ratio).format(q=0.9)} AS p FROM {source} WINDOW w AS (ORDER BY ts {_BACK})),
  {n}_g AS (SELECT ts, last_value(p IGNORE NULLS) OVER (ORDER BY ts) AS p FROM {n}_q),
  {n}_s AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, sum(p) OVER (ORDER BY ts) AS t FROM {n}_g WHERE p IS NOT NULL),
  {n}_z AS (SELECT i, t FROM {n}_s UNION ALL SELECT 0, 0),
  {n}_p AS (SELECT a.i + 1 AS a, b.i AS b, (b.t - a.t) / (b.i - a.i) AS v FROM {n}_z a JOIN {n}_z b ON b.i > a.i),
  {n}_l AS (SELECT a, b, min(v) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM {n}_p),
  {n} AS (SELECT ts, f AS fit FROM {n}_s JOIN (SELECT b AS i, max(v) AS f FROM {n}_l GROUP BY 1) USING (i))"""


#: Capacity in SQL: `cap` with both fits and the median yield beside the clean columns.
CAPACITY = f"""{CLEAN}, {_POA_OF}, po AS (SELECT ts, {POA_TOTAL} AS poa FROM x),
  ra AS (SELECT cl.*, poa, CASE WHEN ghi > 200 THEN total / (ghi / 1000 * 0.25) END AS r_ghi,
    CASE WHEN poa > 200 THEN total / (poa / 1000 * 0.25) END AS r_poa, CASE WHEN ghi > 200 THEN total / ghi END AS y
    FROM cl JOIN po USING (ts)),
  {fit_sql('fg', 'ra', 'r_ghi')}, {fit_sql('fp', 'ra', 'r_poa')},
  yq AS (SELECT ts, {_known('y').format(q=0.5)} AS y30 FROM ra WINDOW w AS (ORDER BY ts {_BACK})),
  cap AS (SELECT ra.*, fg.fit AS cap_ghi, fp.fit AS cap_poa, last_value(y30 IGNORE NULLS) OVER (ORDER BY ts) AS y30
    FROM ra JOIN yq USING (ts) LEFT JOIN fg USING (ts) LEFT JOIN fp USING (ts))"""


@query(
    "capacity",
    f"""WITH {CAPACITY} SELECT ts AS utc_timestamp, {q6('cap_ghi', 4)} AS estimated_solar_capacity_ghi,
    {q6('cap_poa', 4)} AS estimated_solar_capacity_poa, {q6('y30', 11)} AS solar_yield_30d FROM cap""",
)
def capacity(spark: Spark, sf: str) -> Frame:
    """Capacity by both irradiances and the median yield."""
    out = estimate_capacity(add_poa_irradiance(materialise(clean_table(spark, sf))), UTC)
    made = {"estimated_solar_capacity_ghi": 4, "estimated_solar_capacity_poa": 4, "solar_yield_30d": 11}
    return out.select("utc_timestamp", *(r6(c, digits).alias(c) for c, digits in made.items()))


_METHODS = {"ghi": "cap_ghi * (ghi / 1000 * 0.25)", "eta": "fe.fit * em * (ghi / 1000 * 0.25)", "poa": "cap_poa * (poa / 1000 * 0.25)", "yield": "y30 * ghi"}
_WITHIN = "OVER (ORDER BY ts ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)"


@query(
    "production_errors",
    f"""WITH {CAPACITY}, mo AS (SELECT month(ts) AS month, quantile_cont(total / (cap_ghi * ghi / 1000 * 0.25), 0.5) AS em FROM cap
      WHERE ghi > 200 AND cap_ghi IS NOT NULL GROUP BY 1),
    wm AS (SELECT cap.*, em, CASE WHEN em IS NOT NULL AND ghi > 200 THEN total / (em * ghi / 1000 * 0.25) END AS r_eta
      FROM cap LEFT JOIN mo ON month(cap.ts) = mo.month),
    {fit_sql('fe', 'wm', 'r_eta')},
    pr AS (SELECT ts, total, {", ".join(f"{e} AS pred_{m}" for m, e in _METHODS.items())} FROM wm LEFT JOIN fe USING (ts)),
    kn AS (SELECT * FROM pr WHERE {" AND ".join(f"pred_{m} IS NOT NULL" for m in _METHODS)} AND total IS NOT NULL)
    SELECT ts AS utc_timestamp, {q6('total')} AS solar_total, {", ".join(f"{q6(f'pred_{m}', 4)} AS pred_{m}" for m in _METHODS)},
      {", ".join(f"{q6(f'pred_{m} - total', 4)} AS err_{m}" for m in _METHODS)},
      {", ".join(q6(f'CASE WHEN count(*) {_WITHIN} >= 96 THEN avg(abs(pred_{m} - total)) {_WITHIN} END', 4) + f' AS mae_{m}' for m in _METHODS)}
    FROM kn""",
)
def production_errors_query(spark: Spark, sf: str) -> Frame:
    """Production rebuilt by four methods, with a second capacity pass by month."""
    out = production_errors(add_poa_irradiance(materialise(clean_table(spark, sf))), UTC)
    made = [c for c in out.columns if c.startswith(("pred_", "err_", "mae_"))]
    return out.select("utc_timestamp", r6("solar_total").alias("solar_total"), *(r6(c, 4).alias(c) for c in made))


_LAGS, _LAG_NAMES = lag_sql("k", "src", "lf", LAG_VARIABLES)
_DAY = "dayofyear(ts) - 1"
_TURNS = {"hour": "hour(ts) / 24.0", "dow": "(isodow(ts) - 1) / 7.0", "month": "(month(ts) - 1) / 12.0", "doy": f"({_DAY}) / 366.0"}
_CALENDAR = """hour(loc) AS local_hour, isodow(loc) AS local_day_of_week, month(loc) AS local_month, dayofyear(loc) AS local_day_of_year,
      weekofyear(loc) AS local_week_of_year, isodow(loc) > 5 AS local_is_weekend, CAST(loc AS DATE) IN (SELECT hd FROM hol) AS local_is_holiday,
      NOT isodow(loc) > 5 AND NOT CAST(loc AS DATE) IN (SELECT hd FROM hol) AS local_is_working_day, FALSE AS local_is_summer_time"""
_RAW = ["load", "forecast_load", *KINDS, "sion_measured_temperature", "sion_measured_global_radiation"]
_MADE = {
    "poa_irradiance": "poa", "estimated_solar_capacity_ghi": "cap_ghi", "estimated_solar_capacity_poa": "cap_poa",
    "solar_yield_30d": "y30", "solar_remote_yield_ratio": "yr.v", GHI: "ghi",
}
#: Digits of columns whose values end early, so that no engine rounds a five the other way.
_DIGITS = {"solar_yield_30d": 11, "estimated_solar_capacity_ghi": 4, "estimated_solar_capacity_poa": 4, **dict.fromkeys(_LAG_NAMES, 8)}


@query(
    "featured_table",
    f"""WITH {CAPACITY}, {HOLIDAYS.replace("orders", "events").replace("o_orderdate", "ts")},
    src AS (SELECT 1 AS k, * FROM cap), {_LAGS}, {YIELD_SQL.format(key='k,', src='src')},
    yr AS (SELECT day, avg(ratio) OVER (ORDER BY day RANGE BETWEEN INTERVAL 31 DAY PRECEDING AND INTERVAL 2 DAY PRECEDING) AS v FROM dy),
    lo AS (SELECT *, ts + INTERVAL 1 HOUR AS loc FROM cap)
    SELECT ts AS utc_timestamp, loc AS local_timestamp, {_CALENDAR},
      {", ".join(f"{q6(c)} AS {c}" for c in _RAW)},
      {", ".join(f"{q6(e, _DIGITS.get(n, 6))} AS {n}" for n, e in _MADE.items())},
      {", ".join(q6(f'{fn}({turn} * 2 * pi())') + f' AS utc_{fn}_{n}' for n, turn in _TURNS.items() for fn in ('sin', 'cos'))},
      {", ".join(f"lf.{n}" for n in _LAG_NAMES)}
    FROM lo JOIN lf USING (ts) LEFT JOIN yr ON yr.day = CAST(ts AS DATE)""",
)
def featured_table(spark: Spark, sf: str) -> Frame:
    """All features of the clean table; its month lies in winter time, which the SQL takes for granted."""
    out = build_features(materialise(clean_table(spark, sf)), UTC)
    double = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.select(*(r6(c, _DIGITS.get(c, 6)).alias(c) if c in double else F.col(c) for c in out.columns))


@query(
    "prepared_baselines",
    f"""WITH {CLEAN}, p AS (SELECT ts, load, forecast_load, lag(load, 672) OVER (ORDER BY ts) AS past FROM cl),
    t AS (SELECT * FROM p WHERE ts >= TIMESTAMP '2024-01-23'),
    e AS (SELECT 'persistence' AS model, load - past AS d FROM t UNION ALL SELECT 'operator', load - forecast_load FROM t)
    SELECT model, {q6('avg(abs(d))', 4)} AS MAE, {q6('sqrt(avg(d * d))', 4)} AS RMSE FROM e GROUP BY 1""",
)
def prepared_baselines(spark: Spark, sf: str) -> Frame:
    """Features, split, warm-up, then the two baselines on the test rows."""
    split = split_prepared(feature_table(spark, sf), UTC, datetime(2024, 1, 20), 3)
    return evaluate(split[1], UTC, {})


_ZQ = "(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()"


@query(
    "standardise",
    f"""SELECT l_orderkey, l_linenumber, {q6(_ZQ)} AS l_quantity,
    {q6('(l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER ()')} AS l_tax FROM lineitem""",
)
def standardise(spark: Spark, sf: str) -> Frame:
    rows = assemble(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])
    scaled = fit_scaler(rows).transform(rows).withColumn("_z", vector_to_array("scaled"))
    return scaled.select(
        "l_orderkey",
        "l_linenumber",
        r6(F.col("_z")[0]).alias("l_quantity"),
        r6(F.col("_z")[1]).alias("l_tax"),
    )


_ALPHAS = ", ".join(f"({i}, CAST({a!r} AS DOUBLE))" for i, a in enumerate(ALPHAS))


@query(
    "ridge_cv",
    f"""WITH z AS (SELECT {_ZQ} AS z, l_extendedprice AS y, row_number() OVER (
      ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER () AS n FROM lineitem),
    f AS (SELECT z, y, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
      ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM z),
    t AS (SELECT k, avg(z) AS mz, avg(y) AS my, regr_sxx(y, z) AS szz, regr_sxy(y, z) AS szy
      FROM f JOIN generate_series(0, 4) AS g(k) ON fold <> k GROUP BY 1),
    c AS (SELECT a, alpha, k, szy / (szz + alpha) AS b, my - szy / (szz + alpha) * mz AS b0
      FROM t CROSS JOIN (VALUES {_ALPHAS}) AS al(a, alpha)),
    r AS (SELECT a, k, 1 - sum((y - b0 - b * z) ** 2) / (var_pop(y) * count(*)) AS r2 FROM c JOIN f ON fold = k GROUP BY 1, 2, b, b0)
    SELECT a AS place, {q6('avg(r2)')} AS mean_r2 FROM r GROUP BY 1""",
)
def ridge_cv_query(spark: Spark, sf: str) -> Frame:
    """Mean R2 over contiguous folds for each penalty; one feature, so that SQL can spell out the solution."""
    fit = ridge_cv(table(spark, sf, "lineitem"), LINES, ["l_quantity"], "l_extendedprice")
    rows = [(i, score) for i, (_, score) in enumerate(fit.scores)]
    return spark.createDataFrame(rows, "place int, score double").select("place", r6("score").alias("mean_r2"))


def _two(name: str) -> str:
    return f"(l_{name} - avg(l_{name}) OVER ()) / stddev_pop(l_{name}) OVER ()"


_SUMS = """count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb,
      covar_pop(a, b) * count(*) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby"""


def _solved(source: str, by: str) -> str:
    det = "((saa + alpha) * (sbb + alpha) - sab * sab)"
    return f"""SELECT {by}, alpha, (say * (sbb + alpha) - sby * sab) / {det} AS ca, (sby * (saa + alpha) - say * sab) / {det} AS cb,
      ma, mb, my FROM {source} CROSS JOIN (VALUES {_ALPHAS}) AS al(place, alpha)"""


@query(
    "ridge_two_features",
    f"""WITH z AS (SELECT {_two('quantity')} AS a, {_two('discount')} AS b, l_extendedprice AS y, row_number() OVER (
      ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER () AS n FROM lineitem),
    f AS (SELECT a, b, y, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
      ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM z),
    t AS (SELECT k, {_SUMS} FROM f JOIN generate_series(0, 4) AS g(k) ON fold <> k GROUP BY 1),
    c AS ({_solved('t', 'k, place')}),
    r AS (SELECT place, k, 1 - sum((y - my - ca * (a - ma) - cb * (b - mb)) ** 2) / (var_pop(y) * count(*)) AS r2
      FROM c JOIN f ON fold = k GROUP BY 1, 2),
    best AS (SELECT place FROM (SELECT place, avg(r2) AS m FROM r GROUP BY 1) ORDER BY m DESC, place LIMIT 1),
    w AS (SELECT 1 AS one, {_SUMS} FROM f), o AS ({_solved('w', 'one, place')})
    SELECT 'l_quantity' AS feature, {q6('ca')} AS coefficient FROM o JOIN best USING (place)
    UNION ALL SELECT 'l_discount', {q6('cb')} FROM o JOIN best USING (place)""",
)
def ridge_two_features(spark: Spark, sf: str) -> Frame:
    """Standardised coefficients of a ridge with two features at the penalty that cross-validation chooses."""
    names = ["l_quantity", "l_discount"]
    fit = ridge_cv(table(spark, sf, "lineitem"), LINES, names, "l_extendedprice")
    return rank_coefficients(spark, names, fit.coefficients, 2).select("feature", r6("coefficient").alias("coefficient"))


@query("ridge_coefficients")
def ridge_coefficients(spark: Spark, sf: str) -> Frame:
    """Largest standardised coefficients of a ridge with several features."""
    names = ["l_quantity", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
    fit = ridge_cv(table(spark, sf, "lineitem"), LINES, names, "l_extendedprice")
    return rank_coefficients(spark, names, fit.coefficients, 3)


def _daily_features(spark: Spark, sf: str) -> tuple[Frame, SeriesSpec, list[str]]:
    """Daily order totals with calendar features and the totals of earlier days."""
    spec = SeriesSpec("utc_timestamp", (), timedelta(days=1), 365)
    daily = daily_orders(spark, sf).select(F.col("dd").cast("timestamp_ntz").alias("utc_timestamp"), "load")
    out = add_cyclical(add_temporal(daily, "utc_timestamp"))
    out = add_lag_features(out, spec, ["load"])
    names = [c for c in model_features(out) if not c.endswith(("_std_2d", "_std_3d", "_cv_2d", "_cv_3d"))]
    return out.where(F.col("load_mean_3d").isNotNull() & F.col("load_cv_week").isNotNull()), spec, names


@query("gbt_l1")
def gbt_l1(spark: Spark, sf: str) -> Frame:
    """Hold-out error of boosted trees with absolute loss and early stopping."""
    rows, spec, names = _daily_features(spark, sf)
    masked = materialise(holdout_mask(rows, spec, 200))
    model = fit_gbt(masked, names, "load", "is_val", n_estimators=10, num_leaves=16, learning_rate=0.2)
    return error_metrics(predictions({"gbt": model}, masked.where("is_val"), spec))


@query("gbt_importance")
def gbt_importance(spark: Spark, sf: str) -> Frame:
    rows, spec, names = _daily_features(spark, sf)
    masked = materialise(holdout_mask(rows, spec, 200))
    model = fit_gbt(masked, names, "load", "is_val", n_estimators=5, num_leaves=16, learning_rate=0.2)
    return rank_importance(spark, model, names, 5)


@query("gbt_leafwise")
def gbt_leafwise(spark: Spark, sf: str) -> Frame:
    """Hold-out error of trees grown by leaf with both penalties, and the error before the first tree."""
    rows, spec, names = _daily_features(spark, sf)
    masked = materialise(holdout_mask(rows, spec, 200))
    more = {"n_estimators": 10, "num_leaves": 16, "learning_rate": 0.2, "reg_alpha": 0.1, "reg_lambda": 1.0}
    model = fit_leafwise(masked, names, "load", "is_val", **more)
    pred = predictions({"gbt": model}, masked.where("is_val"), spec)
    return error_metrics(pred).withColumn("mae_of_median", F.lit(model.errors[0])).withColumn("trees", F.lit(len(model.trees)))


@query("random_search")
def random_search_query(spark: Spark, sf: str) -> Frame:
    """Two draws on two expanding folds."""
    rows, spec, names = _daily_features(spark, sf)
    splits = [datetime(1999, 1, 1), datetime(2000, 6, 1)]
    space = {"learning_rate": (0.05, 0.2, "log"), "num_leaves": (4, 16, "int"), "min_child_samples": (5, 40, "int")}
    trials = random_search(materialise(rows), spec, names, splits, space=space, n_trials=2, n_estimators=4)
    return trials.select("trial", "fold", F.to_json("params").alias("params"), "mae", "mean_mae")

