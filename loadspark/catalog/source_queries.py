"""Queries that write files of the reference's layouts from the given tables and read them with the file sources."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadspark.catalog.registry import query
from loadspark.catalog.views import READ, S15, q6, r6, readings, series15, table
from loadspark.operators.models import assemble, fit_scaler, load_model, save_model
from loadspark.operators.reshape import (
    CATEGORIES,
    ENERGY_NAMES,
    FORECAST_NAMES,
    MEASUREMENT_NAMES,
    STATIONS,
    categorise_features,
    drop_matching,
    model_features,
    rename_map,
    rename_weather,
    reorder,
    to_long,
    to_wide,
)
from loadspark.session import ensure_checkpoint_dir
from loadspark.sources.files import read_energy_csv, read_forecasts, read_measurements, read_weather_csv
from loadspark.sources.prepared import (
    load_data_and_features,
    read_prepared,
    write_features,
    write_trials,
    write_versioned,
)
from loadspark.sources.readings import forecast_table, measurement_table, month_counts, write_readings
from loadspark.streaming.ingest import ingest_readings, ledger

Spark, Frame = SparkSession, DataFrame
KINDS = ["click", "error", "purchase", "signup", "view"]
#: The event type that stands for each raw weather column, and the station each tenth of the users stands for.
FORECAST_KINDS = dict(zip(KINDS, FORECAST_NAMES))
MEASUREMENT_KINDS = dict(zip(KINDS, MEASUREMENT_NAMES))


def _folder(spark: Spark) -> str:
    """A new folder in the shared store."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _round(df: Frame, keep: list[str], digits: int = 6) -> Frame:
    return df.select(*keep, *(r6(c, digits).alias(c) for c in df.columns if c not in keep))


def _q(cols: list[str]) -> str:
    return ", ".join(f"{q6(c)} AS {c}" for c in cols)


_ENERGY = ["load", "forecast_load", "solar_central_valais", "solar_sion", "solar_sierre", "solar_remote"]
_ENERGY_SQL = "load, forecast_load, ghi AS solar_central_valais, ghi * 2 AS solar_sion, load + ghi AS solar_sierre, solar_remote"


@query("source_energy_csv", f"WITH {S15}, e AS (SELECT ts, {_ENERGY_SQL} FROM s15) SELECT ts AS timestamp, {_q(_ENERGY)} FROM e")
def source_energy_csv(spark: Spark, sf: str) -> Frame:
    """Energy rows written as CSV in both date formats, missing cells as #N/A, and read back."""
    s = series15(spark, sf)
    short = F.concat_ws("/", F.dayofmonth("ts"), F.month("ts"), F.date_format("ts", "yy"))
    stamp = F.when(F.hour("ts") % 2 == 0, F.concat_ws(" ", short, F.date_format("ts", "H:mm"))).otherwise(
        F.date_format("ts", "dd/MM/yyyy HH:mm")
    )
    made = [F.col("load"), F.col("forecast_load"), F.col("ghi"), F.col("ghi") * 2, F.col("load") + F.col("ghi"), F.col("solar_remote")]
    raw = s.select(stamp.alias("timestamp"), *(c.alias(n) for c, n in zip(made, ENERGY_NAMES, strict=True)))
    path = f"{_folder(spark)}/energy.csv"
    raw.write.option("header", True).option("nullValue", "#N/A").csv(path)
    return _round(rename_map(read_energy_csv(spark, path), ENERGY_NAMES), ["timestamp"])


def _station_cells(spark: Spark, sf: str, kinds: dict[str, str], minutes: int) -> Frame:
    """One row per station and step, the mean of each event type under its raw weather name."""
    step = F.window("ts", f"{minutes} minutes").start
    station = F.element_at(F.array(*(F.lit(s) for s in STATIONS)), (F.col("user_id") % 10 + 1).cast("int"))
    rows = table(spark, sf, "events").select(
        F.date_format(step, "yyyy-MM-dd'T'HH:mm:ss'.000000+0000'").alias("timestamp"), station.alias("station"), "event_type", "value"
    )
    return to_wide(rows, ["timestamp", "station"], "event_type", "value", kinds, on_duplicate="avg")


def _write_stations(spark: Spark, cells: Frame, kind: str) -> str:
    folder = _folder(spark)
    first = cells.where(F.col("station") == STATIONS[0]).drop("station")
    first.limit(1).write.option("header", True).csv(f"{folder}/{STATIONS[0]}_{kind}_2024-01-01_00-00.csv")
    cells = cells.persist()
    for s in STATIONS:
        mine = cells.where(F.col("station") == s).drop("station").withColumn("x_0", F.lit(0))
        mine.coalesce(1).write.option("header", True).csv(f"{folder}/{s}_{kind}_2025-01-01_00-00.csv")
    cells.unpersist()
    return folder


def _stations_sql(kinds: dict[str, str], names: dict[str, str], minutes: int, where: str = "") -> str:
    cols = [
        f"avg(value) FILTER (WHERE user_id % 10 = {i} AND event_type = '{k}') AS {s}_{names[raw]}"
        for i, s in enumerate(STATIONS)
        for k, raw in kinds.items()
    ]
    out = [f"{s}_{names[raw]}" for s in STATIONS for raw in kinds.values()]
    return f"""WITH w AS (SELECT time_bucket(INTERVAL {minutes} MINUTE, ts) AS timestamp, {", ".join(cols)} FROM events GROUP BY 1)
    SELECT timestamp, {_q(out)} FROM w {where}"""


@query("source_station_forecasts", _stations_sql(FORECAST_KINDS, FORECAST_NAMES, 60))
def source_station_forecasts(spark: Spark, sf: str) -> Frame:
    """Hourly forecasts of ten stations, one folder of CSV files each, the latest of them merged on the instant."""
    folder = _write_stations(spark, _station_cells(spark, sf, FORECAST_KINDS, 60), "forecast")
    return _round(read_forecasts(spark, folder), ["timestamp"])


@query(
    "source_station_measurements",
    _stations_sql(MEASUREMENT_KINDS, MEASUREMENT_NAMES, 10, "WHERE minute(timestamp) IN (0, 30)"),
)
def source_station_measurements(spark: Spark, sf: str) -> Frame:
    """Ten-minute measurements of ten stations, of which the full and half hours are kept."""
    folder = _write_stations(spark, _station_cells(spark, sf, MEASUREMENT_KINDS, 10), "measurement")
    return _round(read_measurements(spark, folder), ["timestamp"])


_WEATHER = list(FORECAST_NAMES.values())


@query(
    "source_weather_csv",
    "WITH w AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp, "
    + ", ".join(f"avg(value) FILTER (WHERE event_type = '{k}') AS {FORECAST_NAMES[raw]}" for k, raw in FORECAST_KINDS.items())
    + f" FROM events GROUP BY 1) SELECT timestamp, {_q(_WEATHER)} FROM w",
)
def source_weather_csv(spark: Spark, sf: str) -> Frame:
    """A weather table with offsets other than UTC and pivot artefacts, renamed and put in order."""
    utc = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = table(spark, sf, "events").select(utc.alias("timestamp"), "event_type", "value")
    wide = to_wide(rows, ["timestamp"], "event_type", "value", FORECAST_KINDS, on_duplicate="avg")
    east = F.date_format(F.timestamp_add("HOUR", F.lit(2), F.col("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'+0200'")
    path = f"{_folder(spark)}/weather.csv"
    wide.withColumn("timestamp", east).withColumn("extra_0", F.lit(1)).write.option("header", True).csv(path)
    return _round(rename_weather(read_weather_csv(spark, path)), ["timestamp"])


@query("source_prepared", "SELECT event_id, user_id, event_type, value FROM events WHERE event_type <> 'error'")
def source_prepared(spark: Spark, sf: str) -> Frame:
    """Two runs of a table in both formats and a list of columns; the latest run is read with the columns listed."""
    folder, events = _folder(spark), table(spark, sf, "events")
    names = ["event_id", "user_id", "event_type", "value"]
    for fmt in ("csv", "parquet"):
        write_versioned(events.where("event_type = 'error'"), f"{folder}/{fmt}", "2024-01-01_00-00", fmt)
    latest = write_versioned(events.where("event_type <> 'error'"), f"{folder}/parquet", "2024-01-02_00-00")
    write_versioned(spark.read.parquet(latest), f"{folder}/csv", "2024-01-02_00-00", "csv")
    write_features(spark, names, f"{folder}/features")
    binary, listed = load_data_and_features(spark, f"{folder}/parquet", f"{folder}/features")
    text = read_prepared(spark, f"{folder}/csv", fmt="csv").select(
        *(F.col(c).cast(binary.schema[c].dataType).alias(c) for c in listed)
    )
    # Rows of which either format lost something would come out once only.
    return binary.select(*listed).intersectAll(text)


@query(
    "source_trials",
    """SELECT event_id AS trial, user_id % 4 AS fold, '{"rate":' || CAST(value AS VARCHAR) || '}' AS params, value AS mae FROM events""",
)
def source_trials(spark: Spark, sf: str) -> Frame:
    """A trial history written as flat CSV, its parameters as JSON text."""
    path = f"{_folder(spark)}/trials"
    params = F.create_map(F.lit("rate"), "value").alias("params")
    write_trials(table(spark, sf, "events").select(F.col("event_id").alias("trial"), (F.col("user_id") % 4).alias("fold"), params, F.col("value").alias("mae")), path)
    schema = "trial long, fold long, params string, mae double"
    return spark.read.schema(schema).option("header", True).option("escape", "\\").csv(path)


_Z = "(l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER ()"


@query("source_model", f"SELECT l_orderkey, l_linenumber, {q6(_Z)} AS scaled FROM lineitem")
def source_model(spark: Spark, sf: str) -> Frame:
    """A fitted model stored, loaded and applied."""
    from pyspark.ml.functions import vector_to_array

    rows = assemble(table(spark, sf, "lineitem"), ["l_quantity"])
    path = f"{_folder(spark)}/model"
    save_model(fit_scaler(rows), path)
    out = load_model(path).transform(rows).withColumn("z", vector_to_array("scaled")[0])
    return out.select("l_orderkey", "l_linenumber", r6("z").alias("scaled"))


def _stored_readings(spark: Spark, sf: str, names: dict[str, str]) -> str:
    """Readings under raw weather names, one per instant, site, name and lead time, stored by month."""
    raw = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("measurement"))
    rows = readings(spark, sf).groupBy(
        "ts", F.col("site").cast("string").alias("site"), raw.alias("measurement"), F.lit("Value").alias("field"), "prediction"
    )
    path = f"{_folder(spark)}/readings"
    write_readings(rows.agg(F.max("value").alias("value")), path)
    return path


def _table_sql(kinds: dict[str, str], names: dict[str, str], where: str) -> str:
    cells = ", ".join(f"max(value) FILTER (WHERE measurement = '{k}') AS {names[raw]}" for k, raw in kinds.items())
    return f"WITH {READ} SELECT ts AS timestamp, {cells} FROM r WHERE site = 3 AND {where} GROUP BY 1"


@query(
    "source_forecast_table",
    _table_sql(FORECAST_KINDS, FORECAST_NAMES, "prediction = 14 + (hour(ts) + 1) % 24 AND (hour(ts) + 24 - prediction) % 24 = 9"),
)
def source_forecast_table(spark: Spark, sf: str) -> Frame:
    """Forecasts of one site issued at nine, read from the monthly table and spread to columns.

    Every hour has one lead time that was issued at nine, or two a day apart; only the shorter is stored.
    """
    path = _stored_readings(spark, sf, FORECAST_KINDS)
    out = forecast_table(spark, path, datetime(2024, 1, 1), datetime(2024, 2, 1), "3")
    return rename_weather(out)


@query("source_month_counts", """SELECT strftime(ts, '%Y-%m') AS month, DATE '2024-01-05' AS first, DATE '2024-01-25' AS stop, count(*) AS readings
    FROM (SELECT DISTINCT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, user_id % 10 AS site, event_type,
      CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS lead FROM events)
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1""")
def source_month_counts(spark: Spark, sf: str) -> Frame:
    """Readings found per month of a range whose ends are cut to it."""
    return month_counts(spark, _stored_readings(spark, sf, FORECAST_KINDS), date(2024, 1, 5), date(2024, 1, 25))


@query(
    "source_measurement_table",
    f"""WITH {READ} SELECT ts AS timestamp, """
    + ", ".join(f"max(value) FILTER (WHERE measurement = '{k}') AS {MEASUREMENT_NAMES[raw]}" for k, raw in MEASUREMENT_KINDS.items())
    + " FROM r WHERE site = 3 GROUP BY 1",
)
def source_measurement_table(spark: Spark, sf: str) -> Frame:
    """Measurements of one site, read from the monthly table and spread to columns."""
    raw = F.element_at(F.create_map(*(F.lit(x) for pair in MEASUREMENT_KINDS.items() for x in pair)), F.col("measurement"))
    rows = readings(spark, sf).groupBy("ts", F.col("site").cast("string").alias("site"), raw.alias("measurement"))
    path = f"{_folder(spark)}/readings"
    made = rows.agg(F.max("value").alias("value")).withColumns({"field": F.lit("Value"), "prediction": F.lit(None).cast("int")})
    write_readings(made, path)
    out = measurement_table(spark, path, datetime(2024, 1, 1), datetime(2024, 2, 1), "3")
    return rename_map(out, MEASUREMENT_NAMES)


@query(
    "source_ingest",
    """SELECT strftime(ts, '%Y-%m') AS month, event_type AS measurement, count(*) AS rows, min(ts) AS first, max(ts) AS last
    FROM events GROUP BY 1, 2""",
)
def source_ingest(spark: Spark, sf: str) -> Frame:
    """Reading files that arrive one after another, each appended once; counts agree with the table's own ledger."""
    folder = _folder(spark)
    events = table(spark, sf, "events").select(
        "ts", F.lit("s").alias("site"), F.col("event_type").alias("measurement"), F.lit("Value").alias("field"),
        F.lit(None).cast("int").alias("prediction"), "value",
    )
    for kind in KINDS:
        events.where(F.col("measurement") == kind).write.mode("append").parquet(f"{folder}/in")
        ingest_readings(spark, f"{folder}/in", f"{folder}/table")
    held = ledger(spark, f"{folder}/table").groupBy("month").agg(F.sum("rows").alias("held"))
    rows = spark.read.parquet(f"{folder}/table").groupBy("month", "measurement").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    whole = rows.groupBy("month").agg(F.sum("rows").alias("whole"))
    fine = whole.join(held, "month").where("whole = held").select("month")
    return rows.join(fine, "month", "left_semi").select("month", "measurement", "rows", "first", "last")


_FEATURES = {
    "utc_sin_hour": "sin(hour(ts))", "load_mean_3d": "load", "sion_forecast_temperature": "forecast_load", "poa_irradiance": "ghi",
    "local_is_holiday": "hour(ts) / 24.0", "visp_delta": "solar_remote",
}
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(feature, '{p}') THEN '{c}'" for c, p in CATEGORIES.items()) + " ELSE 'Other' END"


@query(
    "feature_catalogue",
    f"""WITH {S15}, f AS ("""
    + " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({e} AS DOUBLE) AS v FROM s15" for n, e in _FEATURES.items())
    + f") SELECT feature, {_CATEGORY} AS category, count(v) AS known, {q6('avg(v)')} AS mean FROM f GROUP BY 1, 2",
)
def feature_catalogue(spark: Spark, sf: str) -> Frame:
    """Feature columns chosen by name, their categories, and how many of their values are known."""
    s = series15(spark, sf)
    made = s.select(F.col("ts").alias("utc_timestamp"), "*", *(F.expr(e).cast("double").alias(n) for n, e in _FEATURES.items()))
    # Targets, clocks, raw columns and helpers go; what is left are features.
    wide = reorder(drop_matching(made.withColumn("_helper_x", F.lit(1.0)), ["_helper"], ["ghi"]).drop("ts"), ["utc_timestamp"])
    names = model_features(wide)
    long = to_long(wide, ["utc_timestamp"], names, "feature", "v")
    counted = long.groupBy("feature").agg(F.count("v").alias("known"), r6(F.avg("v")).alias("mean"))
    return categorise_features(counted).select("feature", "category", "known", "mean")
