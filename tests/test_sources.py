from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loadspark.functions.calendar import utc_to_local
from loadspark.operators.reshape import ENERGY_NAMES, FORECAST_NAMES, MEASUREMENT_NAMES, rename_map
from loadspark.plans.prepare import PrepareConfig, prepare
from loadspark.series import SeriesSpec
from loadspark.session import ensure_checkpoint_dir, materialise
from loadspark.sources.files import latest_files, read_energy_csv, read_forecasts, read_measurements, read_weather_csv
from loadspark.sources.prepared import (
    latest_run,
    load_data_and_features,
    read_features,
    read_prepared,
    run_stamp,
    write_features,
    write_trials,
    write_versioned,
)
from loadspark.sources.readings import (
    LEAD_TIMES,
    forecast_table,
    measurement_table,
    month_counts,
    month_spans,
    read_readings,
    write_readings,
)
from loadspark.streaming.ingest import ingest_readings, ledger
from tests.helpers import formatted, plan, rows


def test_energy_csv(spark, tmp_path):
    lines = ["timestamp," + ",".join(ENERGY_NAMES)]
    lines += ["1/10/22 0:15,0.5,0.4,1,2,#N/A,", "01/10/22 00:30,0.6,#N/A,1,2,3,4", "29/09/2025 23:00,1,1,1,1,1,1", "bad,1,1,1,1,1,1"]
    (tmp_path / "energy.csv").write_text("\n".join(lines))
    out = rename_map(read_energy_csv(spark, str(tmp_path / "energy.csv")), ENERGY_NAMES).collect()
    assert [r.timestamp for r in out] == [datetime(2022, 10, 1, 0, 15), datetime(2022, 10, 1, 0, 30), datetime(2025, 9, 29, 23), None]
    assert (out[0].solar_sierre, out[0].solar_remote, out[1].forecast_load, out[1].solar_remote) == (None, None, None, 4.0)


def _station_csv(folder, station, kind, names, stamps, value, run="2025-01-01_00-00", extra=""):
    head = "timestamp," + ",".join(names) + (f",{extra}" if extra else "")
    body = [f"{t}," + ",".join(str(value + i) for i in range(len(names))) + (",9" if extra else "") for t in stamps]
    (folder / f"{station}_{kind}_{run}.csv").write_text("\n".join([head, *body]))


def test_station_files(spark, tmp_path):
    hours = ["2024-01-01T00:00:00.000000+0000", "2024-01-01T01:00:00.000000+0000"]
    for i, s in enumerate(("sion", "visp")):
        _station_csv(tmp_path, s, "forecast", FORECAST_NAMES, hours, -1.0, "2024-01-01_00-00")
        order = list(FORECAST_NAMES) if i == 0 else list(reversed(FORECAST_NAMES))
        _station_csv(tmp_path, s, "forecast", order, hours[i:], 10.0 * (i + 1), extra="x_0")
    out = {r.timestamp.hour: r.asDict() for r in read_forecasts(spark, str(tmp_path), ["sion", "visp"]).collect()}
    assert out[0]["sion_forecast_temperature"] == 10.0 and out[0]["visp_forecast_temperature"] is None
    assert out[1]["visp_forecast_temperature"] == 24.0 and len(out[0]) == 11
    with pytest.raises(FileNotFoundError):
        read_forecasts(spark, str(tmp_path), ["sion", "bern"])
    assert latest_files(spark, f"{tmp_path}/sion_*.csv")[""].endswith("sion_forecast_2025-01-01_00-00.csv")


def test_measurements_keep_half_hours(spark, tmp_path):
    stamps = [f"2024-01-01T00:{m:02d}:00Z" for m in range(0, 60, 10)]
    quoted = [f'"{c}"' for c in MEASUREMENT_NAMES]
    _station_csv(tmp_path, "sion", "measurement", quoted, stamps, 1.0)
    out = read_measurements(spark, str(tmp_path), ["sion"])
    assert sorted(r.timestamp.minute for r in out.collect()) == [0, 30]


def test_weather_csv_without_offset(spark, tmp_path):
    (tmp_path / "w.csv").write_text("timestamp,v\n2024-07-01 10:00:00,1\n2024-07-01T10:00:00+02:00,2\nnever,3")
    out = read_weather_csv(spark, str(tmp_path / "w.csv")).collect()
    assert [r.timestamp for r in out] == [datetime(2024, 7, 1, 10), datetime(2024, 7, 1, 8), None]


def test_month_spans_clamp():
    spans = month_spans(date(2022, 9, 30), date(2023, 1, 15))
    assert spans[0] == (date(2022, 9, 30), date(2022, 10, 1)) and spans[-1] == (date(2023, 1, 1), date(2023, 1, 15))
    assert len(spans) == 5 and month_spans(date(2023, 1, 1), date(2023, 1, 1)) == []


READING = "ts string, site string, measurement string, field string, prediction int, value double"


def _readings(spark):
    data = []
    for month in (1, 2, 3):
        for hour in range(24):
            for lead in (14, 23, 33, 40):
                data.append((f"2024-{month:02d}-05 {hour:02d}:00:00", "Sion", "PRED_T_2M_ctrl", "Value", lead, float(hour)))
        data.append((f"2024-{month:02d}-06 00:00:00", "Bern", "PRED_T_2M_ctrl", "Value", 15, 1.0))
    return rows(spark, data, READING, "ts")


def test_readings_prune_months_and_push_filters(spark, tmp_path):
    path = str(tmp_path / "readings")
    write_readings(_readings(spark), path)
    out = read_readings(spark, path, datetime(2024, 2, 1), datetime(2024, 3, 1), "Sion", ["PRED_T_2M_ctrl"], LEAD_TIMES)
    text = formatted(out)
    assert ">= 2024-02), (month" in text and "<= 2024-02)]" in text and "EqualTo(site,Sion)" in text
    assert out.count() == 24 * 3 and "month" not in out.columns
    wide = forecast_table(spark, path, datetime(2024, 1, 1), datetime(2024, 4, 1), "Sion").collect()
    # issued at nine: hour = (lead + 9) mod 24 for leads 14, 23 and 33
    assert sorted({r.timestamp.hour for r in wide}) == [8, 18, 23] and len(wide) == 9
    assert wide[0].PRED_GLOB_ctrl is None
    assert measurement_table(spark, path, datetime(2024, 1, 1), datetime(2024, 4, 1), "Sion").count() == 0


def test_ingest_appends_each_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    _readings(spark).where("month(ts) = 1").write.mode("append").parquet(source)
    assert ingest_readings(spark, source, target, state) == 97
    assert ingest_readings(spark, source, target, state) == 0
    _readings(spark).where("month(ts) = 2").write.mode("append").parquet(source)
    assert ingest_readings(spark, source, target, state) == 97
    assert read_readings(spark, target).count() == 194
    assert read_readings(spark, target, datetime(2024, 2, 1)).count() == 97


def test_ingest_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    """The state lies in the table: another session with another scratch folder adds only what is new."""
    source, target = (str(tmp_path / n) for n in ("in", "table"))
    _readings(spark).where("month(ts) = 1").coalesce(1).write.mode("append").parquet(source)
    assert ingest_readings(spark, source, target) == 97
    other = spark.newSession()
    _readings(spark).where("month(ts) = 2").coalesce(1).write.mode("append").parquet(source)
    assert ingest_readings(other, source, target) == 97
    assert ingest_readings(spark, source, target) == 0
    assert read_readings(spark, target).count() == 194
    held = [tuple(r) for r in ledger(spark, target).orderBy("month").collect()]
    assert [(m, n) for m, _, n in held] == [("2024-01", 97), ("2024-02", 97)] and held[0][1] != held[1][1]


def test_months_of_a_range(spark, tmp_path):
    path = str(tmp_path / "readings")
    write_readings(_readings(spark), path)
    out = month_counts(spark, path, date(2024, 1, 31), date(2024, 4, 2)).orderBy("month").collect()
    assert [tuple(r) for r in out] == [
        ("2024-01", date(2024, 1, 31), date(2024, 2, 1), 0), ("2024-02", date(2024, 2, 1), date(2024, 3, 1), 97),
        ("2024-03", date(2024, 3, 1), date(2024, 4, 1), 97), ("2024-04", date(2024, 4, 1), date(2024, 4, 2), 0),
    ]


def test_station_files_are_one_scan_per_header(spark, tmp_path):
    hours = ["2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z"]
    names = [f"s{i}" for i in range(6)]
    for i, s in enumerate(names):
        _station_csv(tmp_path, s, "forecast", FORECAST_NAMES, hours, float(i))
    out = read_forecasts(spark, str(tmp_path), names)
    assert plan(out).split("== Physical Plan ==")[1].count("FileScan csv") == 1
    assert {r["s5_forecast_temperature"] for r in out.collect()} == {5.0}
    half = FORECAST_NAMES.copy()
    half.popitem()
    folder = tmp_path / "mixed"
    folder.mkdir()
    spark.createDataFrame([(hours[0], 1.0)], "timestamp string, PRED_T_2M_ctrl double").write.option("header", True).csv(
        str(folder / "s0_forecast_2025.csv")
    )
    row = read_forecasts(spark, str(folder), ["s0"]).head()
    assert row["s0_forecast_temperature"] == 1.0 and row["s0_forecast_humidity"] is None


def test_versioned_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    write_versioned(spark.range(1), path, "2024-01-01_00-00")
    write_versioned(spark.range(3), path, "2024-01-02_00-00")
    assert latest_run(spark, path) == "2024-01-02_00-00"
    assert read_prepared(spark, path).count() == 3
    assert read_prepared(spark, path, "2024-01-01_00-00").count() == 1
    with pytest.raises(Exception):
        write_versioned(spark.range(1), path, "2024-01-01_00-00")
    write_versioned(spark.range(2), str(tmp_path / "c"), "r", "csv")
    assert read_prepared(spark, str(tmp_path / "c"), fmt="csv").columns == ["id"]
    write_features(spark, ["a", "b"], str(tmp_path / "f"))
    assert read_features(spark, str(tmp_path / "f")) == ["a", "b"]
    assert load_data_and_features(spark, path, str(tmp_path / "f"))[1] == ["a", "b"]
    assert run_stamp(datetime(2024, 1, 2, 3, 4)) == "2024-01-02_03-04"
    with pytest.raises(FileNotFoundError):
        latest_run(spark, str(tmp_path / "f"))


def test_trial_history_is_flat(spark, tmp_path):
    trials = spark.createDataFrame([(0, 0, {"x": 1.0}, 2.0, 2.0)], "trial int, fold int, params map<string,double>, mae double, mean_mae double")
    write_trials(trials, str(tmp_path / "trials"))
    assert spark.read.option("header", True).csv(str(tmp_path / "trials")).head().params == '{"x":1.0}'


def test_stored_tables_live_in_the_shared_folder(spark):
    out = materialise(spark.range(5).withColumn("v", F.lit(1.0)))
    folder = ensure_checkpoint_dir(spark)
    assert out.count() == 5 and all(folder.removeprefix("file:") in f for f in out.inputFiles())


def test_prepare_end_to_end(spark, sf, tmp_path):
    """CSV files cut from the events table, through to train and test tables."""
    grid = spark.sql("select explode(sequence(timestamp_ntz'2024-02-01', timestamp_ntz'2024-04-20', interval 15 minutes)) utc")
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        (F.col("event_id") % 96).alias("slot"), "value"
    ).groupBy("slot").agg(F.avg("value").alias("v"))
    slot = (F.hour("utc") * 4 + F.floor(F.minute("utc") / 15)).alias("slot")
    load = grid.select("utc", slot).join(events, "slot").orderBy("utc").toPandas()
    local = grid.select("utc", utc_to_local(F.col("utc")).alias("l")).orderBy("utc").toPandas()["l"]
    with open(tmp_path / "energy.csv", "w") as f:
        f.write("timestamp," + ",".join(ENERGY_NAMES) + "\n")
        for t, v in zip(local, load.v):
            sun = max(0.0, 12 - abs(t.hour - 13)) / 12
            f.write(f"{t:%d/%m/%y %H:%M},{v + sun},{v},{sun},{sun * 2},{sun * 3},{sun * 4}\n")
    stamps = [t for t in load.utc if t.minute == 0]
    for kind, names in (("forecast", FORECAST_NAMES), ("measurement", [f'"{c}"' for c in MEASUREMENT_NAMES])):
        with open(tmp_path / f"sion_{kind}_2025-01-01_00-00.csv", "w") as f:
            f.write("timestamp," + ",".join(names) + "\n")
            for t in stamps:
                ghi = max(0.0, 6 - abs(t.hour - 12)) * 130
                f.write(f"{t:%Y-%m-%dT%H:%M:%S}.000000+0000," + ",".join([str(5.0 + t.hour / 10), str(ghi), "-1", "50", "10"]) + "\n")
    config = PrepareConfig(
        str(tmp_path / "energy.csv"),
        str(tmp_path),
        str(tmp_path / "out"),
        ["sion"],
        datetime(2024, 4, 1),
        run_ts="2025-01-01_00-00",
        spec=SeriesSpec(bucket_rows=960),
    )
    train, test, features = prepare(spark, config)
    # 5 forecasts, 9 calendar, 8 cyclic, irradiance, 2 capacities, yield, yield ratio, 60 lags
    assert len(features) == 5 + 9 + 8 + 1 + 2 + 1 + 1 + 60
    clean_rows = read_prepared(spark, f"{tmp_path}/out/clean")
    assert clean_rows.agg(F.min("sion_forecast_precipitation")).head()[0] == 0.0
    assert clean_rows.count() == clean_rows.select("utc_timestamp").distinct().count()
    first, last = train.agg(F.min("utc_timestamp"), F.max("utc_timestamp")).head()
    assert first == datetime(2024, 2, 10, 0, 0) and last == datetime(2024, 3, 31, 23, 45)
    assert test.agg(F.min("utc_timestamp")).head()[0] == datetime(2024, 4, 10)
    gaps = test.where("load_persistence_7d is null or load_mean_2d is null or solar_remote_yield_ratio is null")
    assert gaps.count() == 0
    summer = {r[0]: r[1] for r in clean_rows.groupBy(F.to_date("utc_timestamp")).agg(F.count("*")).collect()}
    assert summer[date(2024, 3, 31)] == 96
    assert read_features(spark, f"{tmp_path}/out/model_features/run_ts=2025-01-01_00-00") == features
