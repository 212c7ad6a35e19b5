import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loadspark.functions.calendar import (
    add_cyclical,
    add_dst,
    add_holidays,
    add_temporal,
    add_working_day,
    easter_sunday,
    holiday_dim,
    local_to_utc,
    season,
    utc_to_local,
)
from loadspark.functions.solar import add_poa_irradiance, add_sun_position
from loadspark.operators.joins import energy_to_utc
from tests.helpers import rows


def test_local_to_utc_gap_and_overlap(spark):
    df = rows(spark, [("2023-03-26 01:45:00",), ("2023-03-26 02:15:00",), ("2023-10-29 02:15:00",), ("2023-10-29 03:00:00",)], "t string", "t")
    got = [r.u and str(r.u)[:16] for r in df.select(local_to_utc(F.col("t")).alias("u"), "t").orderBy("t").collect()]
    assert got == ["2023-03-26 00:45", None, "2023-10-29 00:15", "2023-10-29 02:00"]


def test_gap_choices(spark):
    df = rows(spark, [("2023-03-26 01:45:00", 1), ("2023-03-26 02:15:00", 2), ("2023-03-26 03:00:00", 3)], "timestamp string, v int", "timestamp")

    def of(gap):
        return {r.v: r.timestamp and r.timestamp.strftime("%H:%M") for r in energy_to_utc(df, gap=gap).collect()}

    assert of("drop") == {1: "00:45", 3: "01:00"}
    assert of("null") == {1: "00:45", 2: None, 3: "01:00"}
    assert of("copy") == {1: "00:45", 2: "00:45", 3: "01:00"}


def test_year_edges(spark):
    df = rows(spark, [("2023-12-31",), ("2024-02-29",), ("2024-12-30",), ("2024-12-31",)], "local_timestamp string", "local_timestamp")
    got = [
        (r.local_day_of_week, r.local_day_of_year, r.local_week_of_year, r.local_is_weekend)
        for r in add_temporal(df).orderBy("local_timestamp").collect()
    ]
    assert got == [(7, 365, 52, True), (4, 60, 9, False), (1, 365, 1, False), (2, 366, 1, False)]


# Published dates of Easter Sunday.
EASTERS = {1961: (4, 2), 1981: (4, 19), 2000: (4, 23), 2019: (4, 21), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25)}


def test_easter(spark):
    df = spark.createDataFrame([(y,) for y in EASTERS], "y int").select("y", easter_sunday(F.col("y")).alias("d"))
    assert {r.y: (r.d.month, r.d.day) for r in df.collect()} == EASTERS


def test_holidays_by_rule_and_by_table(spark):
    days = spark.sql("select explode(sequence(date'2023-01-01', date'2026-12-31')) d").select(F.col("d").cast("timestamp_ntz").alias("local_timestamp"))
    rule = {r[0] for r in add_holidays(days).where("local_is_holiday").select(F.to_date("local_timestamp")).collect()}
    by_table = add_holidays(days, dim=holiday_dim(spark, 2023, 2026)).where("local_is_holiday")
    assert rule == {r[0] for r in by_table.select(F.to_date("local_timestamp")).collect()}
    # Easter Monday, Ascension, Whit Monday and Corpus Christi of 2024
    assert {date(2024, 4, 1), date(2024, 5, 9), date(2024, 5, 20), date(2024, 5, 30)} <= rule
    assert len([d for d in rule if d.year == 2024]) == 10
    national = holiday_dim(spark, 2024, 2024, ("national",))
    assert national.count() == 7


def test_working_day(spark):
    df = rows(spark, [("2024-04-01",), ("2024-04-02",), ("2024-04-06",)], "local_timestamp string", "local_timestamp")
    out = add_working_day(add_holidays(add_temporal(df))).orderBy("local_timestamp").collect()
    assert [r.local_is_working_day for r in out] == [False, True, False]


def test_dst_flag(spark):
    df = rows(spark, [("2024-01-15 12:00:00",), ("2024-07-15 12:00:00",)], "utc_timestamp string", "utc_timestamp")
    out = add_dst(df.withColumn("local_timestamp", utc_to_local(F.col("utc_timestamp")))).orderBy("utc_timestamp").collect()
    assert [(r.local_timestamp.hour, r.local_is_summer_time) for r in out] == [(13, False), (14, True)]


def test_cyclical(spark):
    df = rows(spark, [("2024-03-04 06:00:00",)], "utc_timestamp string", "utc_timestamp")
    r = add_cyclical(df).head()
    assert r.utc_sin_hour == pytest.approx(1) and r.utc_cos_dow == pytest.approx(1)
    assert r.utc_sin_month == pytest.approx(math.sin(2 * math.pi * 2 / 12))
    assert r.utc_cos_doy == pytest.approx(math.cos(2 * math.pi * 63 / 366))


def test_season(spark):
    df = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-01', interval 1 month)) d")
    got = [r[0] for r in df.select(season(F.col("d"))).collect()]
    assert got == ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Autumn"] * 3 + ["Winter"]


def _day(spark, day: str, ghi: float = 500.0):
    hours = spark.sql(f"select explode(sequence(timestamp_ntz'{day} 00:00', timestamp_ntz'{day} 23:45', interval 15 minutes)) utc")
    return hours.withColumn("ghi", F.lit(ghi))


def test_sun_position(spark):
    """Noon zenith angle is latitude minus declination at the solstices."""
    for day, tilt in (("2024-06-20", 23.44), ("2024-12-21", -23.44)):
        top = add_sun_position(_day(spark, day), "utc").agg(F.max("_cos_z")).head()[0]
        assert math.degrees(math.acos(top)) == pytest.approx(46.23 - tilt, abs=0.2)


def test_plane_of_array(spark):
    day = _day(spark, "2024-06-20")
    flat = add_poa_irradiance(day, "utc", "ghi", "poa", tilt=0.0).where("hour(utc) between 7 and 16")
    assert flat.agg(F.max(F.abs(F.col("poa") - 500.0))).head()[0] < 1e-6
    night = add_poa_irradiance(day.withColumn("ghi", F.lit(0.0)), "utc", "ghi", "poa")
    assert night.agg(F.max("poa")).head()[0] == 0
    sunny = add_sun_position(_day(spark, "2024-12-21"), "utc").select("utc", (F.greatest("_cos_z", F.lit(0.0)) * 800).alias("ghi"))
    best = add_poa_irradiance(sunny, "utc", "ghi", "poa").orderBy(F.desc("poa")).head()
    assert best.poa > 1.3 * best.ghi and 10 <= best.utc.hour <= 12
    east = add_poa_irradiance(day, "utc", "ghi", "poa", tilt=60.0, azimuth=90.0)
    halves = {r.am: r.s for r in east.groupBy((F.hour("utc") < 11).alias("am")).agg(F.sum("poa").alias("s")).collect()}
    morning = east.where("hour(utc) = 7").agg(F.avg("poa")).head()[0]
    evening = east.where("hour(utc) = 16").agg(F.avg("poa")).head()[0]
    assert morning > evening and halves
    unknown = add_poa_irradiance(day.withColumn("ghi", F.lit(None).cast("double")), "utc", "ghi", "poa")
    assert unknown.where("poa is not null").count() == 0
    assert "_kt" not in unknown.columns


def test_split_dates_are_wall_clock(spark):
    df = rows(spark, [("2024-10-01 00:00:00",)], "t string", "t")
    assert df.where(F.col("t") >= F.lit(datetime(2024, 10, 1)).cast("timestamp_ntz")).count() == 1
