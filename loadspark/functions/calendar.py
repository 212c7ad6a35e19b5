"""Wall-clock, calendar and holiday features as plain column expressions: no shuffle, no lookup pass."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadspark.series import epoch_seconds

# Public holidays on fixed dates as (month, day, name, region).
FIXED_HOLIDAYS = [
    (1, 1, "New Year's Day", "national"),
    (8, 1, "National Day", "national"),
    (12, 25, "Christmas Day", "national"),
    (12, 26, "St. Stephen's Day", "national"),
    (8, 15, "Assumption", "VS"),
    (11, 1, "All Saints", "VS"),
]
# Public holidays as days after Easter Sunday.
EASTER_HOLIDAYS = [
    (1, "Easter Monday", "national"),
    (39, "Ascension", "national"),
    (50, "Whit Monday", "national"),
    (60, "Corpus Christi", "VS"),
]
REGIONS = ("national", "VS")


def utc_to_local(col: Column, tz: str = "Europe/Zurich") -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), col)


def local_to_utc(col: Column, tz: str = "Europe/Zurich") -> Column:
    """Local wall clock to UTC: the repeated autumn hour takes its first pass, the skipped spring hour is null."""
    utc = F.convert_timezone(F.lit(tz), F.lit("UTC"), col)
    return F.when(utc_to_local(utc, tz) == col, utc)


def iso_weekday(col: Column) -> Column:
    """Monday 1 .. Sunday 7."""
    return F.weekday(col) + 1


def add_temporal(df: DataFrame, ts: str = "local_timestamp") -> DataFrame:
    c = F.col(ts)
    return df.withColumns(
        {
            "local_hour": F.hour(c),
            "local_day_of_week": iso_weekday(c),
            "local_month": F.month(c),
            "local_day_of_year": F.dayofyear(c),
            "local_week_of_year": F.weekofyear(c),
            "local_is_weekend": iso_weekday(c) > 5,
        }
    )


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter (Meeus/Jones/Butcher) as integer column arithmetic."""

    def div(a: Column, b: int) -> Column:
        return F.floor(a / b).cast("int")

    golden = year % 19
    century, in_century = div(year, 100), year % 100
    leap_skips, century_rest = div(century, 4), century % 4
    moon_shift = div(century + 8, 25)
    moon_fix = div(century - moon_shift + 1, 3)
    epact = (19 * golden + century - leap_skips - moon_fix + 15) % 30
    leaps, leap_rest = div(in_century, 4), in_century % 4
    to_sunday = (32 + 2 * century_rest + 2 * leaps - epact - leap_rest) % 7
    late = div(golden + 11 * epact + 22 * to_sunday, 451)
    serial = epact + to_sunday - 7 * late + 114
    return F.make_date(year, div(serial, 31), serial % 31 + 1)


def is_holiday(ts: Column, regions: tuple[str, ...] = REGIONS) -> Column:
    """Whether the day of `ts` is a holiday of one of `regions`; computed from the date alone."""
    day = F.to_date(ts)
    fixed = [m * 100 + d for m, d, _, region in FIXED_HOLIDAYS if region in regions]
    moving = [k for k, _, region in EASTER_HOLIDAYS if region in regions]
    return (F.month(day) * 100 + F.dayofmonth(day)).isin(fixed) | F.datediff(day, easter_sunday(F.year(day))).isin(
        moving
    )


def holiday_dim(spark: SparkSession, first_year: int, last_year: int, regions: tuple[str, ...] = REGIONS) -> DataFrame:
    """The same calendar as a table (holiday_date, name, region); edit or replace it for another region."""
    year = F.col("year")
    rows = [
        F.struct(F.make_date(year, F.lit(m), F.lit(d)).alias("holiday_date"), F.lit(n).alias("name"), F.lit(r).alias("region"))
        for m, d, n, r in FIXED_HOLIDAYS
        if r in regions
    ] + [
        F.struct(F.date_add(easter_sunday(year), k).alias("holiday_date"), F.lit(n).alias("name"), F.lit(r).alias("region"))
        for k, n, r in EASTER_HOLIDAYS
        if r in regions
    ]
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return years.select(F.explode(F.array(*rows)).alias("h")).select("h.*")


def add_holidays(df: DataFrame, ts: str = "local_timestamp", dim: DataFrame | None = None) -> DataFrame:
    """Flag holidays by rule, or by a table with a `holiday_date` column when one is given."""
    if dim is None:
        return df.withColumn("local_is_holiday", is_holiday(F.col(ts)))
    days = dim.select(F.col("holiday_date").alias("_day")).distinct().withColumn("_hit", F.lit(True))
    flagged = df.withColumn("_day", F.to_date(ts)).join(days, "_day", "left")
    return flagged.withColumn("local_is_holiday", F.col("_hit").isNotNull()).drop("_day", "_hit")


def add_working_day(df: DataFrame) -> DataFrame:
    return df.withColumn("local_is_working_day", ~F.col("local_is_weekend") & ~F.col("local_is_holiday"))


def add_dst(df: DataFrame, utc: str = "utc_timestamp", local: str = "local_timestamp") -> DataFrame:
    """Summer time is when local is two hours ahead of UTC."""
    hours = F.floor((epoch_seconds(F.col(local)) - epoch_seconds(F.col(utc))) / 3600)
    return df.withColumn("local_is_summer_time", hours == 2)


def add_cyclical(df: DataFrame, ts: str = "utc_timestamp") -> DataFrame:
    """Sine and cosine of hour, weekday, month and day of year."""
    c = F.col(ts)
    turns = {
        "hour": F.hour(c) * (2 * math.pi) / 24,
        "dow": F.weekday(c) * (2 * math.pi) / 7,
        "month": (F.month(c) - 1) * (2 * math.pi) / 12,
        "doy": (F.dayofyear(c) - 1) * (2 * math.pi) / 366,
    }
    return df.withColumns(
        {f"utc_{fn}_{n}": getattr(F, fn)(angle) for n, angle in turns.items() for fn in ("sin", "cos")}
    )


def season(ts: Column) -> Column:
    m = F.month(ts)
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer")
        .otherwise("Autumn")
    )
