"""From raw tables to train and test tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from loadspark.functions.calendar import add_cyclical, add_dst, add_holidays, add_temporal, add_working_day
from loadspark.functions.solar import add_poa_irradiance
from loadspark.operators.capacity import GHI, POA, estimate_capacity
from loadspark.operators.clean import clean
from loadspark.operators.fills import fill_both
from loadspark.operators.joins import merge_sources
from loadspark.operators.lags import LAG_VARIABLES, add_lag_features, add_yield_ratio, join_daily, lag_table, yield_table
from loadspark.operators.models import GAP_COLUMN
from loadspark.operators.reshape import ENERGY_NAMES, STATIONS, model_features, rename_map
from loadspark.operators.rolling import add_persistence
from loadspark.operators.split import clip_warmup, exclude_intervals, split_temporal
from loadspark.series import SeriesSpec
from loadspark.session import materialise
from loadspark.sources.files import read_energy_csv, read_forecasts, read_measurements
from loadspark.sources.prepared import read_prepared, run_stamp, write_features, write_versioned

# First test day, and the closed local interval of wrong readings.
SPLIT_DATE = datetime(2024, 10, 1)
BAD_INTERVAL = (datetime(2025, 9, 13, 0, 15), datetime(2025, 9, 17, 0, 0))


@dataclass(frozen=True)
class PrepareConfig:
    energy_csv: str
    weather_dir: str
    out_dir: str
    stations: Sequence[str] = tuple(STATIONS)
    split: datetime = SPLIT_DATE
    warmup_days: int = 9
    tilt: float = 30.0
    azimuth: float = 180.0
    gap: str = "drop"
    yield_mode: str = "days"
    lag_mode: str = "time"
    fit_until: datetime | None = None
    bad_intervals: Sequence[tuple[datetime, datetime]] = (BAD_INTERVAL,)
    spec: SeriesSpec = field(default_factory=SeriesSpec)
    run_ts: str | None = None


def build_features(
    df: DataFrame,
    spec: SeriesSpec,
    tilt: float = 30.0,
    azimuth: float = 180.0,
    yield_mode: str = "days",
    fit_until: datetime | None = None,
    lag_variables: Sequence[str] = tuple(LAG_VARIABLES),
) -> DataFrame:
    """All features of a clean table, in the order their inputs need."""
    out = add_working_day(add_holidays(add_temporal(df)))
    out = add_cyclical(add_dst(out, spec.ts), spec.ts)
    out = add_poa_irradiance(out, spec.ts, GHI, POA, tilt, azimuth)
    out = estimate_capacity(out, spec, 200.0, 30, 96, fit_until=fit_until)
    if yield_mode != "days":
        return add_lag_features(add_yield_ratio(out, spec, window_days=30, mode=yield_mode), spec, lag_variables)
    # The daily tables need raw columns only, and meet the rows in one join.
    yields = yield_table(df, spec, "solar_remote", GHI, window_days=30, out=GAP_COLUMN)
    return join_daily(out, spec, [yields, lag_table(df, spec, lag_variables)])


def split_prepared(
    features: DataFrame,
    spec: SeriesSpec,
    split: datetime,
    warmup_days: int = 9,
    lag_mode: str = "time",
    bad_intervals: Sequence[tuple[datetime, datetime]] = (BAD_INTERVAL,),
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows after warm-up; the test rows carry the week-ago load taken from the unsplit series."""
    train, _ = split_temporal(features, spec, split)
    with_past = add_persistence(features, spec, "load", 7, lag_mode)
    _, test = split_temporal(with_past, spec, split)
    train = clip_warmup(train, spec, days=warmup_days)
    test = clip_warmup(test, spec, split, warmup_days)
    if GAP_COLUMN in test.columns:
        test = fill_both(test, spec, [GAP_COLUMN])
    return train, exclude_intervals(test, "local_timestamp", bad_intervals) if bad_intervals else test


def prepare(spark: SparkSession, config: PrepareConfig) -> tuple[DataFrame, DataFrame, list[str]]:
    """Scan, merge, clean, featurise, split and write. The clean and the feature table are written and read back,
    which also cuts the plan at the points where it would otherwise be computed again."""
    spec, run, out = config.spec, config.run_ts or run_stamp(), config.out_dir
    energy = rename_map(read_energy_csv(spark, config.energy_csv), ENERGY_NAMES)
    forecasts = read_forecasts(spark, config.weather_dir, config.stations)
    measured = read_measurements(spark, config.weather_dir, config.stations)
    merged = materialise(merge_sources(energy, [forecasts, measured], gap=config.gap))
    write_versioned(clean(merged, spec), f"{out}/clean", run)

    cleaned = read_prepared(spark, f"{out}/clean", run)
    featured = build_features(cleaned, spec, config.tilt, config.azimuth, config.yield_mode, config.fit_until)
    write_versioned(featured, f"{out}/features", run)

    featured = read_prepared(spark, f"{out}/features", run)
    names = model_features(featured)
    train, test = split_prepared(
        featured, spec, config.split, config.warmup_days, config.lag_mode, config.bad_intervals
    )
    if train.isEmpty():
        raise ValueError("training table is empty")
    write_versioned(train, f"{out}/train", run)
    write_versioned(test, f"{out}/test", run)
    write_features(spark, names, f"{out}/model_features/run_ts={run}")
    return read_prepared(spark, f"{out}/train", run), read_prepared(spark, f"{out}/test", run), names
