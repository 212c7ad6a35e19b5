"""Cleaning, joins, reshaping, splits, profiles and metrics on literal rows."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loadspark.functions.columns import sum_horizontal, variation
from loadspark.operators.analysis import (
    calendar_summary,
    corr_table,
    importance_share,
    lag_autocorr,
    mutual_information,
)
from loadspark.operators.clean import cells_filled, clean, clip_lower, column_profile, drop_null_rows, nan_to_null
from loadspark.operators.joins import merge_sources, stations_to_wide
from loadspark.operators.lags import add_lag_features, add_yield_ratio, daily_stats
from loadspark.operators.metrics import compare_models, error_metrics, hourly_error_metrics, long_predictions
from loadspark.operators.quantiles import group_quantile
from loadspark.operators.reshape import (
    categorise_features,
    drop_by_suffix,
    drop_matching,
    model_features,
    normalise,
    rename_weather,
    reorder,
    sample_n,
    to_wide,
    top_k,
)
from loadspark.operators.split import clip_warmup, exclude_intervals, expanding_folds, holdout_mask, split_temporal
from loadspark.series import SeriesSpec
from tests.helpers import plan, rows, series

TS = SeriesSpec("ts", ())
NAN = float("nan")


def test_nulls_and_nan(spark):
    df = spark.createDataFrame([(None,), (NAN,), (-1.0,), (0.0,), (2.0,)], "x double")
    clipped = [r.x for r in clip_lower(df, ["x"]).where("x is null or not isnan(x)").collect()]
    assert clipped == [None, 0.0, 0.0, 2.0]
    assert drop_null_rows(df).count() == 4
    assert drop_null_rows(nan_to_null(df)).count() == 3
    p = column_profile(df).head()
    assert (p.null_count, p.negative_count, p.null_pct, p.severity) == (1, 1, 20.0, "high (>10%)")


def test_profile_counts_empty_text(spark):
    p = column_profile(spark.createDataFrame([("",), ("a",), (None,)], "s string")).head()
    assert (p.empty_count, p.null_count, p.min_value, p.max_value) == (1, 1, "", "a")


def test_profile_of_empty_table(spark):
    p = column_profile(spark.createDataFrame([], "s string, x double")).collect()
    assert [(r.column, r.null_count, r.null_pct) for r in p] == [("s", 0, None), ("x", 0, None)]


def test_clean_drops_the_incomplete_start(spark):
    data = [("2024-01-01 00:00:00", None, 1.0), ("2024-01-01 00:15:00", -3.0, 2.0), ("2024-01-01 00:30:00", None, None)]
    df = rows(spark, data, "ts string, sion_forecast_humidity double, load double", "ts")
    out = clean(df, TS)
    assert [(r[1], r[2]) for r in out.orderBy("ts").collect()] == [(0.0, 2.0), (0.0, 2.0)]
    assert cells_filled(df, out).head()[0] == 3


def test_horizontal_sum_and_variation(spark):
    df = spark.createDataFrame([(None, 2.0), (1.0, None), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(sum_horizontal(["a", "b"])).collect()] == [2.0, 1.0, 0.0]
    cv = spark.createDataFrame([(1.0, 0.0), (1.0, -2.0)], "s double, m double").select(variation(F.col("s"), F.col("m")))
    assert [r[0] for r in cv.collect()] == [None, 0.5]


def test_pivot_reports_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "t int, m string, v double")
    with pytest.raises(PySparkException):
        to_wide(df, ["t"], "m", "v", ["a"]).collect()
    assert to_wide(df, ["t"], "m", "v", ["a"], "sum").head().a == 3.0
    assert to_wide(df.limit(1), ["t"], "m", "v", {"a": "first_one"}).columns == ["t", "first_one"]


def test_stations_report_duplicates_and_keep_gaps(spark):
    df = spark.createDataFrame([(1, "x", 1.0, None), (2, "y", 2.0, 5.0)], "t int, s string, a double, b double")
    out = {r.t: r.asDict() for r in stations_to_wide(df, "t", "s", ["x", "y"], ["a", "b"]).collect()}
    assert out[1] == {"t": 1, "x_a": 1.0, "x_b": None, "y_a": None, "y_b": None}
    assert stations_to_wide(df, "t", "s", ["x", "y"], ["a"]).columns == ["t", "x_a", "y_a"]
    with pytest.raises(PySparkException):
        stations_to_wide(df.union(df), "t", "s", ["x", "y"], ["a", "b"]).collect()


def test_merge_keeps_all_instants(spark):
    energy = rows(spark, [("2024-01-01 01:00:00", 1.0)], "timestamp string, load double", "timestamp")
    weather = rows(spark, [("2024-01-01 00:00:00", 5.0), ("2024-01-01 01:00:00", 6.0)], "timestamp string, t double", "timestamp")
    out = merge_sources(energy, [weather]).orderBy("utc_timestamp").collect()
    assert [(r.utc_timestamp.hour, r.local_timestamp.hour, r.load, r.t) for r in out] == [(0, 1, 1.0, 5.0), (1, 2, None, 6.0)]


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "timestamp int, a_0 int, keep int")
    assert drop_by_suffix(df, "_0").columns == ["timestamp", "keep"]
    assert drop_matching(df, ["ke"], ["stamp"]).columns == ["a_0"]
    assert reorder(df, ["keep"]).columns == ["keep", "timestamp", "a_0"]
    raw = "timestamp int, PRED_GLOB_ctrl int, PRED_T_2M_ctrl int, PRED_TOT_PREC_ctrl int, PRED_RELHUM_2M_ctrl int, PRED_DURSUN_ctrl int, x_0 int"
    assert rename_weather(spark.createDataFrame([], raw)).columns[:3] == ["timestamp", "forecast_temperature", "forecast_global_radiation"]


def test_feature_list_and_categories(spark):
    cols = ["utc_timestamp", "load", "solar_sion", "sion_measured_humidity", "sion_forecast_humidity", "local_hour", "load_cv_week"]
    df = spark.createDataFrame([], ", ".join(f"`{c}` double" for c in cols))
    assert model_features(df) == ["sion_forecast_humidity", "local_hour", "load_cv_week"]
    names = {
        "utc_sin_hour": "Cyclical",
        "sion_forecast_humidity": "Weather forecast",
        "sion_measured_humidity": "Weather measurement",
        "load_min_2d": "Lag",
        "solar_remote_week_std": "Lag",
        "poa_irradiance": "Solar capacity",
        "estimated_solar_capacity_ghi": "Solar capacity",
        "solar_sion": "Solar production",
        "local_hour": "Temporal",
        "other": "Other",
    }
    table = categorise_features(spark.createDataFrame([(n,) for n in names], "feature string"))
    assert {r.feature: r.category for r in table.collect()} == names


def test_normalise_edge_cases(spark):
    df = spark.createDataFrame([(1, 2.0, 0.0, None), (2, 2.0, 0.0, None)], "ts int, flat double, zero double, empty double")
    spec = SeriesSpec("ts")
    assert normalise(df, ["flat"], "minmax", spec).head().flat == 0.0
    assert normalise(df, ["zero", "empty"], "max", spec).head()[2:] == (0.0, 0.0)
    assert normalise(df, ["zero", "empty"], "total_max", spec).head()[2:] == (0.0, 0.0)
    assert normalise(df.where("ts = 1"), ["flat"], "max", spec, of=df.withColumn("flat", F.lit(4.0))).head().flat == 0.5


def test_sample_is_stable(spark):
    df = spark.range(1000)
    a = {r.id for r in sample_n(df, 50, 42, ["id"]).collect()}
    assert a == {r.id for r in sample_n(df.repartition(7), 50, 42, ["id"]).collect()} and len(a) == 50
    assert a != {r.id for r in sample_n(df, 50, 7, ["id"]).collect()}
    assert sample_n(df, 5000, 1, ["id"]).count() == 1000


def test_folds_meet_at_the_split(spark):
    at = datetime(2024, 1, 1)
    edges = [at - timedelta(seconds=1), at, at + timedelta(days=90, seconds=-1), at + timedelta(days=90)]
    df = rows(spark, [(str(t),) for t in edges], "ts string", "ts")
    got = {r.ts: r.role for r in expanding_folds(df, TS, [at]).collect()}
    assert got == {edges[0]: "fit", edges[1]: "val", edges[2]: "val"}
    train, test = split_temporal(df, TS, at)
    assert (train.count(), test.count()) == (1, 3)


def test_interval_ends_are_excluded(spark):
    a, b = datetime(2025, 9, 13, 0, 15), datetime(2025, 9, 17)
    around = [a - timedelta(minutes=15), a, b, b + timedelta(minutes=15)]
    df = rows(spark, [(str(t),) for t in around], "ts string", "ts")
    assert [r.ts for r in exclude_intervals(df, "ts", [(a, b)]).orderBy("ts").collect()] == [around[0], around[3]]


def test_warmup_and_holdout_per_key(spark):
    data = [(k, f"2024-01-{d + 10 * k:02d}") for k in (0, 1) for d in range(1, 11)]
    df = rows(spark, data, "k int, ts string", "ts")
    spec = SeriesSpec("ts", ("k",))
    assert clip_warmup(df, spec, days=9).count() == 2
    assert clip_warmup(df, spec, datetime(2024, 1, 2), 9).count() == 10
    assert holdout_mask(df, spec, 3).where("is_val").groupBy("k").count().collect()[0]["count"] == 4


def test_filters_reach_the_scan(spark, sf):
    train, _ = split_temporal(spark.read.parquet(f"{sf}/orders.parquet"), SeriesSpec("o_orderdate"), datetime(1999, 1, 1))
    assert "LessThan(o_orderdate" in plan(train)


def test_daily_lags_use_nothing_after_day_minus_two(spark):
    data = [(f"2024-01-{d:02d} {h:02d}:00:00", float(d * 10 + h)) for d in range(1, 13) if d != 9 for h in (0, 12)]
    df = rows(spark, data, "ts string, load double", "ts")
    base = {r.ts: r for r in add_lag_features(df, TS, ["load"]).collect()}
    changed = df.withColumn("load", F.when(F.col("ts") >= "2024-01-10", 999.0).otherwise(F.col("load")))
    after = {r.ts: r for r in add_lag_features(changed, TS, ["load"]).collect()}
    skip = {"load"}
    for t in (datetime(2024, 1, 10), datetime(2024, 1, 11)):
        assert {k: v for k, v in base[t].asDict().items() if k not in skip} == {
            k: v for k, v in after[t].asDict().items() if k not in skip
        }
    assert base[datetime(2024, 1, 11)].load_mean_2d is None  # day 9 is missing
    assert base[datetime(2024, 1, 12)].load_mean_2d == pytest.approx(106.0)
    # seven present days ending on day 10: 3..8 and 10
    assert base[datetime(2024, 1, 12)].load_week_mean == pytest.approx(sum(d * 10 + 6 for d in (3, 4, 5, 6, 7, 8, 10)) / 7)
    assert len([c for c in base[datetime(2024, 1, 11)].asDict() if c.startswith("load_")]) == 15


def test_one_row_day_has_no_deviation(spark):
    df = rows(spark, [("2024-01-01 05:00:00", 3.0)], "ts string, load double", "ts")
    r = daily_stats(df, TS, ["load"]).head()
    assert (r.load_daily_mean, r.load_daily_std) == (3.0, None)


def test_yield_ratio_looks_back_from_day_minus_two(spark):
    data = [(f"2024-01-{d:02d} 12:00:00", float(d), 1000.0) for d in range(1, 8)] + [("2024-01-08 12:00:00", 1.0, 10.0)]
    df = rows(spark, data, "ts string, solar double, ghi double", "ts")
    out = {r.ts.day: r.y for r in add_yield_ratio(df, TS, "solar", "ghi", window_days=2, out="y").collect()}
    assert out[1] is None and out[2] is None
    assert out[3] == pytest.approx(0.001) and out[8] == pytest.approx(0.0055)
    by_rows = {r.ts.day: r.y for r in add_yield_ratio(df, TS, "solar", "ghi", window_days=2, out="y", mode="rows").collect()}
    assert by_rows[2] is None and by_rows[4] == pytest.approx(0.0015)


def test_errors_skip_and_count_nulls(spark):
    df = rows(spark, [("2024-01-01", 1.0, 2.0, None), ("2024-01-02", 4.0, 1.0, 4.0)], "ts string, y double, a double, b double", "ts")
    pred = long_predictions(df, "ts", "y", {"A": "a", "B": "b"})
    got = {r.model: (r.mae, r.rmse, r.n, r.skipped) for r in error_metrics(pred).collect()}
    assert got["A"] == (2.0, pytest.approx(5**0.5), 2, 0) and got["B"] == (0.0, 0.0, 1, 1)
    assert {r.model: r.RMSE for r in compare_models(pred).collect()}["A"] == 2.2361


def test_hourly_errors_average_first(spark):
    data = [("m", "2024-01-01 00:00:00", 1.0, 0.0), ("m", "2024-01-01 00:45:00", 0.0, 1.0), ("m", None, 9.0, 0.0)]
    pred = rows(spark, data, "model string, ts string, y_true double, y_pred double", "ts")
    assert hourly_error_metrics(pred).head().mae == 0.0
    assert hourly_error_metrics(pred, offset=timedelta(minutes=15)).head().mae == 1.0


def test_flat_columns_correlate_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 3.0), (3.0, 5.0, None)], "load double, flat double, x double")
    got = {r.feature: r.pearson_r for r in corr_table(df, ["flat", "x"]).collect()}
    assert got == {"flat": 0.0, "x": 0.5}  # r = 1 on two rows, times (n-1)/n


def test_autocorrelation_modes_agree_on_a_full_grid(spark):
    df, _ = series(spark, n=96 * 9, keys=1, gaps=0.0)
    df = df.withColumn("local_is_weekend", F.weekday("ts") >= 5)
    spec = SeriesSpec("ts", ("k",), bucket_rows=200)
    both = [sorted(lag_autocorr(df, spec, "x", (2, 3), mode=m).collect()) for m in ("rows", "time")]
    assert [r[:3] for r in both[0]] == [r[:3] for r in both[1]]


def test_mutual_information_of_a_copy_is_its_entropy(spark):
    joint = spark.createDataFrame([("f", 0, 0, 50), ("f", 1, 1, 50), ("g", 0, 0, 25), ("g", 0, 1, 25), ("g", 1, 0, 25), ("g", 1, 1, 25)], "feature string, x int, y int, n long")
    table = mutual_information(joint)
    got = {r.feature: r.importance for r in table.collect()}
    assert got["f"] == pytest.approx(0.6931472) and got["g"] == pytest.approx(0.0)
    assert importance_share(table, 1).head().importance_norm == 100.0


def test_group_quantile_is_exact(spark):
    df, pdf = series(spark)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.k: r["quantile"] for r in group_quantile(df, ["k"], "x", q).collect()}
        for k, v in pdf.groupby("k").x.quantile(q).items():
            assert got[k] == pytest.approx(v, abs=1e-12)


def test_group_quantile_survives_a_missed_sketch(spark, monkeypatch):
    import loadspark.operators.quantiles as module

    monkeypatch.setattr(module, "MARGIN", -0.2)
    df, pdf = series(spark)
    got = {r.k: r["quantile"] for r in group_quantile(df, ["k"], "x", 0.5).collect()}
    assert got == pytest.approx(dict(pdf.groupby("k").x.median()))


def test_top_k(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "f string, v double")
    assert [r.f for r in top_k(df, "v", 2).collect()] == ["b", "c"]
    assert "TakeOrderedAndProject" in plan(top_k(df, "v", 2))


def test_calendar_summary_counts_days_once(spark):
    data = [("2024-01-06 00:00:00", True, False, False), ("2024-01-06 12:00:00", True, False, False), ("2024-01-08", False, False, True)]
    df = rows(spark, data, "local_timestamp string, local_is_weekend boolean, local_is_holiday boolean, local_is_working_day boolean", "local_timestamp")
    assert calendar_summary(df).head()[:] == (1, 0, 1)


def test_dates_are_inclusive(spark):
    from loadspark.operators.split import between_dates

    df = rows(spark, [("2024-01-01",), ("2024-01-02 23:59:59",), ("2024-01-03",)], "ts string", "ts")
    assert between_dates(df, "ts", date(2024, 1, 1), date(2024, 1, 2)).count() == 2
