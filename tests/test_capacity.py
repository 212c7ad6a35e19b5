from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

import loadspark.operators.capacity as capacity
from loadspark.functions.solar import add_poa_irradiance
from loadspark.operators.capacity import (
    GHI,
    add_monthly_capacity,
    estimate_capacity,
    isotonic_fit,
    isotonic_quantile,
    pool_violators,
    production_errors,
    reconstruct,
)
from loadspark.operators.reshape import SOLAR_COLUMNS
from loadspark.series import SeriesSpec
from tests.helpers import assert_column, rows, series

KEYED = SeriesSpec("ts", ("k",), bucket_rows=100)
GLOBAL = SeriesSpec("ts", (), bucket_rows=100)


def reference_fit(s: pd.Series) -> pd.Series:
    v = s.dropna()
    return v.groupby(pool_violators(v.to_numpy(), np.ones(len(v)))).transform("mean").reindex(s.index)


def test_pooling():
    pools = pool_violators(np.array([3.0, 1, 2, 5, 4]), np.ones(5))
    assert list(pools) == [0, 0, 0, 3, 3]


@pytest.mark.parametrize("sizes", [(200, 10**6, 64), (100, 20, 8), (50, 5, 2)])
def test_fit_in_pieces_is_exact(spark, monkeypatch, sizes):
    for name, value in zip(("FIT_ROWS", "PIECE_POOLS", "SLOPES"), sizes):
        monkeypatch.setattr(capacity, name, value)
    df, pdf = series(spark, n=900)
    out = isotonic_fit(df.withColumn("y", -F.col("x")), KEYED, {"x": "up", "y": "down"}).cache()
    assert_column(out, "up", pdf.groupby("k")["x"].transform(reference_fit))
    assert_column(out, "down", (-pdf["x"]).groupby(pdf["k"]).transform(reference_fit))


def test_sawtooth_is_one_pool(spark, monkeypatch):
    """Every tooth survives its own block, so only the chord test can finish the piece."""
    monkeypatch.setattr(capacity, "FIT_ROWS", 100)
    monkeypatch.setattr(capacity, "PIECE_POOLS", 150)
    pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(1000) * 15, "m"), "x": np.arange(1000) % 100 * 1.0})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert_column(isotonic_fit(df, GLOBAL, {"x": "fit"}), "fit", reference_fit(pdf.x), ["ts"])


def test_fit_equals_the_library_fit(spark):
    df, _ = series(spark, n=400, keys=1, gaps=0.3)
    df = df.withColumn("x", F.col("x") + F.hour("ts") / 5).where("x is not null")
    ours = isotonic_fit(df, GLOBAL, {"x": "fit"}).withColumn("feature", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    model = IsotonicRegression(labelCol="x", featuresCol="feature").fit(ours)
    assert model.transform(ours).agg(F.max(F.abs(F.col("fit") - F.col("prediction")))).head()[0] < 1e-9


def test_null_prefix_stays_null(spark):
    df = rows(spark, [("2024-01-01", None), ("2024-01-02", 2.0), ("2024-01-03", 1.0)], "ts string, x double", "ts")
    assert [r.fit for r in isotonic_fit(df, GLOBAL, {"x": "fit"}).orderBy("ts").collect()] == [None, 1.5, 1.5]


def test_fit_of_nothing(spark):
    df = rows(spark, [("2024-01-01", None)], "ts string, x double", "ts")
    assert isotonic_fit(df, GLOBAL, {"x": "fit"}).head().fit is None


def test_fit_until_does_not_look_ahead(spark):
    df, _ = series(spark, n=400, keys=1, gaps=0.0)
    df = df.withColumn("x", F.col("x") + 5)
    until = datetime(2024, 1, 3)
    changed = df.withColumn("x", F.when(F.col("ts") > F.lit(until).cast("timestamp_ntz"), 0.0).otherwise(F.col("x")))
    early = F.col("ts") <= F.lit(until).cast("timestamp_ntz")
    a, b = (
        [r.cap for r in isotonic_quantile(d, GLOBAL, {"x": "cap"}, 0.9, 48, 8, until).where(early).orderBy("ts").collect()]
        for d in (df, changed)
    )
    assert a == b and a[-1] is not None
    later = isotonic_quantile(df, GLOBAL, {"x": "cap"}, 0.9, 48, 8, until).where(~early)
    assert later.agg(F.count_distinct("cap")).head()[0] == 1


@pytest.fixture(scope="module")
def sunny(spark):
    """Four plants that follow the sun; the last doubles half way."""
    days = 20
    n = days * 96
    t = pd.Timestamp("2024-05-01") + pd.to_timedelta(np.arange(n) * 15, "m")
    ghi = np.clip(np.sin((t.hour + t.minute / 60 - 4) * np.pi / 15), 0, None) * 800
    pdf = pd.DataFrame({"utc_timestamp": t, GHI: ghi})
    for i, c in enumerate(SOLAR_COLUMNS):
        grown = np.where(np.arange(n) > n // 2, 2.0, 1.0) if i == 3 else 1.0
        pdf[c] = ghi / 1000 * 0.25 * 10 * (i + 1) * grown
    df = spark.createDataFrame(pdf).withColumn("utc_timestamp", F.col("utc_timestamp").cast("timestamp_ntz"))
    return add_poa_irradiance(df).cache()


def test_capacity_finds_the_installed_size_and_never_falls(sunny):
    out = estimate_capacity(sunny, SeriesSpec(), window_days=3).orderBy("utc_timestamp").toPandas()
    cap = out["estimated_solar_capacity_ghi"].dropna()
    assert (cap.diff().dropna() >= -1e-9).all()
    assert cap.iloc[0] == pytest.approx(100.0) and cap.iloc[-1] == pytest.approx(140.0)
    assert out["estimated_solar_capacity_poa"].notna().sum() > 1000
    assert out["solar_yield_30d"].iloc[-1] == pytest.approx(0.035)
    assert not [c for c in out.columns if c.startswith("_")]


def test_capacity_without_poa(sunny):
    out = estimate_capacity(sunny.drop("poa_irradiance"), SeriesSpec(), window_days=3)
    assert "estimated_solar_capacity_poa" not in out.columns and "estimated_solar_capacity_ghi" in out.columns


def test_second_pass_by_month(sunny):
    first = estimate_capacity(sunny, SeriesSpec(), window_days=3).withColumn("total", sum(F.col(c) for c in SOLAR_COLUMNS))
    out = add_monthly_capacity(first, SeriesSpec(), "total", "estimated_solar_capacity_ghi", GHI, window=288)
    last = out.orderBy(F.desc("utc_timestamp")).head()
    assert last.eta_month == pytest.approx(1.0) and last.cap_eta == pytest.approx(140.0)


def test_reconstruction_errors(sunny):
    out = production_errors(sunny, SeriesSpec(), hours=6)
    r = out.orderBy(F.desc("utc_timestamp")).head()
    assert {"err_ghi", "err_eta", "err_poa", "err_yield", "mae_ghi", "pred_poa"} <= set(out.columns)
    assert r.mae_ghi is not None


def test_reconstruct_leaves_out_incomplete_rows(spark):
    df = rows(spark, [("2024-01-01", 1.0, None), ("2024-01-02", 1.0, 2.0)], "ts string, y double, p double", "ts")
    out = reconstruct(df, SeriesSpec("ts"), {"a": "p"}, "y", 0.25).collect()
    assert [(r.err_a, r.mae_a) for r in out] == [(1.0, 1.0)]


def test_fit_of_repeated_instants(spark):
    """Rows of one instant are fitted one by one, in the order of their values, and alike on every run."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"h": rng.integers(0, 60, 900), "y": rng.normal(size=900)})
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["h"], "h")
    pdf = pdf.sort_values(["ts", "y"]).reset_index(drop=True)
    y = pdf["y"].to_numpy()
    first = pool_violators(y, np.ones(len(y)))
    means = pd.Series(y).groupby(first).transform("mean").round(9)
    want = sorted(zip(pdf["h"], pdf["y"], means, strict=True))
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=2)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    spec = SeriesSpec("ts", (), timedelta(hours=1), 24)
    for _ in range(2):
        got = isotonic_fit(df.withColumn("other", F.lit(1)), spec, {"y": "fit"}).collect()
        assert sorted((r["h"], r["y"], round(r["fit"], 9)) for r in got) == want
