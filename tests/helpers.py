"""Small frames for tests and their pandas twins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BASE = pd.Timestamp("2024-01-01")


def series(spark, n=600, keys=3, gaps=0.6, seed=0) -> tuple[DataFrame, pd.DataFrame]:
    """Keyed quarter-hour series with gaps, key 2 rising over time."""
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(keys):
        x = rng.normal(size=n) + np.arange(n) / 200 * (k - 1)
        x[rng.random(n) < gaps] = np.nan
        parts.append(pd.DataFrame({"k": k, "ts": BASE + pd.to_timedelta(np.arange(n) * 15, "m"), "x": x}))
    pdf = pd.concat(parts, ignore_index=True)
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df.withColumn("x", F.when(~F.isnan("x"), F.col("x"))), pdf


def assert_column(out: DataFrame, col: str, expected, order=("k", "ts"), atol=1e-9) -> None:
    got = out.toPandas().sort_values(list(order)).reset_index(drop=True)[col].astype(float).to_numpy()
    want = np.asarray(expected, dtype=float)
    assert len(got) == len(want)
    np.testing.assert_array_equal(np.isnan(got), np.isnan(want))
    np.testing.assert_allclose(got, want, atol=atol, equal_nan=True)


def rows(spark, data, schema: str, *ts: str) -> DataFrame:
    """Literal rows; the named string columns become timestamps."""
    df = spark.createDataFrame(data, schema)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ts}) if ts else df


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()


def formatted(df: DataFrame) -> str:
    """The physical plan with scan filters in full."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
