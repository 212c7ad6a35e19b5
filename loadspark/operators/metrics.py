"""Errors of predictions held as rows (model, ts, y_true, y_pred)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from loadspark.series import SeriesSpec, step_start


def _by(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _errors() -> list[Column]:
    d = F.col("y_true") - F.col("y_pred")
    return [
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.count(d).alias("n"),
        F.count_if(d.isNull()).alias("skipped"),
    ]


def error_metrics(pred: DataFrame, by: str | Sequence[str] = "model") -> DataFrame:
    """MAE and RMSE; pairs with a null are left out and counted in `skipped`."""
    return pred.groupBy(*_by(by)).agg(*_errors())


def hourly_error_metrics(
    pred: DataFrame, by: str | Sequence[str] = "model", ts: str = "ts", offset: timedelta = timedelta(0)
) -> DataFrame:
    """Average both sides within each hour first, then MAE and RMSE; rows without an instant are dropped."""
    hourly = (
        pred.withColumn("_hour", step_start(ts, timedelta(hours=1), offset))
        .groupBy(*_by(by), "_hour")
        .agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))
    )
    return hourly.groupBy(*_by(by)).agg(*_errors())


def compare_models(pred: DataFrame, by: str | Sequence[str] = "model", digits: int = 4) -> DataFrame:
    """One row per model with rounded errors."""
    return error_metrics(pred, by).select(
        *_by(by), F.round("mae", digits).alias("MAE"), F.round("rmse", digits).alias("RMSE")
    )


def long_predictions(df: DataFrame, ts: str, y_true: str, models: dict[str, str]) -> DataFrame:
    """Prediction columns (model name to column) as rows; a model that is absent simply has no rows."""
    pairs = F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("y_pred")) for m, c in models.items()))
    rows = df.select(F.col(ts).alias("ts"), F.col(y_true).cast("double").alias("y_true"), F.explode(pairs).alias("p"))
    return rows.select("p.model", "ts", "y_true", "p.y_pred")


def series_range(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """First and last instant and row count of each series."""
    aggs = [F.min(spec.ts).alias("first_ts"), F.max(spec.ts).alias("last_ts"), F.count(F.lit(1)).alias("rows")]
    return df.groupBy(*spec.keys).agg(*aggs) if spec.keys else df.agg(*aggs)
