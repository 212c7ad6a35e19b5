"""Training, tuning and evaluation on prepared tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from loadspark.operators.metrics import compare_models, error_metrics, long_predictions
from loadspark.operators.models import (
    LEAFWISE_SPACE,
    SEARCH_SPACE,
    RidgeFit,
    best_params,
    fit_gbt,
    prepare_features,
    random_search,
    ridge_cv,
    save_model,
)
from loadspark.operators.split import holdout_mask
from loadspark.operators.trees import LeafwiseModel, fit_leafwise
from loadspark.series import SeriesSpec
from loadspark.sources.prepared import write_json, write_trials

GROWERS = {"depth": fit_gbt, "leaf": fit_leafwise}
# Starts of the four quarterly validation folds.
FOLD_STARTS = [datetime(2023, 10, 1), datetime(2024, 1, 1), datetime(2024, 4, 1), datetime(2024, 7, 1)]


def train_ridge(
    train: DataFrame, spec: SeriesSpec, features: Sequence[str], path: str | None = None, label: str = "load"
) -> tuple[RidgeFit, DataFrame]:
    """Fit, save if a path is given, and report the training error."""
    ready = prepare_features(train, spec, features, label)
    fit = ridge_cv(ready, spec, features, label)
    if path:
        save_model(fit.model, path)
    return fit, error_metrics(predictions({"ridge": fit.model}, ready, spec, label))


def train_gbt(
    train: DataFrame,
    spec: SeriesSpec,
    features: Sequence[str],
    path: str | None = None,
    label: str = "load",
    holdout_days: int = 90,
    params: Mapping[str, float] | None = None,
    grower: str = "depth",
) -> tuple[PipelineModel | LeafwiseModel, DataFrame]:
    """Boosted trees with early stopping on the last `holdout_days`; reports the hold-out error.

    With `params` this is the refit of a tuned model. `grower`: by `depth` (Spark's trees) or by `leaf`.
    """
    ready = holdout_mask(prepare_features(train, spec, features, label), spec, holdout_days)
    model = GROWERS[grower](ready, features, label, "is_val", **dict(params or {}))
    if path and isinstance(model, LeafwiseModel):
        model.save(train.sparkSession, path)
    elif path:
        save_model(model, path)
    return model, error_metrics(predictions({"gbt": model}, ready.where("is_val"), spec, label))


def tune_gbt(
    train: DataFrame,
    spec: SeriesSpec,
    features: Sequence[str],
    out_dir: str | None = None,
    label: str = "load",
    n_trials: int = 100,
    splits: Sequence[datetime] = tuple(FOLD_STARTS),
    seed: int = 42,
    n_estimators: int = 2000,
    grower: str = "depth",
) -> tuple[dict[str, float], DataFrame]:
    """Search, then store the best parameters and the trial history. Trees grown by `leaf` have seven parameters."""
    ready = prepare_features(train, spec, features, label)
    trials = random_search(
        ready, spec, features, splits, label, LEAFWISE_SPACE if grower == "leaf" else SEARCH_SPACE, n_trials, seed,
        n_estimators=n_estimators, fit=GROWERS[grower],
    )
    best = best_params(trials)
    if out_dir:
        write_json(train.sparkSession, best, f"{out_dir}/best_params")
        write_trials(trials, f"{out_dir}/trials")
    return best, trials


def predictions(models: Mapping[str, PipelineModel | LeafwiseModel], df: DataFrame, spec: SeriesSpec, label: str = "load") -> DataFrame:
    """Score with every model: rows (model, ts, y_true, y_pred)."""
    parts = []
    for name, model in models.items():
        typed = df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t == "boolean"})
        scored = model.transform(typed).select(
            F.lit(name).alias("model"),
            F.col(spec.ts).alias("ts"),
            F.col(label).cast("double").alias("y_true"),
            F.col("prediction").alias("y_pred"),
        )
        parts.append(scored)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evaluate(
    test: DataFrame, spec: SeriesSpec, models: Mapping[str, PipelineModel], label: str = "load", digits: int = 4
) -> DataFrame:
    """Errors of the week-ago baseline, the operator's forecast and every given model on the same rows."""
    baselines = {"persistence": "load_persistence_7d", "operator": "forecast_load"}
    pred = long_predictions(test, spec.ts, label, {m: c for m, c in baselines.items() if c in test.columns})
    if models:
        pred = pred.unionByName(predictions(models, test, spec, label))
    return compare_models(pred, digits=digits)

