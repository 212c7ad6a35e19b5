from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from loadspark.operators.models import (
    ALPHAS,
    Moments,
    assemble,
    best_params,
    contiguous_folds,
    draw_params,
    fit_gbt,
    fit_scaler,
    gbt_estimator,
    linear_model,
    load_model,
    prepare_features,
    random_search,
    rank_coefficients,
    rank_importance,
    refit_best,
    ridge_cv,
    save_model,
    score,
)
from loadspark.operators.split import holdout_mask
from loadspark.plans.train import evaluate, predictions, train_gbt, train_ridge, tune_gbt
from loadspark.series import SeriesSpec
from loadspark.sources.prepared import read_json
from tests.helpers import rows

SPEC = SeriesSpec("ts", (), bucket_rows=96)
FEATURES = ["a", "b", "flag"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 1003
    pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 15, "m")})
    pdf["a"], pdf["b"] = rng.normal(3, 2, n), rng.normal(-1, 5, n)
    pdf["flag"] = rng.random(n) < 0.4
    pdf["load"] = 100 + 2 * pdf.a - 0.7 * pdf.b + 3 * pdf.flag + rng.normal(0, 0.5, n) + np.arange(n) / 400
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return df.cache(), pdf


def test_scaler_divides_by_the_population_deviation(data):
    df, pdf = data
    vec = assemble(df, FEATURES)
    got = np.array([r[0] for r in fit_scaler(vec).transform(vec).orderBy("ts").select(vector_to_array("scaled")).collect()])
    x = pdf[FEATURES].to_numpy(dtype=float)
    np.testing.assert_allclose(got, (x - x.mean(0)) / x.std(0), atol=1e-9)
    sample = np.array([r[0] for r in fit_scaler(vec, 1).transform(vec).orderBy("ts").select(vector_to_array("scaled")).collect()])
    np.testing.assert_allclose(sample, (x - x.mean(0)) / x.std(0, ddof=1), atol=1e-9)


def test_assemble_skips_or_refuses_nulls(spark):
    df = spark.createDataFrame([(1.0, True, 1.0), (None, False, 1.0), (2.0, True, None)], "a double, f boolean, y double")
    assert assemble(df, ["a", "f"], "y", "skip").count() == 1
    with pytest.raises(Exception):
        assemble(df, ["a", "f"]).select("features").collect()


@pytest.mark.parametrize("n,k", [(1003, 5), (10, 3), (4, 5)])
def test_folds_are_contiguous(data, n, k):
    df, _ = data
    some = df.orderBy("ts").limit(n)
    got = [r.fold for r in contiguous_folds(some, SPEC, k).orderBy("ts").collect()]
    sizes = [n // k + (i < n % k) for i in range(k)]
    assert got == [i for i, s in enumerate(sizes) for _ in range(s)]


def expected_ridge(pdf, features, label, alphas, k=5):
    """Plain numpy: standardise, contiguous folds, centred ridge, mean R2."""
    x = pdf[features].to_numpy(dtype=float)
    z, y = (x - x.mean(0)) / x.std(0), pdf[label].to_numpy()

    def fit(a, b, alpha):
        za, ya = a - a.mean(0), b - b.mean()
        w = np.linalg.solve(za.T @ za + alpha * np.eye(a.shape[1]), za.T @ ya)
        return w, b.mean() - a.mean(0) @ w

    parts = np.array_split(np.arange(len(y)), k)
    scores = []
    for alpha in alphas:
        r2 = []
        for p in parts:
            rest = np.setdiff1d(np.arange(len(y)), p)
            w, c = fit(z[rest], y[rest], alpha)
            r2.append(1 - ((y[p] - z[p] @ w - c) ** 2).sum() / ((y[p] - y[p].mean()) ** 2).sum())
        scores.append(np.mean(r2))
    return fit(z, y, alphas[int(np.argmax(scores))]), scores


def test_ridge_equals_closed_form(data):
    df, pdf = data
    fit = ridge_cv(df, SPEC, FEATURES)
    (w, c), scores = expected_ridge(pdf, FEATURES, "load", ALPHAS)
    np.testing.assert_allclose([s for _, s in fit.scores], scores, atol=1e-10)
    np.testing.assert_allclose(fit.coefficients, w, rtol=1e-9)
    assert fit.intercept == pytest.approx(c) and fit.alpha == ALPHAS[int(np.argmax(scores))]
    x = pdf[FEATURES].to_numpy(dtype=float)
    z = (x - x.mean(0)) / x.std(0)
    got = [r.prediction for r in fit.model.transform(df).orderBy("ts").collect()]
    np.testing.assert_allclose(got, z @ w + c, rtol=1e-9)


def test_ridge_equals_the_library_fit(data):
    df, pdf = data
    alpha = 50.0
    fit = ridge_cv(df, SPEC, FEATURES, alphas=[alpha])
    vec = assemble(df, FEATURES)
    scaled = fit_scaler(vec).transform(vec)
    n, sd = len(pdf), pdf.load.std(ddof=0)
    lib = LinearRegression(
        featuresCol="scaled", labelCol="load", elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * sd / n
    ).fit(scaled)
    np.testing.assert_allclose(fit.coefficients, lib.coefficients.toArray(), rtol=1e-5)


def test_ridge_leaves_out_incomplete_rows_and_flat_features(data):
    df, pdf = data
    holes = df.withColumn("a", F.when(F.minute("ts") != 15, F.col("a"))).withColumn("flat", F.lit(1.0))
    fit = ridge_cv(holes, SPEC, ["a", "b", "flat"])
    (w, _), _ = expected_ridge(pdf[pdf.ts.dt.minute != 15], ["a", "b"], "load", [fit.alpha])
    np.testing.assert_allclose(fit.coefficients, [*w, 0.0], rtol=1e-8, atol=1e-9)
    with pytest.raises(ValueError):
        ridge_cv(holes.withColumn("b", F.lit(None).cast("double")), SPEC, ["a", "b"])


def test_moments_add_up():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3)) * 5 + 9

    def of(r):
        return Moments(len(r), r.mean(0), (r - r.mean(0)).T @ (r - r.mean(0)))

    both, whole = of(x[:20]) + of(x[20:]), of(x)
    np.testing.assert_allclose(both.mean, whole.mean)
    np.testing.assert_allclose(both.cross, whole.cross)


def test_models_survive_saving(data, tmp_path):
    df, _ = data
    model = linear_model(["a", "b"], [2.0, -1e-7], 3.5)
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    assert score(again, df).agg(F.max(F.abs(F.col("prediction") - (F.col("a") * 2 - F.col("b") * 1e-7 + 3.5)))).head()[0] < 1e-9


def test_boosted_trees_beat_the_mean(data, tmp_path):
    df, _ = data
    masked = holdout_mask(df, SPEC, 2)
    model = fit_gbt(masked, FEATURES, n_estimators=25, num_leaves=16, learning_rate=0.2)
    val = masked.where("is_val")
    mean = masked.where("not is_val").agg(F.avg("load")).head()[0]
    typed = val.withColumn("flag", F.col("flag").cast("double"))
    mae = model.transform(typed).agg(F.avg(F.abs(F.col("load") - F.col("prediction")))).head()[0]
    base = val.agg(F.avg(F.abs(F.col("load") - mean))).head()[0]
    assert mae < 0.6 * base
    again = fit_gbt(masked, FEATURES, n_estimators=25, num_leaves=16, learning_rate=0.2)
    assert again.stages[-1].featureImportances == model.stages[-1].featureImportances
    top = rank_importance(df.sparkSession, model, FEATURES, 2).collect()
    assert {r.feature for r in top} == {"a", "b"} and top[0].gain >= top[1].gain
    save_model(model, str(tmp_path / "gbt"))
    assert load_model(str(tmp_path / "gbt")).transform(typed).count() == val.count()


def test_trees_take_missing_features(data):
    df, _ = data
    holes = holdout_mask(df.withColumn("a", F.when(F.minute("ts") != 0, F.col("a"))), SPEC, 2)
    model = fit_gbt(holes, ["a", "b"], n_estimators=3)
    assert model.transform(holes).where("prediction is null").count() == 0


def test_parameter_mapping():
    est = gbt_estimator("y", "v", num_leaves=63, min_child_samples=20, bagging_fraction=0.7)
    with pytest.raises(ValueError, match="penalties"):
        gbt_estimator("y", "v", reg_lambda=0.1)
    assert (est.getMaxDepth(), est.getMinInstancesPerNode(), est.getSubsamplingRate()) == (6, 20, 0.7)
    assert est.getLossType() == "absolute" and est.getValidationIndicatorCol() == "v"
    assert gbt_estimator("y", None, num_leaves=255).getMaxDepth() == 8


def test_search_is_seeded_and_picks_the_least_error(data):
    df, _ = data
    splits = [datetime(2024, 1, 5), datetime(2024, 1, 8)]
    space = {"learning_rate": (0.1, 0.3, "log"), "num_leaves": (4, 16, "int"), "min_child_samples": (5, 20, "int")}
    trials = random_search(df, SPEC, FEATURES, splits, space=space, n_trials=2, n_estimators=3, horizon_days=2).cache()
    assert trials.count() == 4
    by_trial = {r.trial: r.mean_mae for r in trials.select("trial", "mean_mae").distinct().collect()}
    best = best_params(trials)
    winner = trials.where(F.col("trial") == min(by_trial, key=by_trial.get)).head().params
    assert best["num_leaves"] == winner["num_leaves"] and isinstance(best["num_leaves"], int)
    model = refit_best(holdout_mask(df, SPEC, 2), trials, FEATURES, n_estimators=2)
    assert model.stages[-1].getNumTrees <= 2
    import random

    assert draw_params(space, random.Random(3)) == draw_params(space, random.Random(3))
    with pytest.raises(ValueError):
        best_params(trials.where("trial < 0"))


def test_training_plans(data, tmp_path):
    df, _ = data
    fit, train_error = train_ridge(df, SPEC, FEATURES, str(tmp_path / "ridge"))
    assert train_error.head().mae < 1.0
    model, val_error = train_gbt(df, SPEC, FEATURES, str(tmp_path / "gbt"), holdout_days=2, params={"n_estimators": 5})
    assert val_error.head().n == 193
    best, _ = tune_gbt(df, SPEC, FEATURES, str(tmp_path / "tuned"), n_trials=1, splits=[datetime(2024, 1, 6)], n_estimators=2)
    assert read_json(df.sparkSession, str(tmp_path / "tuned" / "best_params")) == best
    test = df.withColumn("load_persistence_7d", F.col("load") + 1).withColumn("forecast_load", F.col("load") - 2)
    table = {r.model: r.MAE for r in evaluate(test, SPEC, {"ridge": fit.model, "gbt": model}).collect()}
    assert table["persistence"] == 1.0 and table["operator"] == 2.0 and table["ridge"] < 1 and set(table) >= {"gbt"}
    assert predictions({"ridge": fit.model}, df, SPEC).count() == df.count()


def test_top_coefficients(spark):
    got = rank_coefficients(spark, ["a", "b", "c"], [0.5, -3.0, 1.0], 2).collect()
    assert [(r.feature, r.coefficient) for r in got] == [("b", -3.0), ("c", 1.0)]


def test_sparse_feature_is_filled_back_then_forth(spark):
    data = [("2024-01-01", None, 1.0), ("2024-01-02", 2.0, 1.0), ("2024-01-03", None, 1.0)]
    df = rows(spark, data, "ts string, solar_remote_yield_ratio double, load double", "ts")
    spec = SeriesSpec("ts", (), timedelta(days=1))
    out = prepare_features(df, spec, ["solar_remote_yield_ratio"])
    assert [r.solar_remote_yield_ratio for r in out.collect()] == [2.0, 2.0, 2.0]


def test_boosting_has_patience(data):
    from loadspark.operators.models import GBT_DEFAULTS, PATIENCE, SEARCH_SPACE, best_round

    # The first rise does not end it, a rise of `patience` rounds does, and the smallest error so far counts.
    assert best_round([5.0, 4.0, 4.5, 3.0, 3.5, 3.4, 1.0], 3) == (7, False)
    assert best_round([5.0, 4.0, 4.5, 4.2, 4.1, 1.0], 3) == (2, True)
    assert best_round([5.0, 4.0, 4.5], 3) == (2, False)
    assert (GBT_DEFAULTS["n_estimators"], PATIENCE) == (2000, 50)
    assert not {"reg_alpha", "reg_lambda"} & set(SEARCH_SPACE)
    df, _ = data
    masked = holdout_mask(df, SPEC, 2)
    model = fit_gbt(masked, FEATURES, n_estimators=30, num_leaves=4, learning_rate=0.9, patience=3)
    long = fit_gbt(masked, FEATURES, n_estimators=12, num_leaves=4, learning_rate=0.9, patience=1000)
    assert model.stages[-1].getNumTrees <= 30 and long.stages[-1].getNumTrees <= 12
    # A fit of few rounds begins like a longer one.
    short = fit_gbt(masked, FEATURES, "load", None, n_estimators=2, num_leaves=4, learning_rate=0.9).stages[-1]
    more = fit_gbt(masked, FEATURES, "load", None, n_estimators=4, num_leaves=4, learning_rate=0.9).stages[-1]
    assert [t.toDebugString.split("\n", 1)[1] for t in short.trees] == [t.toDebugString.split("\n", 1)[1] for t in more.trees[:2]]


def test_more_leaves_are_deeper_trees():
    assert gbt_estimator("y", None, num_leaves=8192).getMaxDepth() == 13
    with pytest.raises(ValueError, match="num_leaves"):
        gbt_estimator("y", None, num_leaves=2**31)


def test_leaf_grown_trees_in_training_and_search(spark, data, tmp_path):
    from loadspark.operators.models import LEAFWISE_SPACE, refit_best
    from loadspark.operators.trees import LeafwiseModel, fit_leafwise

    df, _ = data
    model, error = train_gbt(df, SPEC, FEATURES, str(tmp_path / "leaf"), holdout_days=2, params={"n_estimators": 2, "num_leaves": 4}, grower="leaf")
    assert LeafwiseModel.load(spark, str(tmp_path / "leaf")) == model and error.head().mae > 0
    best, trials = tune_gbt(
        df, SPEC, FEATURES, n_trials=1, splits=[datetime(2024, 1, 6)], n_estimators=1, grower="leaf"
    )
    assert set(best) == set(LEAFWISE_SPACE) and trials.head().mae > 0
    again = refit_best(holdout_mask(df, SPEC, 2), trials, FEATURES, fit=fit_leafwise, n_estimators=1, num_leaves=4)
    assert len(again.trees) <= 1


def test_moments_of_many_partitions_are_added_in_rounds(spark, monkeypatch):
    import loadspark.operators.models as models

    monkeypatch.setattr(models, "FAN_IN", 3)
    df = spark.range(4000).select(
        (F.col("id") % 2).cast("int").alias("fold"), (F.col("id") % 17).cast("double").alias("a"), F.col("id").cast("double").alias("b")
    ).repartition(40)
    got = models.fold_moments(df, ["a", "b"], np.zeros(2), np.ones(2))
    pdf = df.toPandas()
    for fold, part in pdf.groupby("fold"):
        assert got[fold].n == len(part)
        np.testing.assert_allclose(got[fold].mean, part[["a", "b"]].mean())
        np.testing.assert_allclose(got[fold].cross, np.cov(part[["a", "b"]].T, ddof=0) * len(part), rtol=1e-9)
