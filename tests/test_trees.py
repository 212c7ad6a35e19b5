
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import loadspark.operators.trees as trees
from loadspark.operators.trees import DEFAULTS, MISSING, LeafwiseModel, best_split, codes_of, fit_leafwise, quantile_edges


def _data(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 6, n).astype(float), "c": rng.normal(size=n)})
    pdf["load"] = np.where(pdf["a"] > 0.3, 4.0, 0.0) + pdf["b"] * (pdf["c"] > 0) + rng.normal(size=n) / 5
    pdf.loc[rng.random(n) < 0.15, "c"] = np.nan
    pdf["is_val"] = rng.random(n) < 0.25
    return spark.createDataFrame(pdf).withColumn("c", F.when(~F.isnan("c"), F.col("c"))), pdf


def brute(pdf, edges, params, rounds):
    """One leaf at a time over plain arrays: the leaf of the largest gain is split, its children are looked at anew."""
    p = {**DEFAULTS, **params}
    fit = pdf[~pdf["is_val"]]
    codes = codes_of(fit[["a", "b", "c"]].to_numpy(float), edges)
    y = fit["load"].to_numpy()
    score = np.full(len(y), np.median(y))
    for _ in range(rounds):
        g = np.sign(score - y)

        def cells(rows):
            out = np.zeros((2, 3, 256))
            for f in range(3):
                np.add.at(out[0, f], codes[f, rows], 1)
                np.add.at(out[1, f], codes[f, rows], g[rows])
            return out

        leaves = [np.arange(len(y))]
        splits = [best_split(cells(leaves[0]), range(3), p)]
        while len(leaves) < p["num_leaves"] and any(splits):
            k = max((i for i, s in enumerate(splits) if s), key=lambda i: splits[i][0])
            _, f, cut, missing_left = splits.pop(k)
            rows = leaves.pop(k)
            c = codes[f, rows]
            left = np.where(c == MISSING, missing_left, c <= cut)
            for part in (rows[left], rows[~left]):
                leaves.append(part)
                splits.append(best_split(cells(part), range(3), p))
        for rows in leaves:
            score[rows] += p["learning_rate"] * np.median((y - score)[rows])
    return fit.index, score


@pytest.mark.parametrize("params", [{}, {"reg_alpha": 8.0}, {"reg_lambda": 40.0}, {"num_leaves": 3}])
def test_equals_a_grower_of_one_leaf_at_a_time(spark, params):
    df, pdf = _data(spark)
    p = {"num_leaves": 9, "min_child_samples": 5, "learning_rate": 0.3, "n_estimators": 4, "max_bins": 32, **params}
    model = fit_leafwise(df, ["a", "b", "c"], val_col="is_val", patience=100, **p)
    assert len(model.errors) == 5
    full = LeafwiseModel(model.features, model.edges, model.start, model.trees, model.errors)
    rows, want = brute(pdf, model.edges, p, len(full.trees))
    got = full.transform(df.repartition(1)).toPandas()
    key = ["a", "b", "load"]
    mine = got[~got["is_val"]].sort_values(key)["prediction"].to_numpy()
    order = pdf.loc[rows].reset_index(drop=True).sort_values(key).index
    np.testing.assert_allclose(mine, want[order], atol=1e-4)


def test_parameters_have_an_effect(spark):
    df, _ = _data(spark)
    common = {"n_estimators": 2, "min_child_samples": 5, "patience": 100, "val_col": None}
    sizes = [len(fit_leafwise(df, ["a", "b", "c"], num_leaves=k, **common).trees[0].feature) for k in (2, 4, 16)]
    assert sizes[:2] == [3, 7] and sizes[2] > 15
    strong = fit_leafwise(df, ["a", "b", "c"], num_leaves=16, reg_alpha=1e6, **common)
    assert strong.trees == []
    with pytest.raises(ValueError, match="unknown"):
        fit_leafwise(df, ["a"], depth=3)
    with pytest.raises(ValueError, match="max_bins"):
        fit_leafwise(df, ["a"], max_bins=256)
    some = [fit_leafwise(df, ["a", "b", "c"], bagging_fraction=0.5, feature_fraction=0.7, seed=s, **common) for s in (1, 1, 2)]
    assert some[0].trees == some[1].trees != some[2].trees


def test_stops_and_is_cut_at_the_smallest_error(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(trees, "REFRESH", 2)
    df, pdf = _data(spark, 200)
    model = fit_leafwise(df, ["a", "b", "c"], patience=3, num_leaves=8, min_child_samples=2, learning_rate=0.9, n_estimators=12)
    assert len(model.trees) == int(np.argmin(model.errors)) and len(model.errors) <= 13
    out = model.transform(df).where("is_val").agg(F.avg(F.abs(F.col("load") - F.col("prediction")))).first()[0]
    assert out == pytest.approx(min(model.errors), abs=1e-6)
    assert max(model.gains(), key=model.gains().get) in ("a", "b")
    model.save(spark, str(tmp_path / "m"))
    again = LeafwiseModel.load(spark, str(tmp_path / "m"))
    assert again == model


def test_edges_and_empty_input(spark):
    df, _ = _data(spark)
    edges = quantile_edges(df, ["a", "b"], 16)
    assert len(edges[0]) <= 15 and len(edges[1]) <= 6
    with pytest.raises(ValueError, match="no training row"):
        fit_leafwise(df.where("a > 1e9"), ["a"])
