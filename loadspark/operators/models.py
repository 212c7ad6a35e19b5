"""Assembling, scaling, ridge with cross-validated penalty, boosted trees, random search, scoring and rankings."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from loadspark.operators.fills import fill_both
from loadspark.operators.split import expanding_folds
from loadspark.operators.trees import LeafwiseModel
from loadspark.series import SeriesSpec, rows_at
from loadspark.session import ensure_checkpoint_dir, materialise

GAP_COLUMN = "solar_remote_yield_ratio"
# 20 penalties evenly spaced on a log scale from 1e-2 to 1e3.
ALPHAS = [float(a) for a in np.logspace(-2, 3, 20)]


def prepare_features(df: DataFrame, spec: SeriesSpec, features: Sequence[str], target: str = "load") -> DataFrame:
    """Key, time, feature and target columns; the sparse yield ratio filled backward, then forward."""
    kept = df.select(*spec.keys, spec.ts, *spec.tie, *features, target)
    return fill_both(kept, spec, [GAP_COLUMN]) if GAP_COLUMN in features else kept


def assemble(
    df: DataFrame, features: Sequence[str], label: str | None = None, handle_invalid: str = "error", out: str = "features"
) -> DataFrame:
    """Feature vector beside the row; flags become 0/1. `handle_invalid`: error, skip, or keep (NaN)."""
    casts = {c: F.col(c).cast("double") for c, t in df.dtypes if c in set(features) and t == "boolean"}
    ready = df.withColumns(casts) if casts else df
    if label is not None and handle_invalid == "skip":
        ready = ready.where(F.col(label).isNotNull())
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid=handle_invalid).transform(ready)


def fit_scaler(train: DataFrame, ddof: int = 0, input_col: str = "features", out: str = "scaled") -> PipelineModel:
    """Centre and scale by statistics of `train` alone; `ddof=0` divides by the population deviation."""
    n = train.count()
    size = train.schema[input_col].metadata.get("ml_attr", {}).get("num_attrs")
    size = size or len(train.select(input_col).head()[0])
    factor = float(np.sqrt(n / (n - 1))) if ddof == 0 and n > 1 else 1.0
    stages = [
        StandardScaler(withMean=True, withStd=True, inputCol=input_col, outputCol=f"_{out}"),
        ElementwiseProduct(scalingVec=Vectors.dense([factor] * size), inputCol=f"_{out}", outputCol=out),
    ]
    return Pipeline(stages=stages).fit(train)


def score(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df)


def contiguous_folds(df: DataFrame, spec: SeriesSpec, k: int = 5, out: str = "fold") -> DataFrame:
    """k runs of consecutive rows over the whole table; the first `rows mod k` runs are one row longer.

    The k-1 rows at which a run starts are searched by counting (`rows_at`); no row is numbered beyond the few around
    them, and none moves: the fold is a comparison with those starts. Rows without an instant come first and are in fold 0
    at the start. `tie` should tell all rows of one instant apart.
    """
    order = [spec.ts, *spec.keys, *spec.tie]
    clock = df.select(*order)
    n, timed = clock.agg(F.count(F.lit(1)), F.count(spec.ts)).first()
    sizes = [n // k + (i < n % k) for i in range(k)]
    starts = [sum(sizes[: i + 1]) for i in range(k - 1)]
    inside = sorted({s - (n - timed) for s in starts if n - timed <= s < n})
    first_rows = rows_at(clock.where(F.col(spec.ts).isNotNull()), order, inside) if inside else {}
    place = F.struct(*order)
    types = {c: clock.schema[c].dataType for c in order}
    later = [
        F.coalesce(place >= F.struct(*(F.lit(first_rows[s][c]).cast(types[c]).alias(c) for c in order)), F.lit(False))
        for s in inside
    ]
    return df.withColumn(out, sum((F.when(F.col(spec.ts).isNotNull(), c.cast("int")).otherwise(0) for c in later), F.lit(0)))


@dataclass
class Moments:
    """Row count, means and summed cross products of features followed by the label, around their means."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(
            n,
            self.mean + gap * other.n / n,
            self.cross + other.cross + np.outer(gap, gap) * self.n * other.n / n,
        )

    def ridge(self, alpha: float) -> tuple[np.ndarray, float]:
        """Coefficients and intercept of a ridge fit whose intercept is not penalised."""
        p = len(self.mean) - 1
        coef = np.linalg.solve(self.cross[:p, :p] + alpha * np.eye(p), self.cross[:p, p])
        return coef, float(self.mean[p] - self.mean[:p] @ coef)

    def r2(self, coef: np.ndarray, intercept: float) -> float:
        """R2 of a linear predictor on the rows these moments describe."""
        p = len(self.mean) - 1
        weights = np.append(-coef, 1.0)
        bias = self.mean @ weights - intercept
        return float(1 - (weights @ self.cross @ weights + self.n * bias**2) / self.cross[p, p])


SUMS_SCHEMA = "fold int, slot int, n double, sums array<double>, products array<double>"
#: Matrices that one task adds up at once.
FAN_IN = 32


def _add_sums(parts: pd.DataFrame) -> pd.DataFrame:
    total = {c: np.sum(np.stack(parts[c].to_numpy()), axis=0) for c in ("sums", "products")}
    head = {"fold": [parts["fold"].iat[0]], "slot": [parts["slot"].min() // FAN_IN]}
    return pd.DataFrame({**head, "n": [parts["n"].sum()], **{c: [v] for c, v in total.items()}})


def fold_moments(
    df: DataFrame, cols: Sequence[str], center: np.ndarray, scale: np.ndarray, fold: str = "fold"
) -> dict[int, Moments]:
    """Moments per fold of the columns after centring and scaling, in one pass over the rows.

    Every task reduces its rows to one sum and one product matrix per fold; these are added in rounds, FAN_IN at a time, so a
    task's memory does not grow with their number and the driver gets one matrix per fold.
    """
    cols = list(cols)

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for batch in batches:
            z = (batch[cols].to_numpy(dtype=float) - center) / scale
            fold_of = batch[fold].to_numpy()
            for f in np.unique(fold_of):
                rows = z[fold_of == f]
                part = [len(rows), rows.sum(axis=0), (rows.T @ rows).ravel()]
                old = total.get(int(f))
                total[int(f)] = part if old is None else [a + b for a, b in zip(old, part)]
        if total:
            n, sums, products = zip(*total.values())
            yield pd.DataFrame(
                {"fold": list(total), "slot": 0, "n": np.array(n, dtype=float), "sums": sums, "products": products}
            )

    partial = df.select(fold, *cols).mapInPandas(reduce_rows, SUMS_SCHEMA)
    partial = materialise(partial.withColumn("slot", F.spark_partition_id()))
    slots = (partial.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > FAN_IN:
        partial = partial.groupBy("fold", F.expr(f"slot div {FAN_IN}").alias("above")).applyInPandas(_add_sums, SUMS_SCHEMA)
        slots = -(-slots // FAN_IN)
    out = {}
    for row in partial.groupBy("fold").applyInPandas(_add_sums, SUMS_SCHEMA).collect():
        mean = np.asarray(row["sums"]) / row["n"]
        products = np.asarray(row["products"]).reshape(len(cols), len(cols))
        out[row["fold"]] = Moments(row["n"], mean, products - row["n"] * np.outer(mean, mean))
    return out


def linear_model(features: Sequence[str], coefficients: Sequence[float], intercept: float) -> PipelineModel:
    """A saved-able model that scores by one projection, without feature vectors."""
    terms = [f"CAST({float(c)!r} AS DOUBLE) * CAST(`{f}` AS DOUBLE)" for f, c in zip(features, coefficients)]
    total = " + ".join([f"CAST({float(intercept)!r} AS DOUBLE)", *terms])
    return PipelineModel(stages=[SQLTransformer(statement=f"SELECT *, {total} AS prediction FROM __THIS__")])


@dataclass
class RidgeFit:
    """`coefficients` belong to the standardised features; `model` scores raw rows."""

    model: PipelineModel
    alpha: float
    scores: list[tuple[float, float]]
    features: list[str]
    coefficients: np.ndarray
    intercept: float


def ridge_cv(
    train: DataFrame,
    spec: SeriesSpec,
    features: Sequence[str],
    label: str = "load",
    alphas: Sequence[float] = tuple(ALPHAS),
    folds: int = 5,
) -> RidgeFit:
    """Ridge on standardised features, the penalty chosen by mean R2 over contiguous folds.

    One aggregation gives means and deviations, one pass the moments per fold. Every fold is then fitted on the sum
    of the other folds' moments, so 20 penalties cost 100 small solves and no further pass, and so does the final
    fit. Rows with a null feature or label are left out.
    """
    features = list(features)
    cols = [*features, label]
    typed = train.select(
        *spec.keys, spec.ts, *spec.tie, *(F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols))
    )
    names = [f"_x{i}" for i in range(len(cols))]
    # Read by five passes: means, counts of the search for folds, moments.
    known = materialise(typed.where(" and ".join(f"{c} is not null" for c in names)))
    stats = known.agg(*(F.avg(c) for c in names), *(F.stddev_pop(c) for c in names)).head()
    if stats is None or stats[0] is None:
        raise ValueError("no complete training row")
    center, spread = np.array(stats[: len(names)]), np.array(stats[len(names) :])
    scale = np.where(spread > 0, spread, 1.0)
    per_fold = fold_moments(contiguous_folds(known, spec, folds), names, center, scale)

    means = []
    for alpha in alphas:
        r2 = []
        for k, held_out in per_fold.items():
            rest = [m for j, m in per_fold.items() if j != k]
            r2.append(held_out.r2(*sum(rest[1:], rest[0]).ridge(alpha)))
        means.append(float(np.mean(r2)))
    best = float(alphas[int(np.argmax(means))])
    parts = list(per_fold.values())
    coef, intercept = sum(parts[1:], parts[0]).ridge(best)
    coef, intercept = coef * scale[-1], intercept * scale[-1] + center[-1]
    raw = coef / scale[:-1]
    model = linear_model(features, raw, intercept - float(raw @ center[:-1]))
    return RidgeFit(model, best, list(zip(alphas, means)), features, coef, float(intercept))


# Boosted tree defaults.
GBT_DEFAULTS = {"learning_rate": 0.05, "num_leaves": 63, "min_child_samples": 20, "n_estimators": 2000}
#: Rounds without a smaller validation error after which boosting stops.
PATIENCE = 50
#: Depth up to which Spark grows trees.
MAX_DEPTH = 30


def gbt_estimator(label: str, val_col: str | None, seed: int = 42, **params) -> GBTRegressor:
    """Gradient-boosted trees with absolute loss, given leaf-count style parameters.

    Trees here grow by depth: `num_leaves` becomes the depth that holds as many leaves. Spark's learner has no L1/L2
    leaf penalty: `reg_alpha` and `reg_lambda` other than 0 are refused. `trees.fit_leafwise` grows by leaf and has both.
    """
    p = {**GBT_DEFAULTS, **params}
    if p.get("reg_alpha") or p.get("reg_lambda"):
        raise ValueError("these trees have no leaf penalties; fit_leafwise has")
    depth = max(1, int(np.ceil(np.log2(p["num_leaves"]))))
    if depth > MAX_DEPTH:
        raise ValueError(f"num_leaves={p['num_leaves']} needs trees of depth {depth}; {MAX_DEPTH} is the most there is")
    est = GBTRegressor(
        featuresCol="features",
        labelCol=label,
        lossType="absolute",
        stepSize=float(p["learning_rate"]),
        maxDepth=depth,
        minInstancesPerNode=int(p["min_child_samples"]),
        maxIter=int(p["n_estimators"]),
        maxBins=int(p.get("max_bins", 256)),
        subsamplingRate=float(p.get("bagging_fraction", 1.0)),
        featureSubsetStrategy=str(p.get("feature_fraction", "all")),
        seed=seed,
        validationTol=0.0,
        checkpointInterval=10,
    )
    return est.setValidationIndicatorCol(val_col) if val_col else est


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the smallest error, looking no further than `patience` rounds past it, and whether that ended it."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def _fit_rounds(data: DataFrame, label: str, val_col: str | None, seed: int, patience: int, params: Mapping) -> GBTRegressionModel:
    """The trees up to the best round. A round depends on the rounds before it only, so a longer fit begins like a shorter one."""
    total = int({**GBT_DEFAULTS, **params}["n_estimators"])

    def fit(rows: DataFrame, rounds: int) -> GBTRegressionModel:
        return gbt_estimator(label, None, seed, **{**params, "n_estimators": rounds}).fit(rows)

    if not val_col:
        return fit(data, total)
    rows, held_out = data.where(~F.col(val_col)), data.where(F.col(val_col))
    if held_out.isEmpty():
        return fit(rows, total)
    rounds = min(total, 2 * patience)
    while True:
        trees = fit(rows, rounds)
        best, stopped = best_round(trees.evaluateEachIteration(held_out, "absolute"), patience)
        if stopped or rounds == total:
            return trees if best == rounds else fit(rows, best)
        rounds = min(total, 2 * rounds)


def fit_gbt(
    train: DataFrame, features: Sequence[str], label: str = "load", val_col: str | None = "is_val", seed: int = 42,
    patience: int = PATIENCE, **params,
) -> PipelineModel:
    """Fit on rows where `val_col` is false, stop when the error on the others has not fallen for `patience` rounds.

    Missing features are filled with the training median, as Spark's trees take no nulls.
    """
    ensure_checkpoint_dir(train.sparkSession)  # long boosting runs cut their lineage there
    casts = {c: F.col(c).cast("double") for c in features}
    typed = train.withColumns(casts).where(F.col(label).isNotNull())
    filled = [f"{c}__filled" for c in features]
    fit_rows = typed.where(~F.col(val_col)) if val_col else typed
    imputer = Imputer(inputCols=list(features), outputCols=filled, strategy="median").fit(fit_rows)
    assembler = VectorAssembler(inputCols=filled, outputCol="features")
    keep = ["features", label, *([val_col] if val_col else [])]
    data = assembler.transform(imputer.transform(typed)).select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trees = _fit_rounds(data, label, val_col, seed, patience, params)
    finally:
        data.unpersist()
    return PipelineModel(stages=[imputer, assembler, trees])


# The tuned parameters as (low, high, scale); leaf penalties have no effect here and are not drawn.
SEARCH_SPACE = {
    "learning_rate": (0.01, 0.2, "log"),
    "num_leaves": (16, 255, "int"),
    "min_child_samples": (5, 100, "int"),
    "feature_fraction": (0.5, 1.0, "linear"),
    "bagging_fraction": (0.5, 1.0, "linear"),
}


# Leaf penalties, for trees that have them.
LEAFWISE_SPACE = {**SEARCH_SPACE, "reg_alpha": (1e-8, 10.0, "log"), "reg_lambda": (1e-8, 10.0, "log")}


def draw_params(space: Mapping[str, tuple], rng: random.Random) -> dict[str, float]:
    out: dict[str, float] = {}
    for name, (low, high, scale) in space.items():
        if scale == "int":
            out[name] = rng.randint(low, high)
        elif scale == "log":
            out[name] = float(np.exp(rng.uniform(np.log(low), np.log(high))))
        else:
            out[name] = rng.uniform(low, high)
    return out


TRIAL_SCHEMA = "trial int, fold int, params map<string,double>, mae double, mean_mae double"


def random_search(
    train: DataFrame,
    spec: SeriesSpec,
    features: Sequence[str],
    splits: Sequence[datetime],
    label: str = "load",
    space: Mapping[str, tuple] = SEARCH_SPACE,
    n_trials: int = 100,
    seed: int = 42,
    horizon_days: int = 90,
    n_estimators: int = 2000,
    parallel: int = 2,
    fit: Callable = fit_gbt,
) -> DataFrame:
    """Seeded random search: each draw is fitted by `fit` (`fit_gbt` or `fit_leafwise`) and scored on every expanding fold.

    Returns one row per (trial, fold) with the validation MAE and the trial's mean. Fits are Spark jobs, started
    from a few threads so that small folds keep the cluster busy.
    """
    rng = random.Random(seed)
    trials = [draw_params(space, rng) for _ in range(n_trials)]
    folds = expanding_folds(train, spec, splits, horizon_days).withColumn("is_val", F.col("role") == "val")
    folds = folds.where(F.col(label).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)

    def run(job: tuple[int, int]) -> tuple[int, int, float]:
        trial, fold = job
        rows = folds.where(F.col("fold") == fold)
        model = fit(rows, features, label, "is_val", seed, n_estimators=n_estimators, **trials[trial])
        scored = model.transform(rows.where("is_val").withColumns({c: F.col(c).cast("double") for c in features}))
        error = scored.agg(F.avg(F.abs(F.col(label) - F.col("prediction")))).head()[0]
        return trial, fold, error

    jobs = [(t, f) for t in range(n_trials) for f in range(len(splits))]
    try:
        with ThreadPoolExecutor(parallel) as pool:
            results = list(pool.map(run, jobs))
    finally:
        folds.unpersist()
    by_trial: dict[int, list[float]] = {}
    for t, _, e in results:
        by_trial.setdefault(t, []).append(e)
    rows = [
        (t, f, {k: float(v) for k, v in trials[t].items()}, e, float(np.mean(by_trial[t]))) for t, f, e in results
    ]
    return train.sparkSession.createDataFrame(rows, TRIAL_SCHEMA)


def best_params(trials: DataFrame) -> dict[str, float]:
    """Parameters of the trial with the least mean MAE."""
    row = trials.orderBy("mean_mae", "trial").select("params").head()
    if row is None:
        raise ValueError("no trials to choose from")
    whole = {"num_leaves", "min_child_samples"}
    return {k: int(v) if k in whole else v for k, v in row["params"].items()}


def refit_best(
    train: DataFrame, trials: DataFrame, features: Sequence[str], label: str = "load", val_col: str = "is_val",
    fit: Callable = fit_gbt, **params,
) -> PipelineModel | LeafwiseModel:
    """The best trial's parameters, fitted on the whole training table."""
    return fit(train, features, label, val_col, **{**best_params(trials), **params})


def rank_coefficients(spark: SparkSession, features: Sequence[str], coefficients: Sequence[float], k: int = 20) -> DataFrame:
    """The `k` features with the largest absolute coefficient."""
    rows = [(f, float(c)) for f, c in zip(features, coefficients)]
    table = spark.createDataFrame(rows, "feature string, coefficient double")
    return table.orderBy(F.desc(F.abs("coefficient")), "feature").limit(k)


def rank_importance(
    spark: SparkSession, model: PipelineModel | LeafwiseModel, features: Sequence[str], k: int = 20
) -> DataFrame:
    """The `k` features whose splits reduced the error most."""
    if isinstance(model, LeafwiseModel):
        gains = [model.gains()[f] for f in features]
    else:
        gains = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(g)) for f, g in zip(features, gains)]
    table = spark.createDataFrame(rows, "feature string, gain double")
    return table.orderBy(F.desc("gain"), "feature").limit(k)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
