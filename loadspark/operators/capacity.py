"""Installed solar capacity: rolling upper quantiles made non-decreasing, and what they predict."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from loadspark.functions.columns import guarded_ratio, nan_as_null, sum_horizontal
from loadspark.operators.clean import drop_null_rows
from loadspark.operators.fills import forward_fill
from loadspark.operators.quantiles import group_quantile
from loadspark.operators.reshape import SOLAR_COLUMNS
from loadspark.operators.rolling import IDX, Roll, roll_indexed, rolling_many
from loadspark.series import SeriesSpec, attach_per_bucket, beside, with_row_index, with_running_totals
from loadspark.session import materialise, spread_groups

GHI, POA = "sion_forecast_global_radiation", "poa_irradiance"
FIT_ROWS = 16384
PIECE_POOLS = 65536
SLOPES = 64


def pool_violators(means: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: for each entry the index of the first entry of its pool."""
    start, total, weight = [], [], []
    for i in range(len(means)):
        s, t, w = i, means[i] * weights[i], weights[i]
        while start and total[-1] * w >= t * weight[-1]:
            s, t, w = start.pop(), t + total.pop(), w + weight.pop()
        start.append(s)
        total.append(t)
        weight.append(w)
    first = np.asarray(start, dtype=np.int64)
    return np.repeat(first, np.diff(np.append(first, len(means))))


def _pool_rows(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("_idx")
    pools = pool_violators(block["_y"].to_numpy(), np.ones(len(block)))
    return block.assign(_pool=block["_idx"].to_numpy()[pools])


def _pool_pools(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("_pool")
    weight, total = block["_n"].to_numpy(dtype=float), block["_s"].to_numpy()
    pools = pool_violators(total / weight, weight)
    first, of = np.unique(pools, return_inverse=True)
    return block.assign(_fit=(np.add.reduceat(total, first) / np.add.reduceat(weight, first))[of])


def _cut_at_hull(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Split every piece at points known to lie on the lower hull of its running sums.

    For a slope t the point with the least `sum - t * rows` lies on the hull. Slopes tried are quantiles of the pool
    means and the slope of the piece's own chord. If not even the chord has a point below it, the whole piece is one
    pool: it is marked with its mean and done. So every round splits or finishes each piece.
    """
    start = F.col("_sum_y") - F.col("_s")
    chord = F.col("_rise") / F.col("_run")
    ends = pieces.groupBy(*by, "_piece").agg(
        F.min_by(start, "_rows").alias("_base"),
        (F.max_by("_sum_y", "_rows") - F.min_by(start, "_rows")).alias("_rise"),
        (F.max("_rows") - F.col("_piece")).alias("_run"),
        F.percentile_approx(F.col("_s") / F.col("_n"), [i / SLOPES for i in range(1, SLOPES)], 1000).alias("_means"),
    )
    lines = ends.select(
        *by, "_piece", "_base", chord.alias("_chord"), F.array_distinct(F.array_append("_means", chord)).alias("_slopes")
    )
    tried = attach_per_bucket(pieces, lines, [*by, "_piece"], "_blk").withColumn("_t", F.explode("_slopes"))
    gap = (F.col("_sum_y") - F.col("_base")) - F.col("_t") * (F.col("_rows") - F.col("_piece"))
    touching = tried.groupBy(*by, "_piece", "_t").agg(
        F.min(gap).alias("_gap"), F.min_by("_rows", gap).alias("_at"), F.max("_rows").alias("_last")
    )
    inner = (F.col("_gap") < 0) & (F.col("_at") < F.col("_last"))
    cuts = touching.groupBy(*by, "_piece").agg(F.collect_set(F.when(inner, F.col("_at"))).alias("_cuts"))
    known = lines.select(*by, "_piece", "_chord").join(cuts, [*by, "_piece"])
    joined = attach_per_bucket(pieces.drop("_mean"), known, [*by, "_piece"], "_blk")
    latest = F.array_max(F.filter("_cuts", lambda c: c < F.col("_rows")))
    return joined.select(
        *by,
        F.coalesce(latest, F.col("_piece")).alias("_piece"),
        "_blk",
        "_pool",
        "_s",
        "_n",
        "_sum_y",
        "_rows",
        F.when(F.size("_cuts") == 0, F.col("_chord")).alias("_mean"),
    )


def isotonic_fit(df: DataFrame, spec: SeriesSpec, cols: dict[str, str]) -> DataFrame:
    """Non-decreasing least-squares fit over the rows of each series in time order: `cols` maps column to output.

    The fit is the slope of the lower convex hull of the running sums. Each block of rows is pooled on its own first,
    which never merges rows the whole fit keeps apart. What is left is cut at hull points, which are found by plain
    aggregation, until every piece is small enough for one task; the fit on one side of a hull point does not depend
    on the other. All columns are fitted together. Rows with a null get a null.
    """

    def work(narrow: DataFrame, order: SeriesSpec) -> DataFrame:
        indexed = materialise(with_row_index(narrow, order, IDX))
        return indexed.join(fit_indexed(indexed, order, cols), [*spec.keys, IDX], "left").drop(IDX)

    return beside(df, spec, list(cols), work)


def fit_indexed(indexed: DataFrame, spec: SeriesSpec, cols: dict[str, str]) -> DataFrame:
    """The fit on stored rows that are already numbered (`_idx`): keys, number and fitted values of rows that have one."""
    by, row = [*spec.keys, "_col"], [*spec.keys, IDX]
    values = F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("y")) for i, c in enumerate(cols)))
    rows = (
        indexed.select(*row, F.explode(values).alias("_v"))
        .where(f"_v.y is not null and {IDX} is not null")
        .select(
            *row,
            F.col("_v.c").alias("_col"),
            F.expr(f"{IDX} div {FIT_ROWS}").alias("_blk"),
            F.col("_v.y").alias("_y"),
        )
    )
    pooled = materialise(
        spread_groups(rows, *by, "_blk").groupBy(*by, "_blk").applyInPandas(
            _pool_rows, T.StructType([*rows.schema.fields, T.StructField("_pool", T.LongType())])
        )
    )
    pools = pooled.groupBy(*by, "_blk", "_pool").agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n"))
    running = with_running_totals(pools, by, "_blk", [F.col("_pool")], {"_sum_y": F.col("_s"), "_rows": F.col("_n")})
    pieces = materialise(
        running.select(
            *by,
            F.lit(0).cast("long").alias("_piece"),
            *("_blk", "_pool", "_s", "_n", "_sum_y", "_rows"),
            F.lit(None).cast("double").alias("_mean"),
        )
    )
    while True:
        largest = pieces.where("_mean is null").groupBy(*by, "_piece").count().agg(F.max("count")).head()[0] or 0
        if largest <= PIECE_POOLS:
            break
        open_pieces = _cut_at_hull(pieces.where("_mean is null"), by)
        pieces = materialise(open_pieces.unionByName(pieces.where("_mean is not null")))

    last = pieces.select(*by, "_piece", "_pool", "_s", "_n").where(pieces["_mean"].isNull())
    solved = spread_groups(last, *by, "_piece").groupBy(*by, "_piece").applyInPandas(
        _pool_pools, T.StructType([*last.schema.fields, T.StructField("_fit", T.DoubleType())])
    )
    flat = pieces.where("_mean is not null").select(*by, "_pool", F.col("_mean").alias("_fit"))
    fitted = solved.select(*by, "_pool", "_fit").unionByName(flat)
    of = {out: F.max(F.when(F.col("_col") == i, F.col("_fit"))) for i, out in enumerate(cols.values())}
    return (
        pooled.select(*row, "_col", "_pool")
        .join(fitted, [*by, "_pool"])
        .groupBy(*row)
        .agg(*(c.alias(out) for out, c in of.items()))
    )


def isotonic_quantile(
    df: DataFrame,
    spec: SeriesSpec,
    cols: dict[str, str],
    q: float = 0.9,
    window: int = 2880,
    min_samples: int = 96,
    fit_until: datetime | None = None,
    extra: Sequence[Roll] = (),
    interpolation: str = "linear",
) -> DataFrame:
    """Rolling quantile of each ratio column, carried forward, then made non-decreasing: `cols` maps ratio to output.

    With `fit_until` only rows up to then take part in the fit and later rows keep its last value, so training
    rows cannot see the test span. All quantiles, and any `extra` rolling columns, share one rolling pass.
    `interpolation` says how a quantile between two values is taken, as in `Roll`.
    """
    rolls = [Roll(c, f"_r_{out}", "quantile", q, interpolation) for c, out in cols.items()]
    every = [*rolls, *extra]
    sources = {f"_r_{out}": out for out in cols.values()}

    def work(narrow: DataFrame, order: SeriesSpec) -> DataFrame:
        # Rows are numbered once; the numbers serve the rolling pass and the fit.
        indexed = materialise(with_row_index(narrow, order, IDX))
        rolled = materialise(roll_indexed(indexed, order, every, window, min_samples))
        filled = forward_fill(rolled, order, [r.out for r in every])
        if fit_until is not None:
            early = F.col(spec.ts) <= F.lit(fit_until).cast("timestamp_ntz")
            filled = filled.withColumns({c: F.when(early, F.col(c)) for c in sources})
        filled = materialise(filled)
        fitted = filled.join(fit_indexed(filled, order, sources), [*spec.keys, IDX], "left").drop(IDX, *sources)
        return fitted if fit_until is None else forward_fill(fitted, order, list(cols.values()))

    return beside(df, spec, [r.col for r in every], work)


def estimate_capacity(
    df: DataFrame,
    spec: SeriesSpec,
    threshold: float = 200.0,
    window_days: int = 30,
    min_samples: int = 96,
    production: Sequence[str] = tuple(SOLAR_COLUMNS),
    ghi: str = GHI,
    poa: str = POA,
    fit_until: datetime | None = None,
    interpolation: str = "linear",
) -> DataFrame:
    """Capacity by GHI and (if present) by plane-of-array irradiance, and the rolling median yield."""
    total = sum_horizontal(production)
    sources = {"_ratio_ghi": (ghi, "estimated_solar_capacity_ghi")}
    if poa in df.columns:
        sources["_ratio_poa"] = (poa, "estimated_solar_capacity_poa")
    ratios = {
        r: guarded_ratio(total, F.col(light) / 1000 * 0.25, F.col(light), threshold) for r, (light, _) in sources.items()
    }
    ratios["_yield_raw"] = guarded_ratio(total, F.col(ghi), F.col(ghi), threshold)
    needed = [*production, *(light for light, _ in sources.values())]

    def work(narrow: DataFrame, order: SeriesSpec) -> DataFrame:
        out = isotonic_quantile(
            narrow.withColumns(ratios),
            order,
            {r: name for r, (_, name) in sources.items()},
            0.9,
            window_days * spec.rows_per_day,
            min_samples,
            fit_until,
            [Roll("_yield_raw", "solar_yield_30d", "median")],
            interpolation,
        )
        return out.drop(*ratios)

    return beside(df, spec, needed, work)


def monthly_factor(
    df: DataFrame, spec: SeriesSpec, production: str, capacity: str, ghi: str, threshold: float = 200.0
) -> DataFrame:
    """Median of production over (capacity x irradiance) per month of the year, bright rows only."""
    bright = df.where((F.col(ghi) > threshold) & F.col(capacity).isNotNull() & F.col(production).isNotNull())
    expected = F.col(capacity) * F.col(ghi) / 1000 * 0.25
    raw = bright.select(F.month(spec.ts).alias("month"), F.try_divide(F.col(production), expected).alias("eta"))
    return group_quantile(raw, ["month"], "eta", 0.5, "eta_month")


def add_monthly_capacity(
    df: DataFrame,
    spec: SeriesSpec,
    production: str,
    capacity: str,
    ghi: str,
    threshold: float = 200.0,
    window: int = 2880,
    min_samples: int = 96,
    out: str = "cap_eta",
    interpolation: str = "linear",
) -> DataFrame:
    """Second pass: divide the monthly factor out of the ratio and fit the capacity again."""
    # A table of at most 12 rows, one per month of the year.
    factors = F.broadcast(monthly_factor(df, spec, production, capacity, ghi, threshold))
    with_eta = df.withColumn("month", F.month(spec.ts)).join(factors, "month", "left").drop("month")
    gate = F.when(F.col("eta_month").isNotNull(), F.col(ghi))
    ratio = guarded_ratio(F.col(production), F.col("eta_month") * F.col(ghi) / 1000 * 0.25, gate, threshold)
    made = beside(
        with_eta.withColumn("_ratio_eta", ratio),
        spec,
        ["_ratio_eta"],
        lambda narrow, order: isotonic_quantile(
            narrow, order, {"_ratio_eta": out}, 0.9, window, min_samples, interpolation=interpolation
        ),
    )
    return made.drop("_ratio_eta")


def reconstruct(
    df: DataFrame,
    spec: SeriesSpec,
    predictions: dict[str, str],
    actual: str,
    hours: int = 24,
) -> DataFrame:
    """Errors of reconstructed production: `predictions` maps a method to the SQL expression that rebuilds `actual`.

    Rows missing any prediction are left out; then per method the signed error and its rolling absolute mean.
    """
    keep = [*spec.keys, spec.ts, F.col(actual)]
    made = df.select(*keep, *(F.expr(e).cast("double").alias(f"pred_{m}") for m, e in predictions.items()))
    cols = [f"pred_{m}" for m in predictions]
    known = drop_null_rows(made.withColumns({c: nan_as_null(F.col(c)) for c in [actual, *cols]}))
    errors = known.withColumns({f"err_{m}": F.col(f"pred_{m}") - F.col(actual) for m in predictions}).withColumns(
        {f"abs_{m}": F.abs(F.col(f"pred_{m}") - F.col(actual)) for m in predictions}
    )
    n = int(hours * spec.rows_per_day / 24)
    rolled = rolling_many(errors, spec, [Roll(f"abs_{m}", f"mae_{m}") for m in predictions], n)
    return rolled.drop(*(f"abs_{m}" for m in predictions))


# How each method rebuilds production from its capacity curve.
METHODS = {
    "ghi": f"cap_ghi * ({GHI} / 1000 * 0.25)",
    "eta": f"cap_eta * eta_month * ({GHI} / 1000 * 0.25)",
    "poa": f"cap_poa * ({POA} / 1000 * 0.25)",
    "yield": f"solar_yield_30d * {GHI}",
}


def production_errors(df: DataFrame, spec: SeriesSpec, threshold: float = 200.0, hours: int = 24) -> DataFrame:
    """Rebuild total solar production by all four methods and compare with what was measured."""
    total = df.withColumn("solar_total", sum_horizontal(SOLAR_COLUMNS))
    caps = estimate_capacity(total, spec, threshold).withColumnsRenamed(
        {"estimated_solar_capacity_ghi": "cap_ghi", "estimated_solar_capacity_poa": "cap_poa"}
    )
    both = add_monthly_capacity(caps, spec, "solar_total", "cap_ghi", GHI, threshold, 30 * spec.rows_per_day)
    return reconstruct(both, spec, METHODS, "solar_total", hours)
