"""Boosted trees with absolute loss, grown leaf by leaf on histograms that Spark adds up.

Features are cut into bins once, at quantiles of the training rows, and rows are stored as blocks of bin codes. To look at a
leaf, every task counts rows and sums gradients by (leaf, feature, bin) over its blocks; Spark adds the sums, and the driver,
which sees no rows but these bounded tables, picks the split. The leaf with the largest gain is split first. A pass serves the
AHEAD most promising leaves at once, whose children are then at hand when their turn comes, so the tree is the same as one
grown leaf by leaf with a pass for each; of two children the smaller is counted, the other is the difference.

With absolute loss the gradient is a sign and the value of a leaf the median of its residuals. The median is found by
counting too: the range of residuals is cut into BINS, then the bin of the median again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadspark.session import materialise
from loadspark.sources.prepared import read_json, write_json

# Boosted tree defaults.
DEFAULTS = {
    "learning_rate": 0.05, "num_leaves": 63, "min_child_samples": 20, "n_estimators": 2000, "reg_alpha": 0.0, "reg_lambda": 0.0,
    "feature_fraction": 1.0, "bagging_fraction": 1.0, "max_bins": 255,
}
#: Rounds without a smaller validation error after which boosting stops.
PATIENCE = 50
#: Leaves looked at in one pass, rows of a block, bins of a search for medians, rounds after which scores are stored again.
AHEAD, BLOCK_ROWS, BINS, REFRESH = 8, 1 << 15, 4096, 16
CODES, MISSING = 256, 255


@dataclass
class Tree:
    """Nodes in order of their numbers, parents first; a leaf has feature -1 and a value."""

    feature: list[int]
    cut: list[int]
    missing_left: list[bool]
    left: list[int]
    right: list[int]
    value: list[float]
    gain: list[float]

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of every row; `codes` has a line per feature."""
        at = np.zeros(codes.shape[1], np.int32)
        for node, f in enumerate(self.feature):
            if f >= 0:
                rows = np.flatnonzero(at == node)
                c = codes[f, rows]
                goes_left = np.where(c == MISSING, self.missing_left[node], c <= self.cut[node])
                at[rows] = np.where(goes_left, self.left[node], self.right[node])
        return at

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaves(codes)]


def codes_of(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin codes, a line per feature: the number of edges below the value; missing values have a code of their own."""
    out = np.empty((len(edges), len(x)), np.uint8)
    for f, e in enumerate(edges):
        column = x[:, f]
        out[f] = np.where(np.isnan(column), MISSING, np.searchsorted(e, column, side="left"))
    return out


def _blocks(features: list[str], edges: list[list[float]], start: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK_ROWS):
                part = pdf.iloc[at : at + BLOCK_ROWS]
                codes = codes_of(part[features].to_numpy(dtype=float), edges)
                columns = {
                    "codes": codes.tobytes(), "y": part["y"].to_numpy(dtype=float).tobytes(),
                    "held": part["held"].to_numpy(dtype=np.uint8).tobytes(), "draw": part["draw"].to_numpy(dtype=np.int64).tobytes(),
                    "score": np.full(len(part), start).tobytes(),
                }
                yield pd.DataFrame({k: [v] for k, v in columns.items()})

    return run


BLOCK = "codes binary, y binary, held binary, draw binary, score binary"


@dataclass
class State:
    """What a pass must know beside the blocks: trees since scores were stored, the tree being grown, the draw of rows."""

    trees: list[Tree] = field(default_factory=list)
    growing: Tree | None = None
    round: int = 0
    share: float = 1.0

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        """codes, y, score, held out, and drawn for this round, per block."""
        for i in range(batch.num_rows):
            data = {n: batch.column(n)[i].as_buffer() for n in batch.schema.names}
            y = np.frombuffer(data["y"])
            codes = np.frombuffer(data["codes"], np.uint8).reshape(-1, len(y))
            score = np.frombuffer(data["score"]).copy()
            for t in self.trees:
                score += t.predict(codes)
            held = np.frombuffer(data["held"], np.uint8) > 0
            drawn = ~held
            if self.share < 1:
                draw = np.frombuffer(data["draw"], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.round)
                draw = (draw ^ (draw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                drawn = drawn & ((draw >> np.uint64(11)) < np.uint64(self.share * 2**53))
            yield codes, y, score, held, drawn


def _emit(totals: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Sparse cells: where, count, sum."""
    parts = [(base + (at := np.flatnonzero(t[0])), t[0][at], t[1][at]) for base, t in totals.items()]
    at, n, g = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n.astype(float)), pa.array(g.astype(float))], names=["at", "n", "g"])


def _histograms(state: State, wanted: list[int], n_features: int):
    """Rows and gradients by (wanted leaf, feature, bin); behind them the held-out rows and their summed errors."""
    width = len(wanted) * n_features * CODES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, error = np.zeros((2, len(wanted), n_features, CODES)), np.zeros((2, 1))
        slot_of = np.full(max(wanted) + 2, -1)
        slot_of[wanted] = np.arange(len(wanted))
        for batch in batches:
            for codes, y, score, held, drawn in state.read(batch):
                error += np.array([[held.sum()], [np.abs(y - score)[held].sum()]])
                leaf = state.growing.leaves(codes)
                slot = np.where(leaf < len(slot_of), slot_of[np.minimum(leaf, len(slot_of) - 1)], -1)
                rows = np.flatnonzero(drawn & (slot >= 0))
                g = np.sign(score - y)[rows]
                for f in range(n_features):
                    cell = slot[rows] * CODES + codes[f, rows]
                    total[0, :, f] += np.bincount(cell, minlength=len(wanted) * CODES).reshape(-1, CODES)
                    total[1, :, f] += np.bincount(cell, g, len(wanted) * CODES).reshape(-1, CODES)
        yield _emit({0: total.reshape(2, -1), width: error})

    return run


def _residuals(state: State, ranges: list[tuple[int, float, float]]):
    """Rows and sums by (range, bin) of their residuals; a range is a leaf, a lowest value and the width of a bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(ranges), BINS + 2))
        for batch in batches:
            for codes, y, score, _, drawn in state.read(batch):
                leaf, residual = state.growing.leaves(codes), y - score
                for k, (node, low, width) in enumerate(ranges):
                    rows = np.flatnonzero(drawn & (leaf == node))
                    cell = np.clip(np.floor((residual[rows] - low) / width), -1, BINS).astype(np.int64) + 1
                    total[0, k] += np.bincount(cell, minlength=BINS + 2)
                    total[1, k] += np.bincount(cell, residual[rows], BINS + 2)
        yield _emit({0: total.reshape(2, -1)})

    return run


def _rescored(state: State):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([score.tobytes() for _, _, score, _, _ in state.read(batch)], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("score"), "score", scores)

    return run


class Grower:
    """Passes over the blocks, and the choice of splits from what they return."""

    def __init__(self, blocks: DataFrame, n_features: int, params: dict, low: float, high: float):
        self.blocks, self.n_features, self.params = blocks, n_features, params
        self.low, self.high = low, high

    def _sums(self, work, size: int) -> np.ndarray:
        rows = self.blocks.mapInArrow(work, "at long, n double, g double")
        found = rows.groupBy("at").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).toArrow()
        out = np.zeros((2, size))
        at = found.column("at").to_numpy()
        out[0, at], out[1, at] = found.column("n").to_numpy(), found.column("g").to_numpy()
        return out

    def histograms(self, state: State, wanted: list[int]) -> tuple[np.ndarray, float, float]:
        """Cells of each wanted leaf, held-out rows, and their summed error."""
        size = len(wanted) * self.n_features * CODES
        out = self._sums(_histograms(state, wanted, self.n_features), size + 1)
        cells = out[:, :size].reshape(2, len(wanted), self.n_features, CODES).transpose(1, 0, 2, 3)
        return cells, out[0, -1], out[1, -1]

    def medians(self, state: State, leaves: list[int]) -> dict[int, float]:
        """Median residual of each leaf: the mean of both middle values where there is no middle one."""
        first = (self.high - self.low) / BINS or 1.0
        counts = self._sums(_residuals(state, [(n, self.low, first) for n in leaves]), len(leaves) * (BINS + 2))[0].reshape(-1, BINS + 2)
        targets = []
        for node, c in zip(leaves, counts, strict=True):
            n = int(c.sum())
            for rank in ((n - 1) // 2, n // 2):
                place = int(np.searchsorted(np.cumsum(c), rank, side="right"))
                targets.append((node, self.low + (place - 1) * first, rank - c[:place].sum()))
        fine = first / BINS
        cells = self._sums(_residuals(state, [(n, low, fine) for n, low, _ in targets]), len(targets) * (BINS + 2))
        out: dict[int, float] = {}
        for (node, _, rank), c, total in zip(targets, *cells.reshape(2, -1, BINS + 2), strict=True):
            # Cells at both ends hold what rounding put beside the range.
            inside = np.cumsum(c) - (c[0] if rank < c[1:].sum() else 0)
            place = min(int(np.searchsorted(inside, rank, side="right")), int(np.flatnonzero(c)[-1]))
            out[node] = out.get(node, 0.0) + total[place] / c[place] / 2
        return out

    def split(self, cells: np.ndarray, used: list[int]) -> tuple[float, int, int, bool] | None:
        return best_split(cells, used, self.params)

    def tree(self, state: State, used: list[int]) -> tuple[Tree, float, float]:
        """One tree, and rows and error of the held-out rows before it."""
        tree = Tree([-1], [0], [True], [-1], [-1], [0.0], [0.0])
        state.growing = tree
        cells, n_held, error = self.histograms(state, [0])
        held = {0: cells[0]}
        choice = {0: self.split(held[0], used)}
        frontier, taken = [0], set()
        while len(frontier) < self.params["num_leaves"]:
            open_ = sorted((n for n in frontier if choice[n]), key=lambda n: (-choice[n][0], n))
            if not open_:
                break
            if tree.feature[open_[0]] < 0:
                todo = [n for n in open_[:AHEAD] if tree.feature[n] < 0]
                smaller = {}
                for n in todo:
                    gain, f, cut, missing_left = choice[n]
                    tree.feature[n], tree.cut[n], tree.missing_left[n], tree.gain[n] = f, cut, missing_left, gain
                    tree.left[n], tree.right[n] = len(tree.feature), len(tree.feature) + 1
                    for column, blank in ((tree.feature, -1), (tree.cut, 0), (tree.missing_left, True), (tree.left, -1), (tree.right, -1), (tree.value, 0.0), (tree.gain, 0.0)):
                        column += [blank, blank]
                    rows = held[n][0, f]
                    left = rows[: cut + 1].sum() + (rows[MISSING] if missing_left else 0)
                    smaller[n] = tree.left[n] if 2 * left <= rows.sum() else tree.right[n]
                found, _, _ = self.histograms(state, list(smaller.values()))
                for n, small, part in zip(todo, smaller.values(), found, strict=True):
                    other = tree.left[n] + tree.right[n] - small
                    held[small], held[other] = part, held[n] - part
                    for child in (small, other):
                        choice[child] = self.split(held[child], used)
            best = open_[0]
            taken.add(best)
            frontier.remove(best)
            frontier += [tree.left[best], tree.right[best]]
        return _pruned(tree, taken), n_held, error


def best_split(cells: np.ndarray, used: Sequence[int], params: dict) -> tuple[float, int, int, bool] | None:
    """gain, feature, last bin on the left, missing values to the left; None where no split gains. Ties: the first of these."""
    alpha, lam, least = params["reg_alpha"], params["reg_lambda"], params["min_child_samples"]

    def worth(g: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(g) - alpha, 0) ** 2 / np.maximum(n + lam, 1e-300)

    best = None
    for f in used:
        n, g = cells[0, f], cells[1, f]
        whole = worth(g.sum(), n.sum())
        for missing_left in (True, False):
            left_n = np.cumsum(n[:MISSING]) + (n[MISSING] if missing_left else 0)
            left_g = np.cumsum(g[:MISSING]) + (g[MISSING] if missing_left else 0)
            right_n, right_g = n.sum() - left_n, g.sum() - left_g
            gain = worth(left_g, left_n) + worth(right_g, right_n) - whole
            gain = np.where((left_n >= max(least, 1)) & (right_n >= max(least, 1)), gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (float(gain[k]), f, k, missing_left)
    return best


def _pruned(tree: Tree, taken: set[int]) -> Tree:
    """The tree with only the splits that were taken, its nodes renumbered, parents first."""
    order, place = [0], {0: 0}
    for n in order:
        if n in taken:
            for child in (tree.left[n], tree.right[n]):
                place[child] = len(order)
                order.append(child)
    kept = [n in taken for n in order]
    return Tree(
        [tree.feature[n] if k else -1 for n, k in zip(order, kept, strict=True)],
        [tree.cut[n] for n in order],
        [tree.missing_left[n] for n in order],
        [place[tree.left[n]] if k else -1 for n, k in zip(order, kept, strict=True)],
        [place[tree.right[n]] if k else -1 for n, k in zip(order, kept, strict=True)],
        [0.0] * len(order),
        [tree.gain[n] if k else 0.0 for n, k in zip(order, kept, strict=True)],
    )


@dataclass
class LeafwiseModel:
    """A start value and trees over binned features; `errors` are the held-out errors after 0, 1, 2 ... trees."""

    features: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree]
    errors: list[float]

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Add the prediction; null features count as missing."""
        features, edges, start, trees = self.features, self.edges, self.start, self.trees

        @F.pandas_udf("double")
        def predict(columns: pd.DataFrame) -> pd.Series:
            codes = codes_of(columns.to_numpy(dtype=float), edges)
            return pd.Series(sum((t.predict(codes) for t in trees), np.full(len(columns), start)))

        return df.withColumn(out, predict(F.struct(*(F.col(f).cast("double").alias(f) for f in features))))

    def gains(self) -> dict[str, float]:
        """Total gain of the splits on each feature."""
        out = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    out[self.features[f]] += gain
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        trees = [t.__dict__ for t in self.trees]
        write_json(spark, {**self.__dict__, "trees": trees}, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LeafwiseModel:
        stored = read_json(spark, path)
        return LeafwiseModel(**{**stored, "trees": [Tree(**t) for t in stored["trees"]]})


def quantile_edges(df: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """At most `max_bins` - 1 edges of each feature, at quantiles of its known values."""
    shares = [k / max_bins for k in range(1, max_bins)]
    found = df.approxQuantile(list(features), shares, 1 / (4 * max_bins))
    return [sorted(set(e)) for e in found]


def fit_leafwise(
    train: DataFrame, features: Sequence[str], label: str = "load", val_col: str | None = "is_val", seed: int = 42,
    patience: int = PATIENCE, **params,
) -> LeafwiseModel:
    """Fit on rows where `val_col` is false, stop when the error on the others has not fallen for `patience` trees.

    The model is cut at the smallest held-out error. `feature_fraction` of the features are drawn for each tree and
    `bagging_fraction` of the rows, both by `seed`. Rows without a label are left out; an unknown parameter is an error.
    """
    p = {**DEFAULTS, **params}
    if set(p) != set(DEFAULTS):
        raise ValueError(f"unknown parameters {sorted(set(p) - set(DEFAULTS))}")
    if not 2 <= p["max_bins"] <= MISSING:
        raise ValueError(f"max_bins must be 2 to {MISSING}")
    features = list(features)
    held = F.coalesce(F.col(val_col).cast("boolean"), F.lit(False)) if val_col else F.lit(False)
    numbers = [F.col(f).cast("double").alias(f) for f in features]
    rows = train.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))).select(
        *numbers, F.col(label).cast("double").alias("y"), held.alias("held"), F.xxhash64(F.lit(seed), *features, label).alias("draw")
    )
    rows = materialise(rows)
    fit_rows = rows.where("NOT held")
    low, high, n = fit_rows.agg(F.min("y"), F.max("y"), F.count("y")).first()
    if not n:
        raise ValueError("no training row")
    edges = quantile_edges(fit_rows, features, int(p["max_bins"]))
    blocks = materialise(rows.mapInPandas(_blocks(features, edges, 0.0), BLOCK))
    grower = Grower(blocks, len(features), p, low, high)
    root = Tree([-1], [0], [True], [-1], [-1], [0.0], [0.0])
    start = grower.medians(State(growing=root), [0])[0]
    # The start value is a tree of one leaf until scores are stored with it.
    state = State([Tree([-1], [0], [True], [-1], [-1], [start], [0.0])], share=float(p["bagging_fraction"]))
    rng = np.random.default_rng(seed)
    trees: list[Tree] = []
    errors: list[float] = []
    lowest, highest = low - start, high - start
    while len(trees) < p["n_estimators"]:
        n_used = max(1, round(p["feature_fraction"] * len(features)))
        used = sorted(rng.choice(len(features), n_used, replace=False).tolist())
        state.round, grower.low, grower.high = len(trees), lowest, highest
        tree, n_held, error = grower.tree(state, used)
        errors.append(error / n_held if n_held else 0.0)
        if n_held and len(errors) - 1 - int(np.argmin(errors)) >= patience:
            break
        leaves = [k for k, f in enumerate(tree.feature) if f < 0]
        if len(leaves) == 1:
            break
        state.growing = tree
        for node, median in grower.medians(state, leaves).items():
            tree.value[node] = p["learning_rate"] * median
        lowest, highest = lowest - max(tree.value), highest - min(tree.value)
        trees.append(tree)
        state.trees.append(tree)
        if len(state.trees) > REFRESH:
            grower.blocks = materialise(grower.blocks.mapInArrow(_rescored(state), BLOCK))
            state.trees = []
    if errors and any(errors) and len(trees) == len(errors):
        # The last tree's error has not been seen by a further round.
        state.growing = root
        _, n_held, error = grower.histograms(state, [0])
        errors.append(error / n_held)
    best = int(np.argmin(errors)) if any(errors) else len(trees)
    return LeafwiseModel(features, edges, start, trees[:best], errors)
