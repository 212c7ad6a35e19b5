"""Near-duplicate vectors by an inverted multi-index.

Vectors are cut into halves, each half has a codebook of its own, and the pairs of codewords are the cells of the index.
Every vector is filed in one cell. As a query it visits cells in the order of their summed distances (the multi-sequence
order), as many as it takes to reach TARGET_RECALL: that number is measured once, on a bounded sample, as the rank of
the cell in which a vector at exactly the limiting cosine lands. Visited vectors of the same label are then compared in
double precision, so a reported link is exact; recall is measured against brute force in the tests.

Codebooks are fitted on at most SAMPLE vectors; all vectors are filed. Equal vectors form one class with a count. Cells with
many rows are cut into blocks of about BLOCK rows and pairs of blocks are compared as matrices, each in a group of its own.
A group gives a count per vector and, per local component, links to its smallest member, so pairs are never listed. A pair
that two cells can see is counted in the lower one only.

Defined results: a vector that is null, empty, zero or holds null or non-finite parts, or whose label or id is null, has no
links and is its own component; vectors of different length are not compared; rows of one id are one node, and each of
them is a link of the others if their vectors are close; an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadspark.llm.links import connected_components
from loadspark.llm.registry import query, table
from loadspark.session import materialise

LIMIT = 0.98
SAMPLE = 4096
TARGET_RECALL = 0.99
#: Rows of a block; a comparison holds a matrix of twice BLOCK by twice BLOCK at most, on average BLOCK by BLOCK.
BLOCK = 1024
#: Vectors per cell aimed at when the size of the codebooks is chosen.
CELL_ROWS = 512
MOST_WORDS = 256
ROUNDS = 12
SEED = 3


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Unit vectors, cut or filled with zeros to one width."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        v = np.asarray(v, np.float64)
        out[i, : min(width, len(v))] = (v / np.linalg.norm(v))[:width]
    return out


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1), 0)


def fit_codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means with a fixed number of rounds."""
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _distances(x, words).argmin(1)
        for j in range(len(words)):
            mine = x[nearest == j]
            if len(mine):
                words[j] = mine.mean(0)
    return words


def visiting_order(first: np.ndarray, second: np.ndarray, visits: int) -> np.ndarray:
    """The first cells of the multi-sequence order, per row of the distances to the words of both halves.

    With both halves sorted, the cell of ranks (i, j) comes after all cells of lower ranks, so only cells with
    (i + 1)(j + 1) <= visits can be among the first `visits`.
    """
    a, b = np.argsort(first, 1, kind="stable"), np.argsort(second, 1, kind="stable")
    ranks = [(i, j) for i in range(first.shape[1]) for j in range(second.shape[1]) if (i + 1) * (j + 1) <= visits]
    i, j = np.array(ranks).T
    rows = np.arange(len(first))[:, None]
    cost = np.take_along_axis(first, a, 1)[:, i] + np.take_along_axis(second, b, 1)[:, j]
    chosen = np.argsort(cost, 1, kind="stable")[:, :visits]
    return a[rows, i[chosen]] * second.shape[1] + b[rows, j[chosen]]


class Index:
    """Two codebooks and the number of cells a query visits."""

    def __init__(self, sample: np.ndarray, words: int, limit: float, recall: float, seed: int = SEED):
        self.width = sample.shape[1]
        self.half = max(1, self.width // 2)
        self.first = fit_codebook(sample[:, : self.half], words, seed)
        self.second = fit_codebook(sample[:, self.half :], words, seed + 1)
        # A neighbour at the limit: the vector turned towards a random direction.
        rng = np.random.default_rng(seed + 2)
        side = rng.normal(size=sample.shape)
        side -= (side * sample).sum(1, keepdims=True) * sample
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
        near = limit * sample + np.sqrt(1 - limit * limit) * side
        self.visits = 1
        landed = self.cells(near)[:, 0]
        first, second = _distances(sample[:, : self.half], self.first), _distances(sample[:, self.half :], self.second)
        rows = np.arange(len(sample))
        cost = first[rows, landed // len(self.second)] + second[rows, landed % len(self.second)]
        # Rank of a cell: how many cells cost less.
        rank = [np.searchsorted(np.sort(b), c - a).sum() for a, b, c in zip(first, second, cost, strict=True)]
        self.visits = min(int(np.quantile(rank, recall)) + 1, len(self.first) * len(self.second))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cells to visit, the own one first."""
        return visiting_order(
            _distances(x[:, : self.half], self.first), _distances(x[:, self.half :], self.second), self.visits
        )


def _usable(vector) -> bool:
    if vector is None or len(vector) == 0:
        return False
    v = np.asarray(vector, np.float64)
    return bool(np.isfinite(v).all() and v.any() and np.isfinite(v @ v) and (v @ v) > 0)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        digest = [
            hashlib.md5(np.asarray(v, np.float64).tobytes()).digest() if _usable(v) else None for v in pdf["vector"]
        ]
        yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64"), "label": pdf["label"], "digest": digest})


def _filed(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = index.cells(_matrix(list(pdf["vector"]), index.width))
            yield pdf.assign(home=cells[:, 0].astype(np.int64), visits=[np.sort(c).astype(np.int64) for c in cells])

    return run


def _found(classes, found, node, to) -> pd.DataFrame:
    return pd.DataFrame({"class": pd.Series(classes, dtype=object), "found": found, "node": node, "to": to})


def _compare(limit: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = int(pdf["cell"].iloc[0])
        members, visitors = pdf[pdf["member"]], pdf[~pdf["member"]]
        if not len(members) or not len(visitors):
            return _found([], [], [], [])
        m, q = np.stack(list(members["vector"])).astype(np.float64), np.stack(list(visitors["vector"])).astype(np.float64)
        cosine = (q @ m.T) / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(m, axis=1))
        near = cosine >= limit
        qi, mi = np.nonzero(near)
        if len(qi):
            q_class, m_class = visitors["class"].to_numpy(), members["class"].to_numpy()
            home = visitors["home"].to_numpy()[qi]
            # Both in this cell: each pair once, by class. Else the pair is also seen in the visitor's cell if the member
            # goes there, and counts in the lower of both cells.
            same = home == cell
            seen = {h: np.array([h in v for v in members["visits"].map(set)]) for h in set(home[~same & (home < cell)].tolist())}
            keep = np.where(same, q_class[qi] > m_class[mi], True)
            for h, goes in seen.items():
                keep &= ~((home == h) & goes[mi])
            qi, mi = qi[keep], mi[keep]
        if not len(qi):
            return _found([], [], [], [])
        n_q, n_m = visitors["copies"].to_numpy(), members["copies"].to_numpy()
        q_found = np.bincount(qi, weights=n_m[mi], minlength=len(q)).astype(np.int64)
        m_found = np.bincount(mi, weights=n_q[qi], minlength=len(m)).astype(np.int64)
        # Components of the block: visitors and members as two sides of one matrix.
        ids = np.concatenate([visitors["node"].to_numpy(), members["node"].to_numpy()])
        links = np.zeros((len(q), len(m)), bool)
        links[qi, mi] = True
        label, top = ids.copy(), np.iinfo(np.int64).max
        while True:
            side = np.minimum(label[len(q) :], np.where(links, label[: len(q), None], top).min(0))
            other = np.minimum(label[: len(q)], np.where(links, side[None, :], top).min(1))
            now = np.concatenate([other, side])
            if (now == label).all():
                break
            label = now
        classes = np.concatenate([visitors["class"].to_numpy(), members["class"].to_numpy()])
        found = np.concatenate([q_found, m_found])
        hit = found > 0
        return _found(classes[hit], found[hit], ids[hit], label[hit])

    return run


def linked_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    limit: float = LIMIT,
    recall: float = TARGET_RECALL,
) -> DataFrame:
    """`key`, n_links, component_id, kept for every row."""
    rows = df.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector")
    )
    known = materialise(rows.mapInPandas(_digests, "vec_id long, label string, digest binary"))
    usable = known.where("digest IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    counted = usable.groupBy("label", "digest").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(counted.withColumn("class", F.concat_ws(":", F.hex("digest"), "label")))
    plain = usable.join(
        classes.select(F.col("label").alias("l"), F.col("digest").alias("d"), "node", "copies", "class"),
        (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")),
    ).select("vec_id", "node", "copies", "class")
    alone = known.where("digest IS NULL OR label IS NULL OR vec_id IS NULL").select(
        F.col("vec_id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    # One vector per class: the row of its smallest id (rows of one id may hold different vectors, so by digest too).
    heads = rows.join(
        classes.select(F.col("node").alias("n"), F.col("label").alias("l"), "digest", "copies", "class"),
        (F.col("vec_id") == F.col("n")) & (F.col("label") == F.col("l")),
    ).select(F.col("n").alias("node"), "label", "digest", "copies", "class", "vector")
    heads = materialise(
        heads.mapInPandas(_own, "node long, label string, copies long, class string, vector array<double>")
        .dropDuplicates(["class"])
    )
    n = heads.count()
    sample = [r["vector"] for r in heads.orderBy(F.xxhash64("class")).select("vector").limit(SAMPLE).collect()]
    if not sample:
        return alone
    width = max(map(len, sample))
    words = max(2, min(MOST_WORDS, isqrt(max(1, n // CELL_ROWS))))
    index = Index(_matrix(sample, width), words, limit, recall)
    filed = materialise(
        heads.mapInPandas(
            _filed(index),
            "node long, label string, copies long, class string, vector array<double>, home long, visits array<long>",
        )
    )
    links = _links_in_cells(filed, limit)
    found = links.groupBy(F.col("class").alias("c")).agg(F.sum("found").alias("found"))
    parts = connected_components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    # Copies are links too: of one id they are rows, of several ids they hang on the smallest.
    out = plain.join(found, F.col("class") == F.col("c"), "left")
    out = out.join(parts.select(F.col("node").alias("p"), "component"), F.col("node") == F.col("p"), "left")
    n_links = F.col("copies") - 1 + F.coalesce("found", F.lit(0))
    component = F.coalesce("component", "node")
    return out.select(
        F.col("vec_id").alias(key),
        n_links.cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    ).unionByName(alone)


def _own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose vector is the one of the class they were joined to."""
    for pdf in batches:
        vectors = [np.asarray(v, np.float64) if _usable(v) else None for v in pdf["vector"]]
        same = [
            v is not None and hashlib.md5(v.tobytes()).digest() == d for v, d in zip(vectors, pdf["digest"], strict=True)
        ]
        yield pdf.assign(vector=vectors)[same][["node", "label", "copies", "class", "vector"]]


def _links_in_cells(filed: DataFrame, limit: float) -> DataFrame:
    """class, found (links of the class, copies counted), node and the smallest node of its local component."""
    group = ["label", "size", "cell"]
    rows = filed.withColumn("size", F.size("vector"))
    members = rows.select("*", F.col("home").alias("cell"))
    visitors = rows.select("*", F.explode("visits").alias("cell"))
    n_members = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n_members"))
    n_visitors = visitors.groupBy(*group).agg(F.count(F.lit(1)).alias("n_visitors"))
    blocks = n_members.join(n_visitors, group).select(
        *group,
        F.ceil(F.col("n_members") / BLOCK).cast("int").alias("m_blocks"),
        F.ceil(F.col("n_visitors") / BLOCK).cast("int").alias("v_blocks"),
    )
    blocks = materialise(blocks)

    def cut(side: DataFrame, mine: str, theirs: str, member: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("class"), F.col(mine))
        both = side.join(blocks, group).select(
            *group, "node", "class", "copies", "vector", "home", "visits", own.alias("own"),
            F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias("other"),
        )
        return both.select(
            *group, "node", "class", "copies", "vector", "home", "visits",
            F.lit(member).alias("member"),
            F.col("own" if member else "other").cast("long").alias("m_block"),
            F.col("other" if member else "own").cast("long").alias("v_block"),
        )

    both = cut(members, "m_blocks", "v_blocks", True).unionByName(cut(visitors, "v_blocks", "m_blocks", False))
    return materialise(
        both.groupBy(*group, "m_block", "v_block").applyInPandas(
            _compare(limit), "class string, found long, node long, to long"
        )
    )


@query("op3_vector_dedup")
def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and survivors of all vectors."""
    return linked_vectors(table(spark, sf_dir, "embeddings"))
