"""Quality classifier: supervised subword embeddings.

Words and the character n-grams of a text (3 to 5 bytes inside a word and its edges) are hashed into buckets that each own
a learned vector. A document is the mean of its vectors; a softmax layer on the mean gives the label. Both are trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows (MAX_TRAIN), inside one Spark task: the sample
arrives there as hashed features, never as text.

Scoring is linear up to the softmax, so the layer is applied to the buckets first: the log-odds of a document are the mean
of its buckets' log-odds plus the bias. Each worker then needs one number per bucket (256 KB in all) and reads texts in
pieces of CHUNK bytes, so memory does not grow with the length of a text.

Defined results: a null or empty text scores the bias alone, as does a text of blanks; repeated rows score alike; labels
that are null or neither 0 nor 1 are not learned from; of several labels of one key the larger counts; with no labelled rows
every score is 0.5; an empty table gives no rows; long texts are read in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadspark.llm.common import clean_text, seeded_order
from loadspark.llm.registry import query, table

BITS = 16
DIM = 8
NGRAMS = (3, 4, 5)
CHUNK = 1 << 20
#: Labelled rows that are learned from, at most.
MAX_TRAIN = 3000
EPOCHS = 8
RATE = 0.5
SEED = 5
THRESHOLD = 0.3
FOLDS = 5


@dataclass(frozen=True)
class Model:
    """Log-odds of each bucket and of an empty text."""

    log_odds: np.ndarray
    bias: float


def _chunks(data: bytes, size: int) -> Iterator[np.ndarray]:
    """The bytes in pieces that end after a blank where there is one."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data):
            blank = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            end = blank + 1 if blank > at else end
        yield np.frombuffer(data, np.uint8, end - at, at)
        at = end


def buckets_of(chunk: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Buckets of the words and n-grams of a piece of text, one entry per occurrence."""
    blank = (chunk == 32) | ((chunk >= 9) & (chunk <= 13))
    code = np.where(blank, np.uint32(32), chunk).astype(np.uint32)
    code = np.concatenate([np.full(1, 32, np.uint32), code, np.full(1, 32, np.uint32)])
    blank = np.concatenate([[True], blank, [True]])
    found = []
    # Words: sum of byte x power of its place in the word, summed between word starts.
    inside = np.flatnonzero(~blank)
    if len(inside):
        starts = np.flatnonzero(np.diff(inside, prepend=-2) != 1)
        lengths = np.diff(starts, append=len(inside))
        place = (np.arange(len(inside)) - np.repeat(starts, lengths)) & 255
        powers = np.cumprod(np.full(256, 16777619, np.uint32), dtype=np.uint32)
        found.append(np.add.reduceat((code[inside] + np.uint32(1)) * powers[place], starts, dtype=np.uint32))
    for n in NGRAMS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = h * np.uint32(709607) + code[i : i + m]
        whole = np.ones(m, bool)
        for i in range(1, n - 1):
            whole &= ~blank[i : i + m]
        found.append(h[whole])
    if not found:
        return np.zeros(0, np.uint32)
    return (np.concatenate(found) * np.uint32(2654435769)) >> np.uint32(32 - bits)


def score_texts(texts: pd.Series, model: Model) -> pd.Series:
    """Probability of label 1 for each text."""
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        total, count = 0.0, 0
        for chunk in _chunks((text or "").encode("utf-8", "replace"), CHUNK):
            b = buckets_of(chunk)
            total += float(model.log_odds[b].sum(dtype=np.float64))
            count += len(b)
        z = model.bias + (total / count if count else 0.0)
        out[i] = 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))
    return pd.Series(out)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts to distinct buckets and their counts."""
    for pdf in batches:
        ids, counts = [], []
        for text in pdf["text"]:
            total = np.zeros(1 << BITS, np.int64)
            for chunk in _chunks((text or "").encode("utf-8", "replace"), CHUNK):
                total += np.bincount(buckets_of(chunk), minlength=1 << BITS)
            used = np.flatnonzero(total)
            ids.append(used.astype(np.int32))
            counts.append(total[used].astype(np.float32))
        yield pd.DataFrame({"place": pdf["place"], "label": pdf["label"], "ids": ids, "counts": counts})


def train(
    rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, dim: int = DIM, rate: float = RATE, seed: int = SEED
) -> Model:
    """Embeddings and softmax layer by stochastic gradient descent over (label, buckets, counts)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim))
    layer, bias = np.zeros((2, dim)), np.zeros(2)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, ids, counts = rows[k]
            step = rate * (1 - done / steps)
            done += 1
            share = counts / counts.sum() if len(ids) else counts
            hidden = share @ vectors[ids] if len(ids) else np.zeros(dim)
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            back = layer.T @ p
            layer -= step * np.outer(p, hidden)
            bias -= step * p
            if len(ids):
                # A bucket's share is tiny in a long text; the step is scaled so that the mean moves by `step`.
                vectors[ids] -= np.outer(step * share / (share @ share), back)
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def _train_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("place", kind="stable")
    rows = [
        (int(y), np.asarray(i, np.int64), np.asarray(c, np.float64))
        for y, i, c in zip(pdf["label"], pdf["ids"], pdf["counts"], strict=True)
    ]
    model = train(rows)
    return pd.DataFrame({"log_odds": [model.log_odds.tolist()], "bias": [model.bias]})


def held_out(key: str) -> Column:
    """Rows that training must not see."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most MAX_TRAIN labelled rows, picked by a hash of their key."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
    sample = (
        usable.groupBy(F.col(key).alias("key"))
        .agg(F.max(label).alias("label"))
        .withColumn("place", seeded_order(SEED, "key"))
        .orderBy("place", "key")
        .limit(MAX_TRAIN)
    )
    texts = docs.select(F.col(key).alias("key"), clean_text(text).alias("text"))
    # At most MAX_TRAIN narrow rows are broadcast. One text per key, so that repeated rows do not pass the bound.
    rows = texts.join(F.broadcast(sample), "key").select("key", "place", "label", "text")
    features = rows.mapInPandas(_features, "place long, label int, ids array<int>, counts array<float>")
    found = (
        features.groupBy("place", "label").agg(F.min(F.struct("ids", "counts")).alias("f"))
        .select("place", "label", "f.ids", "f.counts")
        .groupBy(F.lit(0).alias("one"))
        .applyInPandas(_train_frame, "log_odds array<float>, bias double")
        .first()
    )
    if found is None:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(np.asarray(found["log_odds"], np.float32), float(found["bias"]))


def scorer(model: Model):
    """A vectorised function from texts to the probability of label 1."""
    log_odds, bias = model.log_odds, model.bias

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield score_texts(texts, Model(log_odds, bias))

    return score


def classify(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add `score` and `predicted` to every row; columns of these names are replaced."""
    scored = df.withColumn("score", scorer(model)(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; documents whose key hash is 0 modulo 5 are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
