import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadspark.llm import quality_classifier as Q


def slow_buckets(text: str) -> list[int]:
    """Buckets one by one, in plain integers."""
    data = text.encode()
    blank = [b == 32 or 9 <= b <= 13 for b in data]
    code = [32] + [32 if w else b for b, w in zip(data, blank)] + [32]
    blank = [True, *blank, True]
    out = []
    i = 0
    while i < len(code):
        if blank[i]:
            i += 1
            continue
        h, power, k = 0, 16777619, 0
        powers = [pow(16777619, e + 1, 1 << 32) for e in range(256)]
        while not blank[i]:
            h += (code[i] + 1) * powers[k & 255]
            i, k = i + 1, k + 1
        out.append(h)
    for n in Q.NGRAMS:
        for s in range(len(code) - n + 1):
            if not any(blank[s + 1 : s + n - 1]):
                h = n
                for c in code[s : s + n]:
                    h = h * 709607 + c
                out.append(h)
    return sorted((h % (1 << 32)) * 2654435769 % (1 << 32) >> (32 - Q.BITS) for h in out)


@pytest.mark.parametrize("text", ["a", "ab cd", " the  cat\nsat ", "né €uro", "x" * 700, ".,; !"])
def test_buckets(text):
    assert sorted(Q.buckets_of(np.frombuffer(text.encode(), np.uint8)).tolist()) == slow_buckets(text)


def test_long_texts_are_read_in_pieces():
    rng = np.random.default_rng(0)
    model = Q.Model(rng.normal(size=1 << Q.BITS).astype(np.float32), 0.1)
    text = " ".join("w" * (1 + i % 9) for i in range(20000))
    whole = Q.buckets_of(np.frombuffer(text.encode(), np.uint8))
    pieces = [Q.buckets_of(c) for c in Q._chunks(text.encode(), 1000)]
    # Only the grams over a cut blank differ: none, since grams hold no blank inside.
    assert sorted(np.concatenate(pieces).tolist()) == sorted(whole.tolist())
    assert Q.score_texts(pd.Series([text]), model)[0] == pytest.approx(
        1 / (1 + np.exp(-(0.1 + model.log_odds[whole].mean(dtype=np.float64)))), abs=1e-9
    )


def test_learns_and_keeps_the_fold_apart(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.fit(documents, labels)
    out = Q.classify(documents.withColumn("score", F.lit("taken")), model).join(labels, "doc_id").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.9
    # Labels of the held-out fold change nothing.
    flipped = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.fit(documents, flipped)
    np.testing.assert_array_equal(model.log_odds, again.log_odds)


def test_held_out_documents(spark):
    """Accuracy and ranking on labels the fit has not seen, beside those it has."""
    sf = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = Q.classify(documents.join(labels.select("doc_id"), "doc_id", "left_semi"), Q.fit(documents, labels))
    out = scored.join(labels.where("quality IS NOT NULL"), "doc_id").withColumn("fold", Q.held_out("doc_id")).toPandas()
    unseen = out[out["fold"]]
    right = (unseen["predicted"] == unseen["quality"]).mean()
    ranks, good = unseen["score"].rank(), unseen["quality"] == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert right > max(0.93, unseen["quality"].mean()) and auc > 0.88, (right, auc)


def test_odd_rows(spark, odd, empty, frame):
    labels = frame([(1, 1, 0), (6, 0, 0), (6, 0, 0), (8, None, 0), (None, 1, 0), (7, 5, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(odd, labels)
    rows = Q.classify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if not (r["text"] or "").strip()}
    assert blank == {1 / (1 + np.exp(-model.bias))}
    assert Q.classify(empty, model).count() == 0
    nothing = Q.fit(empty, labels)
    assert {r["score"] for r in Q.classify(odd, nothing).collect()} == {0.5}
