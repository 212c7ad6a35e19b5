import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loadspark.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def made():
    rng = np.random.default_rng(0)
    out = ["a b c a b c", "a a a a a", "x y", "", None, "\n\n a \n a \n a", "a\rb\x0bc\x0cd  e", "😀 😀 😀 😀 #*$", "\x85 \xa0 x"]
    for _ in range(40):
        n = int(rng.integers(0, 400))
        out.append("".join(rng.choice(["a", "b", "cc"]) + rng.choice([" ", " ", "\n", "  "]) for _ in range(n)))
    return out


def test_counts_equal_brute_force(frame):
    df = frame(list(enumerate(made())), "doc_id long, text string")
    for r in Q.measure(df).collect():
        assert tuple(r[c] for c in Q.COUNTS) == brute(r["text"]), r["text"]


def test_rules_are_a_table(frame):
    df = frame([(1, "the word " * 40 + "end"), (2, " ".join(f"the{i}" for i in range(60)))], "doc_id long, text string")
    tight = (Q.Rule("length", "word_chars", "n_words", 100.0, None),)
    rows = {r["doc_id"]: r for r in Q.apply_rules(df, rules=tight).collect()}
    assert rows[1]["base_failed"] and not rows[2]["base_failed"]
    assert rows[2]["failed_rules"] == ["length"] and not rows[2]["kept"]
    assert all(r["kept"] != r["base_failed"] for r in Q.apply_rules(df, rules=()).collect())


def test_good_documents_stay(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = Q.apply_rules(documents).join(labels, "doc_id").where("NOT base_failed")
    assert out.where("quality = 1 AND NOT kept").count() == 0
    assert out.where("quality = 0 AND kept").count() <= 0.1 * out.where("quality = 0").count()


def test_odd_rows(odd, empty):
    df = odd.withColumn("kept", F.lit("taken")).withColumn("n_words", F.lit("taken"))
    rows = Q.apply_rules(df).collect()
    assert len(rows) == odd.count()
    assert all(r["n_words"] == brute(r["text"])[0] for r in rows)
    assert Q.apply_rules(empty).count() == 0
