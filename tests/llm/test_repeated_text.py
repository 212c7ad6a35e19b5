import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadspark.llm import repeated_text as R
from loadspark.llm.queries import QUERIES


def brute(texts, length):
    """kept bytes and removed spans per text, from a table of all strings."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        gone = np.cumsum(covered)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def check(frame, texts, length, size):
    df = frame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(R.remove_repeats(df, length=length, size=size).collect(), key=lambda r: r["doc_id"])
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows]
    assert got == brute(texts, length)


def made(seed):
    """Passages in several surroundings, overlaps, periods, borders one byte short and one byte long."""
    rng = np.random.default_rng(seed)

    def text(n):
        return "".join(rng.choice(list("abcdé "), n))

    passages = [text(n) for n in (29, 30, 31, 45, 80, 200)]
    out = ["", None, "short", "ab" * 60, "a" * 90, "abc" * 40, text(300)]
    out += [out[-1]] * 3 + [out[-1][:150] + "#" + out[-1][150:]]
    for _ in range(25):
        out.append("".join(text(int(rng.integers(0, 40))) + str(rng.choice(passages)) for _ in range(int(rng.integers(0, 4)))))
    return [None if t is None else str(t) for t in out]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_brute_force(frame, seed):
    check(frame, made(seed), 30, 9)


def test_names_with_many_runs(frame, monkeypatch):
    """The way for names beyond the limit gives the same result."""
    monkeypatch.setattr(R, "MOST_RUNS", 3)
    monkeypatch.setattr(R, "GROUP_RUNS", 10)
    check(frame, made(3), 30, 9)


def test_texts_read_in_pieces(frame, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 50)
    check(frame, made(4), 30, 9)


def test_whole_table(spark, sf, texts):
    want = dict(zip(texts, brute(texts.values(), R.LENGTH)))
    rows = QUERIES["op9_repeated_text"](spark, sf).collect()
    assert len(rows) == len(texts) and any(r["n_removed"] for r in rows)
    for r in rows:
        n, removed, spans, kept = want[r["doc_id"]]
        got = (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        assert got == (n, removed, spans, hashlib.sha256(kept).hexdigest())


def test_window_minima():
    rng = np.random.default_rng(5)
    for n, width in ((5, 5), (40, 7), (41, 1), (64, 8)):
        x = rng.integers(0, 100, n).astype(np.uint64)
        assert R.window_minima(x, width).tolist() == [x[i : i + width].min() for i in range(n - width + 1)]


def test_odd_rows(odd, empty):
    df = odd.withColumn("kept", F.lit("taken")).withColumn("spans", F.lit("taken"))
    rows = R.remove_repeats(df).collect()
    assert len(rows) == odd.count()
    by_key = {r["doc_id"]: r for r in rows}
    assert by_key[2]["n_bytes"] == by_key[3]["n_bytes"] == 0 and bytes(by_key[5]["kept"]) == b"one"
    assert by_key[6]["n_removed"] == 5000 and by_key[8]["n_removed"] == 15000
    assert R.remove_repeats(empty).count() == 0


def test_structured_strings_have_hashes_of_their_own():
    """Two Thue-Morse strings, which polynomials modulo a power of two confuse."""
    from loadspark.llm.hashing import Substrings

    bits = np.array([bin(i).count("1") % 2 for i in range(4096)], np.uint8) + 97
    hashes = Substrings(8192).read(np.concatenate([bits, 195 - bits]))
    assert hashes.at(np.array([0]), np.array([4096])) != hashes.at(np.array([4096]), np.array([8192]))
    assert (hashes.all(100)[:50] == hashes.at(np.arange(50), np.arange(50) + 100)).all()


def test_the_text_left_is_shown(spark, tmp_path):
    """A cut through a character leaves a replacement sign in the text and its bytes in the digest."""
    same = "x" + "é" * 220 + "y" * 7
    rows = [(1, "a" * 50 + "à" + same), (2, "b" * 50 + "é" + same), (3, "clean")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in R.op9_repeated_text(spark, str(tmp_path)).collect()}
    assert got[3]["text"] == "clean" and got[3]["n_removed"] == 0
    assert got[1]["text"] == "a" * 50 + "à" and got[1]["n_removed"] == len(same.encode())
    same = "é" * 220
    rows = [(1, "a" * 50 + "©" + same), (2, "b" * 50 + "é" + same)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/two/documents.parquet")
    got = {r["doc_id"]: r for r in R.op9_repeated_text(spark, f"{tmp_path}/two").collect()}
    assert got[1]["text"].startswith("a" * 50) and got[1]["n_bytes"] == 492
