import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadspark.llm import near_dedup as N
from loadspark.llm.links import connected_components
from loadspark.llm.queries import QUERIES

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < words:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(texts, words, percent=80):
    sets = {k: shingles(t, words) for k, t in texts.items()}
    holders, pairs = defaultdict(list), []
    for k, s in sets.items():
        shared = Counter(j for x in s for j in holders[x])
        pairs += [(j, k) for j, n in shared.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
        for x in s:
            holders[x].append(k)
    return sets, components(texts, pairs)


def test_whole_table(spark, sf, texts):
    sets, want = brute(texts, 2)
    rows = QUERIES["op4_near_dedup"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("words", [1, 2, 5])
def test_chains_and_groups(frame, words):
    """Copies that differ more and more: neighbours are linked, ends are not."""
    rng = np.random.default_rng(words)
    rows, key = [], 0
    for _ in range(12):
        w = [f"w{rng.integers(0, 10**6)}" for _ in range(int(rng.integers(8, 60)))]
        for _ in range(int(rng.integers(1, 12))):
            rows.append((key, " ".join(w)))
            key += 1
            for _ in range(int(rng.integers(0, 3))):
                w[rng.integers(0, len(w))] = f"n{rng.integers(0, 10**6)}"
    rng.shuffle(rows)
    rows = [(int(k), str(t)) for k, t in rows]
    sets, want = brute(dict(rows), words)
    got = N.near_duplicates(frame(rows, "doc_id long, text string"), words=words).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_noisy_group_is_compared_in_blocks(frame, monkeypatch):
    """Copies with changes of their own: many pairs are linked, many are not, and no single member is linked to all."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for i in rng.choice(120, int(rng.integers(2, 14)), replace=False):
            w[i] = f"n{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    _, want = brute(dict(rows), 2)
    monkeypatch.setattr(N, "BLOCK", 32)
    got = N.near_duplicates(frame(rows, "doc_id long, text string"), words=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) > 1


def test_drop_keeps_one_of_each_group(documents, texts):
    _, want = brute(texts, 5)
    kept = N.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_texts_of_one_key_are_documents_of_their_own(frame):
    """Rows that share a key lose neither their text nor their links."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(11)) for x in "abc")
    schema = "doc_id long, text string"
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more")]
    got = {(r["doc_id"], r["component_id"]) for r in N.near_duplicates(frame(rows, schema), words=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}
    left = N.drop_near_duplicates(frame(rows, schema), words=2).collect()
    assert sorted(map(tuple, left)) == [(1, a), (1, b)]
    rows = [(1, a), (1, b), (5, c), (1, a), (7, c.upper()), (1, a + " more")]
    left = {tuple(r) for r in N.drop_near_duplicates(frame(rows, schema), words=2).collect()}
    assert {(1, b), (5, c)} < left and len(left) == 3
    assert len(left & {(1, a), (1, a + " more")}) == 1


def test_keys_sort_as_numbers(frame):
    keys = [-(1 << 63), -5, -1, 0, 1, 255, 256, (1 << 63) - 1]
    df = frame([(k, "t") for k in reversed(keys)], "doc_id long, text string").select("doc_id", N._own("doc_id", "text").alias("own"))
    rows = df.orderBy("own").withColumn("back", N._key_of("own")).collect()
    assert [r["doc_id"] for r in rows] == [r["back"] for r in rows] == keys


def test_structured_words_have_hashes_of_their_own():
    """Two Thue-Morse words, which polynomial hashes modulo a power of two confuse."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    words = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    assert len(set(N.word_hashes(" ".join(words)).tolist())) == 2


def test_signatures_estimate_similarity(frame):
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for share in (0.0, 0.3, 0.8, 1.0):
        common = int(1000 * share)
        a, b = pool[:1000], np.concatenate([pool[:common], pool[2000 : 3000 - common]])
        true = common / (2000 - common)
        bits = [N.packed_bits(N.minima(x, N.HASHES), N.BITS).tolist() for x in (a, b)]
        row = frame([tuple(bits)], "a array<long>, b array<long>").select(N.estimated_similarity("a", "b").alias("s")).first()
        assert abs(row["s"] - true) < N.MARGIN


def test_intersections(monkeypatch):
    monkeypatch.setattr(N, "COLUMNS", 7)
    rng = np.random.default_rng(8)
    a, b = ([np.unique(rng.integers(0, 60, n)) for n in rng.integers(1, 40, 12)] for _ in range(2))
    assert N._common(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_words_are_read_in_pieces(monkeypatch):
    text = "Über  die\tBrücke " * 50 + "x" * 300 + " end"
    whole = N.word_hashes(text)
    monkeypatch.setattr(N, "PIECE", 64)
    assert (N.word_hashes(text) == whole).all()


def test_odd_rows(odd, empty):
    df = odd.withColumn("n_shingles", F.lit("taken")).withColumn("kept", F.lit(1))
    rows = N.near_duplicates(df).collect()
    assert len(rows) == odd.count()
    by_key = {r["doc_id"]: r for r in rows}
    assert by_key[2]["n_shingles"] == by_key[3]["n_shingles"] == by_key[4]["n_shingles"] == 0
    assert by_key[2]["kept"] and by_key[3]["kept"] and by_key[5]["n_shingles"] == 1 == by_key[8]["n_shingles"]
    assert by_key[None]["component_id"] is None and by_key[None]["kept"]
    assert N.near_duplicates(empty).count() == 0
    left = N.drop_near_duplicates(df)
    assert left.columns == df.columns and left.count() == odd.count() - 1


def test_connected_components(frame):
    rng = np.random.default_rng(6)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)]
    pairs += [tuple(int(x) for x in rng.integers(200, 300, 2)) for _ in range(60)]
    pairs += [(7, 7), (3, 2)]
    rng.shuffle(pairs)
    pairs = [(int(a), int(b)) for a, b in pairs]
    got = {r["node"]: r["component"] for r in connected_components(frame(pairs, "a long, b long")).collect()}
    want = components({x for p in pairs if p[0] != p[1] for x in p}, [p for p in pairs if p[0] != p[1]])
    assert got == want
    assert connected_components(frame([], "a long, b long")).count() == 0
