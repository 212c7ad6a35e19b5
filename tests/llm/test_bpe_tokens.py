import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadspark.llm import bpe_tokens as B
from loadspark.llm.queries import QUERIES

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def vocabulary():
    return B.load_vocabulary(B.model_path())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(B.model_path())


def cases():
    rng = random.Random(0)
    letters = "abcdefghijklmnopqrstuvwxyz   .,;:'\"()-_=/\\\n\tABCé漢😀1234567890<|>İßΣς́ẞ\x00\x1c\x85​"
    fixed = [
        "", " ", "a", "the" * 4000, "a" * 5000, "." * 777, "12345" * 90, "'s't're'VE I'LL", "İstanbul ΑΣ Σ ſ K", "각 한국어",
        "<|startoftext|>x<|endoftext|>", "a<|endoftext|>b <|ENDOFTEXT|>", "é ́b", "</w> a</w>b", "漢字" * 200,
    ]
    some = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    return fixed + some + ["".join(rng.choice("etaoins") for _ in range(rng.randint(1, 60))) for _ in range(500)]


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<i4").tolist()


def test_ids_and_texts_equal_the_library(vocabulary, library):
    encoder, decoder = B.Encoder(vocabulary), B.Decoder(vocabulary)
    for text in cases():
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(encoder, text) == want, text[:60]
        assert np.frombuffer(encoder.encode_all([text])[0], "<i4").tolist() == want
        decoded = decoder.texts(np.array(want, np.int64), np.array([len(want)]))
        assert decoded.to_pylist() == [library.decode(want, skip_special_tokens=False)]


def test_ascii_runs_are_cut_without_the_library(vocabulary, library):
    rng = random.Random(4)
    signs = [*map(chr, range(33, 127)), *["'"] * 20, *"stvremldSLD"]
    runs = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    runs += ["I'LL", "'s't're've'm'll'd", "x'S", "''ll", "Word", "no_1'd", "\x00a", "a\x1fb", "<|x|>"]
    encoder, read = B.Encoder(vocabulary), []

    class Cutter:
        def pre_tokenize_str(self, text, real=encoder.cutter):
            read.append(text)
            return real.pre_tokenize_str(text)

    encoder.cutter = Cutter()
    got = [np.frombuffer(x, "<i4").tolist() for x in encoder.encode_all([" ".join(runs[:-3]), *runs[-3:], None])]
    assert len("".join(read)) < 40
    assert got == [library.encode(t, add_special_tokens=False).ids for t in (" ".join(runs[:-3]), *runs[-3:], "")]


def test_small_caches_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(B, "CACHE_BYTES", 2000)
    monkeypatch.setattr(B, "CACHE_PAIRS", 5)
    encoder = B.Encoder(vocabulary)
    for text in cases():
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids
    assert encoder.runs.used <= 2000 and len(encoder.pairs) <= 5


def merge(word, merges, suffix):
    """The merge procedure: lowest rank first, leftmost on ties."""
    parts = [*word[:-1], word[-1] + suffix]
    while True:
        ranked = [(merges.get((a, b), 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        if not ranked or min(ranked)[0] == 1 << 30:
            return parts
        k = min(ranked)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_backtracking_equals_merging_for_made_vocabularies(tmp_path, seed):
    """Few letters and random merges, so that many longest matches are wrong and many tokens cannot stand."""
    rng = random.Random(seed)
    suffix = "</w>" if seed % 2 else ""
    tokens = [*"abc", *(c + suffix for c in "abc")] if suffix else [*"abc"]
    pairs = []
    for _ in range(400):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if not (suffix and a.endswith(suffix)) and a + b not in tokens and len(a + b) < 14:
            pairs.append((a, b))
            tokens.append(a + b)
    vocab = {t: i for i, t in enumerate(tokens)}
    model = {"type": "BPE", "vocab": vocab, "merges": [list(p) for p in pairs], "end_of_word_suffix": suffix or None}
    file = {"model": model, "added_tokens": [], "decoder": None, "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}}
    path = tmp_path / "small.json"
    path.write_text(json.dumps(file))
    encoder = B.Encoder(B.load_vocabulary(str(path)))
    ranks = {p: k for k, p in enumerate(pairs)}
    for _ in range(1500):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        want = [vocab[t] for t in merge(word, ranks, suffix)]
        assert np.frombuffer(encoder.word(word), "<i4").tolist() == want, word


def test_whole_table(spark, sf, texts, library):
    rows = QUERIES["op11_bpe_tokens"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(odd, empty, vocabulary, library):
    df = odd.withColumn("ids", F.lit("taken")).withColumn("decoded", F.lit("taken"))
    both = B.encode(df, vocabulary, decoded="decoded")
    assert sorted(both.columns) == sorted(df.columns)
    rows = B.decode(both.withColumnRenamed("decoded", "once"), vocabulary).collect()
    assert len(rows) == odd.count()
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["once"] == r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert B.encode(empty, vocabulary, decoded="decoded").count() == 0
    nothing = odd.select(F.lit(None).cast("array<int>").alias("ids"))
    assert {r["decoded"] for r in B.decode(nothing, vocabulary).collect()} == {""}
