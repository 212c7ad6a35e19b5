import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadspark.llm import sentence_pieces as S
from loadspark.llm.bpe_tokens import model_path
from loadspark.llm.queries import QUERIES

spm = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def vocabulary():
    return S.load_vocabulary()


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=model_path(S.MODEL))


def cases():
    rng = random.Random(0)
    letters = "abcdefghijklmnopqrstuvwxyz   .,;:'\"()-_=/\\\n\tABCé漢😀1234567890"
    fixed = [
        "", "a", " a", "  a   b", "\t\nx", "the" * 3000, "a" * 700, " " * 100, "x" + " " * 40 + "y", "12345" * 90,
        "İstanbul ſ K", "…—“quoted”", "def f(x):\n    return x**2  # ok\n\n", "ßüöä" * 200, "\x00\x01", "é‍", "<s></s><unk><0x41>",
    ]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(150)]


def test_ids_equal_the_library(vocabulary, library):
    encoder = S.Encoder(vocabulary)
    for text in cases():
        ids = encoder.encode(text).tolist()
        assert ids == library.encode(text), text[:60]
        assert encoder.decode(ids) == text


def test_short_runs_through_the_automaton(vocabulary, library):
    """Both passes give the same chain, with characters that have no piece too; words with an end of signs are cut once."""
    encoder, rng = S.Encoder(vocabulary), random.Random(5)
    assert len(encoder.automaton) == len(vocabulary.standing)
    for _ in range(400):
        run = "".join(rng.choice("etaoinsrhldcumßé漢😀𐍈") for _ in range(rng.randint(1, 40)))
        assert encoder._short(run) == list(encoder.segment(run)), run
    cut = []
    encoder._cuts, cuts = lambda unit: cut.append(unit) or cuts(unit), encoder._cuts
    assert encoder.encode("Ndreea, thtionerth").tolist() == library.encode("Ndreea, thtionerth") and cut == ["▁Ndreea,"]


def test_texts_of_many_ids_at_once(vocabulary):
    encoder = S.Encoder(vocabulary)
    texts = [*cases(), "a ▁ b", ""]
    found = [encoder.encode(t) for t in texts]
    flat = np.concatenate(found)
    assert encoder.texts(flat, np.array(list(map(len, found)))) == [encoder.decode(i.tolist()) for i in found] == texts


def test_the_space_sign_itself_comes_back(vocabulary):
    encoder = S.Encoder(vocabulary)
    for text in ("▁", "a▁b ▁▁ c", " ▁ "):
        assert encoder.decode(encoder.encode(text).tolist()) == text


def test_streaming_commits_early(vocabulary, library):
    """A run far longer than the window is committed while it is read."""
    encoder = S.Encoder(vocabulary)
    rng = random.Random(1)
    run = "".join(rng.choice("etaoinshr") for _ in range(4000))
    read = 0

    class Watched(str):
        def __getitem__(self, k):
            nonlocal read
            if isinstance(k, slice) and k.stop is not None:
                read = max(read, min(k.stop, len(run)))
            return str.__getitem__(self, k)

    first = next(encoder.segment(Watched(S.SPACE + run)))
    assert read < 500
    assert first == library.encode(run)[0]
    assert encoder.encode(run).tolist() == library.encode(run)


def test_small_caches_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(S, "CACHE_BYTES", 2000)
    monkeypatch.setattr(S, "CACHE_PAIRS", 5)
    encoder = S.Encoder(vocabulary)
    for text in cases()[-40:]:
        assert encoder.encode(text).tolist() == library.encode(text)
    assert max(encoder.runs.used, encoder.words.used) <= 2000


def test_whole_table(spark, sf, texts, library):
    rows = QUERIES["op10_sentence_pieces"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["round_trip"] and r["n_ids"] == len(r["ids"])
        assert list(r["ids"]) == library.encode(texts[r["doc_id"]])


def test_odd_rows(odd, empty, vocabulary):
    df = odd.withColumn("ids", F.lit("taken")).withColumn("decoded", F.lit("taken"))
    rows = S.decode(S.encode(df, vocabulary), vocabulary).collect()
    assert len(rows) == odd.count()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    assert S.encode(empty, vocabulary).count() == 0
