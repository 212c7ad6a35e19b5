import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadspark.llm import token_alignment as A
from loadspark.llm.bpe_tokens import model_path
from loadspark.llm.queries import QUERIES

tokenizers = pytest.importorskip("tokenizers")
spm = pytest.importorskip("sentencepiece")
BYTE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def files():
    return A.load_files(model_path(BYTE), model_path(PIECE))


@pytest.fixture(scope="module")
def libraries():
    tok = tokenizers.Tokenizer.from_file(model_path(BYTE))
    tok.encode_special_tokens = True
    return tok, spm.SentencePieceProcessor(model_file=model_path(PIECE))


def grouped(text, tok, sp):
    """Groups of one text, token by token."""
    if not text:
        return []
    data, values = (" " + text).encode(), A.byte_values()
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    bytes_a = [bytes(values[c] for c in tok.id_to_token(i)) for i in a]
    bytes_b = [
        bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b
    ]
    if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
        return []
    ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
    common = set(ends_a) & set(ends_b)
    out, ga, j = [], [], 0
    for i, e in zip(a, ends_a, strict=True):
        ga.append(i)
        if e in common:
            k = ends_b.index(e) + 1
            out.append((ga, b[j:k]))
            ga, j = [], k
    return out


def brute(rows, libraries):
    docs = [(key, grouped(text, *libraries)) for key, text in rows]
    holds = Counter()
    for _, groups in docs:
        holds.update({(x, y) for a, b in groups for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for key, groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append(
            (key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
             sum(holds[p] == most[p[0]] for p in links), sum(holds[p] for p in links),
             hashlib.sha256(text.encode()).hexdigest() if groups else "")
        )
    return sorted(out, key=str)


def run(df, files):
    return sorted((tuple(r) for r in A.score(A.align(df, files), *A.sizes(files)).collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    """Ranges, blocks and trees so small that short texts take the way of long ones."""
    for name, value in (("LONG", 300), ("RANGE", 70), ("FAN", 3), ("BLOCK_BYTES", 5000), ("LINKS", 20)):
        monkeypatch.setattr(A, name, value)


def texts_of(rng):
    letters = "abcdefghijklmnopqrstuvwxyz       .,;:'-_\n\tABé漢😀0123456789"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    return made + ["x" * 2000, " " * 500, "漢字" * 300, "ab  cd " * 90, "a" * 333 + " " + "b" * 333, "one ▁ mark " * 80, "<|endoftext|> <s> " * 40]


def test_long_texts_equal_brute_force(frame, files, libraries, small):
    rows = list(enumerate(texts_of(random.Random(2))))
    assert run(frame(rows, "doc_id long, text string"), files) == brute(rows, libraries)


def test_long_text_between_batches_of_a_block(spark, frame, files, libraries, small):
    rows = [(1, "a first short text"), (2, "some longer words " * 40), (3, "a last short text"), (4, "more and more words " * 60), (5, "end")]
    df = frame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert run(df, files) == brute(rows, libraries)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_whole_table(spark, sf, texts, libraries):
    rows = sorted((tuple(r) for r in QUERIES["op13_token_alignment"](spark, sf).collect()), key=str)
    assert rows == brute(texts.items(), libraries)


def test_windows_hold_whole_tokens(files):
    tokens = A.Tokens(files)
    for text in texts_of(random.Random(3)):
        data = b" " + text.encode()
        if "▁" in text:
            continue
        (a,), (b,), _ = tokens.encode([data])
        starts = tokens.starts(a, b)
        seen, used = 0, 0
        for at, stop, first, end in A.windows(data, 50):
            assert at == seen and first <= at < stop <= end
            seen, used = stop, used + end - first
            (x,), (y,), _ = tokens.encode([data[first:end]])
            for whole, part, ids, mine in zip(starts, tokens.starts(x, y), (a, b), (x, y), strict=True):
                inside = (whole >= at) & (whole < stop)
                here = (part + first >= at) & (part + first < stop)
                assert (whole[inside] == part[here] + first).all() and (ids[inside] == mine[here]).all()
        assert seen == len(data) and used <= 4 * len(data) + 200


def test_monoid():
    rng = np.random.default_rng(1)

    def some():
        a, b = (np.cumsum(rng.integers(1, 4, rng.integers(0, 9))) for _ in range(2))
        return A.fragment(a.astype(np.int32), b.astype(np.int32), a, b)

    def same(x, y):
        return all((getattr(x, n) == getattr(y, n)).all() and len(getattr(x, n)) == len(getattr(y, n)) for n in ("a", "b", "of_a", "of_b"))

    for _ in range(200):
        x, y, z = some(), some(), some()
        assert same(x.then(y).then(z), x.then(y.then(z))) and same(A.compose([x, y, z]), x.then(y.then(z)))
        assert same(x.then(A.EMPTY), x) and same(A.EMPTY.then(x), x)


def test_groups(frame, files, libraries):
    rows = list(enumerate(["Hello world, naïve café", "", "unbelievable 漢字"]))
    got = A.groups(A.align(frame(rows, "doc_id long, text string"), files)).collect()
    assert {r["key"]: [(g["a"], g["b"]) for g in r["groups"]] for r in got} == {k: grouped(t, *libraries) for k, t in rows}


def test_odd_rows(odd, empty, files, libraries):
    clash = odd.withColumns({n: F.lit("taken") for n in ("key", "block", "a", "b", "pair", "part", "window")})
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert run(clash, files) == brute(rows, libraries)
    assert run(empty, files) == []
