import hashlib
import math

import numpy as np
import pytest

from loadspark.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, key string, code string, error long, label_error long"


def brute(rows, rounds=V.ROUNDS):
    """Plain loops over all rows, parts and entries."""
    vectors = [[math.floor(V.SCALE * x) for x in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, vectors[i]))
    deep = len(vectors[0]) // V.PARTS
    parts = [[v[p * deep : (p + 1) * deep] for v in vectors] for p in range(V.PARTS)]
    books = [[list(parts[p][i]) for i in order[: V.ENTRIES]] for p in range(V.PARTS)]

    def near(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(V.PARTS):
            mine = [near(x, books[p])[0] for x in parts[p]]
            for e in range(len(books[p])):
                held = [parts[p][i] for i, m in enumerate(mine) if m == e]
                if held:
                    books[p][e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    found = [[near(parts[p][i], books[p]) for p in range(V.PARTS)] for i in range(len(rows))]
    code = ["".join(f"{e:02x}" for e, _ in f) for f in found]
    error = [sum(d for _, d in f) for f in found]
    total = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(r[0]), c, e, total[r[2]]) for r, c, e in zip(rows, code, error, strict=True)), digest


def got(frame, rows):
    wide = [(*r, "clash", "clash", -1, -1) for r in rows]
    coded, books = V.compress(frame(wide, SCHEMA))
    out = V.with_label_error(coded).collect()
    return sorted((str(r["key"]), r["code"], r["error"], r["label_error"]) for r in out), books


@pytest.mark.parametrize("cells", [V.BLOCK_CELLS, 16 * 7])
def test_equals_brute_force(frame, monkeypatch, cells):
    monkeypatch.setattr(V, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(5)
    # Half the labels are one hot label; coarse values make ties.
    rows = [
        (int(i), [float(x) for x in np.float32(rng.integers(-9, 9, 16) / 16)], None if i % 7 == 0 else int(i % 2 and i % 5))
        for i in rng.permutation(300)
    ]
    rows += rows[:9]
    want, digest = brute(rows)
    found, books = got(frame, rows)
    assert found == want and books.digest == digest


def test_floors_go_down(frame):
    rows = [(i, [-0.3 / (i + 1)] * 8, 0) for i in range(40)]
    want, digest = brute([(i, [float(np.float32(x)) for x in v], l) for i, v, l in rows])
    found, books = got(frame, rows)
    assert found == want and books.digest == digest


def test_odd_rows(frame):
    fine = [(3, [0.5] * 8, 1), (3, [0.5] * 8, 1), (1, [0.25] * 8, None), (None, [0.75] * 8, None)]
    odd = [
        (0, None, 1), (4, [], 1), (5, [0.1] * 7 + [None], 1), (6, [0.1] * 7 + [float("nan")], 1),
        (7, [0.1] * 7 + [float("inf")], 1), (8, [0.1] * 16, 1), (9, [0.1] * 9, 1), (10, [3e38] * 8, 1),
    ]
    want, digest = brute(fine)
    found, books = got(frame, fine + odd)
    assert found == want and books.digest == digest


def test_empty_table(frame):
    assert got(frame, []) == ([], None)


def test_no_rows_in_the_query(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = V.op12_vector_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
