import numpy as np
import pytest

from loadspark.llm import vector_dedup as V


def brute(rows, limit=V.LIMIT):
    """n_links and component per row index."""
    n = len(rows)
    ok = [V._usable(v) and l is not None and i is not None for i, v, l in rows]
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.asarray(rows[a][1], float), np.asarray(rows[b][1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= limit:
                    links[a] += 1
                    links[b] += 1
                    parent[root(a)] = root(b)
    out = []
    for a in range(n):
        ids = [rows[b][0] for b in range(n) if root(b) == root(a)]
        out.append((rows[a][0], links[a], min(ids) if ok[a] else rows[a][0]))
    return sorted(out, key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def found(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in V.linked_vectors(df).collect()), key=str)


def made(seed, n=400, width=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    for i in range(n // 2, n):
        near = base[rng.integers(0, n // 2)]
        base[i] = near + rng.normal(size=width) * rng.choice([0.02, 0.08, 0.2])
    return [(i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3)), "x") for i, v in enumerate(base)]


def test_equals_brute_force(frame):
    rows = made(1)
    got, want = found(frame(rows, SCHEMA)), brute([r[:3] for r in rows])
    links = sum(w[1] for w in want)
    assert links > 50
    assert sum(g[1] for g in got) >= 0.9 * links
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_whole_table_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    want = brute(rows)
    got = found(df)
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_dense_group_is_cut_into_blocks(frame, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=8)
    rows = [(i, [float(x) for x in centre + rng.normal(size=8) * 0.01], 1, "x") for i in range(150)]
    rows += [(1000 + i, rows[0][1], 1, "x") for i in range(40)]
    got = found(frame(rows, SCHEMA))
    assert got == sorted([(r[0], 189, 0) for r in rows], key=str)


def test_odd_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "x"), (3, [1.0, 0.0], None, "x"),
        (4, None, 1, "x"), (5, [], 1, "x"), (6, [0.0, 0.0], 1, "x"), (7, [nan, 1.0], 1, "x"), (8, [inf, 1.0], 1, "x"),
        (9, [1.0, None], 1, "x"), (None, [1.0, 0.0], 1, "x"), (10, [1.0, 0.0, 0.0], 1, "x"), (11, [1.0, 0.0], 2, "x"),
    ]
    got = found(frame(rows, SCHEMA))
    want = [(r[0], 0, r[0]) for r in rows]
    want[0] = want[1] = (1, 2, 1)
    want[2] = (2, 2, 1)
    assert got == sorted(want, key=str)
    assert found(frame([], SCHEMA)) == []
    assert all(r["kept"] for r in V.linked_vectors(frame(rows[3:], SCHEMA)).collect() if r["vec_id"] != 1)


def test_visiting_order_is_the_multi_sequence_order():
    rng = np.random.default_rng(3)
    first, second = rng.random((20, 7)), rng.random((20, 5))
    order = V.visiting_order(first, second, 11)
    for i in range(20):
        cost = (first[i][:, None] + second[i]).ravel()
        assert order[i].tolist() == np.argsort(cost)[:11].tolist()


@pytest.mark.parametrize("recall", [0.5, 0.99])
def test_visits_follow_the_target_recall(recall):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = V.Index(x[:700], 6, 0.98, recall)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.98 * x + np.sqrt(1 - 0.98**2) * side
    order, home = index.cells(x[700:]), index.cells(near[700:])[:, 0]
    assert (order == home[:, None]).any(1).mean() >= recall - 0.06
