from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loadspark.llm import mixing as M


def targets(sizes, weights=M.WEIGHTS, most=M.MOST):
    """Water level by plain iteration; sizes in source order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, full = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        rest = sum(w[i] for i in range(len(w)) if i not in full)
        level = left / rest if rest else 0
        over = {i for i in range(len(w)) if i not in full and w[i] * level > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in full else w[i] * level for i in range(len(w))]
        full |= over


@pytest.fixture(scope="module")
def uneven(spark):
    """Sources of very different size, one of them a third of all, one null, one without words."""
    counts = {"a": 5, "b": 300, "B": 40, "ä": 80, None: 60, "empty": 4, "z": 500}
    rows, key = [], 0
    for source, n in counts.items():
        for k in range(n):
            rows.append((key, source, " ".join(["w"] * (0 if source == "empty" else 1 + (key * 7) % 90))))
            key += 1
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_targets_and_pieces(uneven):
    pieces = M.mix(uneven, ["doc_id"], block=16).collect()
    docs = {r["doc_id"]: r for r in uneven.collect()}
    size = {k: len(r["text"].split()) for k, r in docs.items()}
    of = defaultdict(int)
    for k, r in docs.items():
        of[r["source"]] += size[k]
    order = sorted((s for s in of if s is not None), key=lambda s: s.encode()) + [None]
    want = dict(zip(order, targets([of[s] for s in order])))
    taken = Counter()
    for p in pieces:
        assert p["target"] == pytest.approx(want[docs[p["doc_id"]]["source"]])
        assert p["size"] == size[p["doc_id"]] and p["source_size"] == of[docs[p["doc_id"]]["source"]]
        taken[p["doc_id"]] += p["words"]
    assert set(taken) == set(docs)
    assert all(taken[k] <= M.MOST * size[k] for k in docs)
    by_source = Counter()
    for k, n in taken.items():
        by_source[docs[k]["source"]] += n
    for s in order:
        assert abs(by_source[s] - want[s]) <= 4 * 16, s
    # Blocks are equal, and every prefix of the schedule holds each source near its share.
    blocks = Counter()
    for p in pieces:
        if p["slot"] is not None:
            blocks[p["slot"], p["number"]] += p["words"]
    slots = sorted(blocks)
    total = sum(want.values())
    seen = Counter()
    for n, (slot, number) in enumerate(slots, 1):
        seen[number] += 1
        if n % 50 == 0:
            assert all(abs(seen[i] - n * want[s] / total) < 4 for i, s in enumerate(order))
    assert sum(v != 16 for v in blocks.values()) <= len(order)


def test_reruns_agree_and_copies_follow(uneven):
    first = M.take_documents(uneven)
    assert first.columns == uneven.columns
    times = Counter(r["doc_id"] for r in first.collect())
    assert times == Counter(r["doc_id"] for r in M.take_documents(uneven).collect())
    assert max(times.values()) <= M.MOST
    begun = Counter()
    for p in M.mix(uneven, ["doc_id"]).collect():
        begun[p["doc_id"]] += p["slot"] is not None and p["start"] == 0
    # The mix is seeded by all columns there, so compare volumes, not members.
    assert abs(sum(times.values()) - sum(begun.values())) <= 0.05 * sum(begun.values())


def test_odd_rows(odd, empty):
    df = odd.withColumn("size", F.lit("taken")).withColumn("target", F.lit(1)).withColumn("slot", F.lit(1))
    out = M.mix(df, ["doc_id"]).groupBy("number", "rank", "doc_id", "size").agg(F.sum("words").alias("w")).collect()
    assert len(out) == odd.count()
    assert all(r["w"] == 0 for r in out if r["size"] == 0)
    assert M.take_documents(df).columns == df.columns
    assert M.mix(empty, ["doc_id"]).count() == 0 and M.take_documents(empty).count() == 0
    blank = odd.where("doc_id IN (2, 3, 4)")
    assert [r["target"] for r in M.mix(blank, ["doc_id"]).collect()] == [0.0] * 3
