from collections import Counter

from pyspark.sql import functions as F

from loadspark.llm import sharding as S


def test_shards_hold_the_mixture(documents):
    rows = S.interleave(documents, shards=4).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    by_source, both = Counter(r["source"] for r in rows), Counter((r["shard"], r["source"]) for r in rows)
    for s, n in by_source.items():
        assert all(abs(both[k, s] - n / 4) < 2 for k in range(4))
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))


def test_hot_source_is_dealt_over_buckets(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 700)).alias("source"),
        F.lit("x").alias("text"),
    )
    rows = S.interleave(df, shards=24).collect()
    hot = Counter(r["shard"] for r in rows if r["source"] == "hot")
    assert len(rows) == 6000 and Counter(Counter(r["shard"] for r in rows).values()) == {250: 24}
    # Sources of a few rows are spread too, at random places, not all put at one end.
    rare = Counter(r["shard"] for r in rows if r["source"] != "hot")
    assert all(abs(n - 4000 / 24) < 3 * (4000 / 24) ** 0.5 for n in rare.values())
    assert all(abs(n - 2000 / 24) < 3 * (4000 / 24) ** 0.5 for n in hot.values())


def test_order_within_a_source_is_shuffled_and_repeatable(documents):
    first = S.interleave(documents).select("key", "shard", "slot").collect()
    assert sorted(first) == sorted(S.interleave(documents).select("key", "shard", "slot").collect())
    other = S.interleave(documents, seed=99).select("key", "shard", "slot").collect()
    assert sorted(first) != sorted(other)


def test_odd_rows(odd, empty):
    df = odd.withColumn("size", F.lit("taken")).withColumn("shard", F.lit(9)).withColumn("slot", F.lit(9))
    rows = S.interleave(df).collect()
    assert len(rows) == odd.count()
    by_key = {r["key"]: r for r in rows}
    assert by_key[2]["size"] == by_key[3]["size"] == 8 and by_key[2]["text_crc32"] == 0
    assert sorted(r["shard"] for r in rows) == sorted({r["shard"] for r in rows})
    assert S.interleave(empty).count() == 0
