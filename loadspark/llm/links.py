"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loadspark.session import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """`node`, `component` (the smallest node reachable) of every node that has a link; `links` has a and b of one sortable type.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, over to the smallest node it knows,
    until all nodes hang on the smallest of their component. A node's neighbours are never gathered: its smallest one is
    an aggregate, and handing over is a join, which adaptive execution splits for a hub. Each round is stored, so a
    lost executor costs files to be read again. The number of rounds grows with the logarithm of the longest path.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, before = materialise(pairs), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.hash("u", "v"))).first()
        if now == before:
            break
        before = now
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = state.join(least, F.col("v") == F.col("x")).select("u", F.col("m").alias("v")).distinct()
        large = materialise(large.where("u <> v"))
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(low, F.col("u") == F.col("x"))
        small = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        state = materialise(small.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct())
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
