"""Exact quantiles of large groups without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loadspark.series import attach_per_key
from loadspark.session import materialise

SKETCH_ACCURACY = 20000
MARGIN = 2 / SKETCH_ACCURACY
#: Counted ranges of one round, and rows between two fences that are sorted in one task.
BINS, FEW = 1024, 1 << 20


def _narrowed(known: DataFrame, fences: DataFrame, by: list[str]) -> DataFrame:
    """Fences around the bin of each wanted rank, at values that occur: one read whatever the number of groups."""
    half = F.col("_high") / 2 - F.col("_low") / 2
    place = F.least(F.floor((F.col("_v") / 2 - F.col("_low") / 2) / half * BINS), F.lit(BINS - 1))
    inside = attach_per_key(known, fences, by, ["_v"]).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
    key = [*by, "_rank", "_all", "_below"]
    bins = inside.groupBy(*key, place.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_inside"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    earlier = W.partitionBy(*by, "_rank").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    before = bins.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_inside").over(earlier), F.lit(0)))
    found = before.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_inside")))
    return found.select(*by, "_rank", "_all", F.col("_before").alias("_below"), "_inside", "_low", "_high")


def group_quantile(df: DataFrame, by: Sequence[str], col: str, q: float = 0.5, out: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile per group, equal to `percentile(col, q)`.

    `percentile` keeps all distinct values of a group in one aggregation state. Here a sketch names two values around the
    wanted ranks; counting the rows below and between them shows whether it was right. The rows between, a few thousandths
    of a percent of the group, are sorted, equal values counted together. Where they are more than FEW, or the sketch missed
    and the whole group is between, rounds of counting narrow the range of each rank first, so no task sorts more. The result is
    exact either way; groups up to some billions of rows take three reads.
    """
    by = list(by)
    v = F.col("_v")
    known = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_v"))
    around = [max(q - MARGIN, 0.0), min(q + MARGIN, 1.0)]
    sketch = known.groupBy(*by).agg(F.percentile_approx("_v", around, SKETCH_ACCURACY).alias("_near"))
    fenced = attach_per_key(known, sketch, by, ["_v"])
    low, high = F.col("_near")[0], F.col("_near")[1]
    counts = fenced.groupBy(*by).agg(
        F.first("_near").alias("_near"),
        F.count_if(v < low).alias("_under"),
        F.count_if((v >= low) & (v <= high)).alias("_between"),
        F.count(F.lit(1)).alias("_all"),
        F.min(v).alias("_least"),
        F.max(v).alias("_most"),
    )
    place = (F.col("_all") - 1) * F.lit(q)
    rank = F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))
    ranks = counts.withColumn("_rank", rank)
    hit = (F.col("_rank") >= F.col("_under")) & (F.col("_rank") < F.col("_under") + F.col("_between"))
    fences = materialise(
        ranks.select(
            *by,
            "_rank",
            "_all",
            F.when(hit, F.col("_under")).otherwise(0).alias("_below"),
            F.when(hit, F.col("_between")).otherwise(F.col("_all")).alias("_inside"),
            F.when(hit, low).otherwise(F.col("_least")).alias("_low"),
            F.when(hit, high).otherwise(F.col("_most")).alias("_high"),
        )
    )
    wide = (F.col("_inside") > FEW) & (F.col("_low") < F.col("_high"))
    while not fences.where(wide).isEmpty():
        narrowed = _narrowed(known, fences.where(wide).drop("_inside"), by)
        fences = materialise(narrowed.unionByName(fences.where(~wide)))
    # All rows between equal fences have their value; of the others the rows are sorted.
    same = fences.where("_low = _high").select(*by, "_rank", "_all", F.col("_low").alias("_at"))
    open_ = fences.where("_low < _high").drop("_inside")
    kept = attach_per_key(known, open_, by, ["_v"]).where((v >= F.col("_low")) & (v <= F.col("_high")))
    values = kept.groupBy(*by, "_rank", "_all", "_below", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*by, "_rank").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = values.withColumn("_end", F.col("_below") + F.sum("_n").over(upto))
    hit_row = (F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n"))
    found = placed.where(hit_row).select(*by, "_rank", "_all", F.col("_v").alias("_at")).unionByName(same)

    def at(fn) -> Column:
        return fn(F.col("_at"), F.col("_rank"))

    ends = found.groupBy(*by, "_all").agg(at(F.min_by).alias("_a"), at(F.max_by).alias("_b"))
    weight = place - F.floor(place)
    return ends.select(*by, (F.col("_a") * (1 - weight) + F.col("_b") * weight).alias(out))
