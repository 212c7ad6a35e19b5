"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

1. Target: a source's weight share of all words, at most MOST times its own words; the excess goes to the others by
   weight until no target is above that limit.
2. Stream: documents of a source are shuffled by a seeded hash and laid end to end, MOST times over, and the stream is
   cut into blocks of BLOCK words (a block may begin or end inside a document).
3. Schedule: slot j is the golden-ratio point j * 0.618... mod 1, kept exact as an integer on a lattice of 2^31 points. The
   points are mapped through the cumulative targets to sources; the r-th slot of a source takes the r-th block.

Any run of slots holds each source close to its share, and the whole mix meets each target to a few blocks.

Nothing is done source by source: positions in the stream are totals over hash buckets, points and source bounds meet
in cells of the lattice, slots and blocks meet on (source, block). The table of sources stays a Spark table; the driver
sees sums over it only.

Defined results: null and blank texts have size 0 and are taken 0 times; null sources form one source, last in order;
repeated rows are documents of their own; with no words at all every target is 0; an empty table gives no rows. A source
whose target is under 2^-31 of all words gets no slot. Of a text, however long, only its size moves; extra columns are not
returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from loadspark.llm.common import WORD, clean_text, order_shift, seeded_order, seeded_order_sql, totals_before
from loadspark.llm.registry import query, table
from loadspark.session import materialise

SEED = 29
WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
LATTICE_BITS = 31
#: Odd integer next to 2^31 / golden ratio.
GOLDEN = 1327217885
ORDER_BITS = 60


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, int]:
    """One stored row per source: number by code point, words, weight, target; and the words of all sources."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Sorted ranges instead of one sorted task; the range a row fell into is stored with it.
    ranges = materialise(
        sizes.repartitionByRange(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id())
    )
    first = ranges.withColumn("named", F.col("source").isNull().cast("int"))
    numbered = totals_before(first, [], "part", ["named", "source"], {"number": F.lit(1)})
    by_number = F.array(*(F.lit(w) for w in weights))
    table_of = materialise(
        numbered.select(
            "source", "source_size", "number", F.get(by_number, F.col("number") % len(weights)).alias("weight")
        )
    )
    total, weight = table_of.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level = int(total or 0), 0.0
    if total:
        level, before = total / weight, -1.0
        while level != before:
            over = F.col("weight") * F.lit(level) > most * F.col("source_size")
            full, left = table_of.agg(
                F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)),
                F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
            ).first()
            before, level = level, ((total - int(full)) / int(left) if left else level)
    target = F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double"))
    return table_of.withColumn("target", target), total


def schedule(sources: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """The stored schedule: slot, source number, and block, the rank of the slot within its source."""
    spark = sources.sparkSession
    slots = -(-total // block)
    width = 2**LATTICE_BITS
    shift = order_shift(slots, LATTICE_BITS)
    share = F.floor(F.col("target") * (width / total if total else 0.0))
    shares = materialise(sources.select("number", share.alias("share"), (F.col("number") / 4096).cast("int").alias("part")))
    bounds = totals_before(shares, [], "part", ["number"], {"low": F.col("share")}, {"end": "low"})
    high = F.when(F.col("low") + F.col("share") == F.col("end"), F.lit(width)).otherwise(F.col("low") + F.col("share"))
    starts = (
        bounds.where("share > 0")
        .select("number", "low", high.alias("high"))
        .select(
            "number",
            "low",
            F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"),
        )
        .select(
            "cell",
            F.greatest(F.col("low"), F.shiftleft(F.col("cell"), shift)).alias("point"),
            "number",
            F.lit(None).cast("long").alias("slot"),
        )
    )
    point = F.expr(f"((id % {width}) * {GOLDEN}L) % {width}")
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    points = points.select(
        F.shiftright("point", shift).alias("cell"), "point", F.lit(None).cast("long").alias("number"), "slot"
    )
    along = (
        Window.partitionBy("cell")
        .orderBy("point", F.col("slot").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    owned = starts.unionByName(points).withColumn("number", F.last("number", ignorenulls=True).over(along))
    owned = materialise(
        owned.where("slot IS NOT NULL").select(
            "slot", "number", F.shiftright("slot", order_shift(slots, max(slots, 1).bit_length())).alias("part")
        )
    )
    return materialise(totals_before(owned, ["number"], "part", ["slot"], {"block": F.lit(1)}).drop("part"))


def mix(
    df: DataFrame,
    payload: list[str],
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """The pieces of documents the mix takes: one row per piece, and one with null slot for a document not taken.

    Columns: the payload columns, size, source_size, target, number (of the source), rank (in its shuffled order), and
    per piece slot, block, start (words of the document before the piece) and words. Sorted by slot the pieces are the
    mixed stream. `payload` names the columns that travel with a document; the first of them seeds its place.
    """
    rows = materialise(
        df.select(
            *(F.col(f"`{c}`").alias(f"p_{c}") for c in payload),
            F.col(source).alias("source"),
            F.regexp_count(clean_text(text), F.lit(WORD)).cast("long").alias("size"),
            seeded_order(seed, payload[0]).alias("place"),
        )
    )
    sources, total = source_targets(rows, weights, most)
    slots = schedule(sources, total, block)
    taken = slots.groupBy("number").agg(F.count(F.lit(1)).alias("slots"))
    about = materialise(
        sources.join(taken, "number", "left").select(
            F.col("source").alias("its_source"), "source_size", "target", "number",
            F.coalesce("slots", F.lit(0)).alias("slots"),
        )
    )
    shift = order_shift(rows.count(), ORDER_BITS)
    placed = totals_before(
        rows.withColumn("part", F.shiftright("place", shift)),
        ["source"],
        "part",
        ["place", *(f"p_{c}" for c in payload), "size"],
        {"rank": F.lit(1), "before": F.col("size")},
    )
    docs = placed.join(about, placed["source"].eqNullSafe(about["its_source"])).drop("its_source", "source", "part", "place")
    again = [F.col("source_size") * e + F.col("before") for e in range(most)]
    runs = F.array(*(F.struct(F.floor(a / block).alias("first"), a.alias("at")) for a in again))
    runs = F.filter(runs, lambda r: (F.col("size") > 0) & (r["first"] < F.col("slots")))
    blocks = F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                F.sequence(
                    r["first"],
                    F.least(F.floor((r["at"] + F.col("size") - 1) / block), F.col("slots") - 1),
                ),
                lambda b: F.struct(b.alias("block"), r["at"].alias("at")),
            ),
        )
    )
    pieces = docs.select("*", F.explode_outer(blocks).alias("piece")).select(
        *docs.columns, F.col("piece.block").alias("block"), F.col("piece.at").alias("at")
    )
    begin = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    return pieces.join(slots, ["number", "block"], "left").select(
        *(F.col(f"p_{c}").alias(c) for c in payload),
        "size", "source_size", "target", "number", "rank", "slot", "block",
        (begin - F.col("at")).alias("start"),
        F.when(F.col("slot").isNotNull(), end - begin).otherwise(F.lit(0)).cast("long").alias("words"),
    )


def take_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix, whole: each as often as a block the mix takes begins it; columns as given.

    Rows are found again by two 64-bit hashes over all columns, so that texts move once. Rows equal in all columns are
    one row with the sum of their times. Texts without words are not in a mix of words.
    """
    marks = {f"__row_{i}": F.xxhash64(F.lit(i), *(F.col(f"`{c}`") for c in df.columns)) for i in (1, 2)}
    rows = df.withColumns(marks)
    pieces = mix(rows, [key, *marks], text, source)
    times = pieces.where("slot IS NOT NULL AND start = 0").groupBy(*marks).agg(F.count(F.lit(1)).alias("__times"))
    whole = rows.dropDuplicates([*marks]).join(times, [*marks])
    again = whole.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return again.select(*(f"`{c}`" for c in df.columns))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    {seeded_order_sql(SEED, "doc_id")} AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM s
), w AS (
  SELECT *, ([{", ".join(map(str, WEIGHTS))}])[(number % {len(WEIGHTS)}) + 1]::BIGINT AS weight FROM n
), o AS (
  SELECT *, {MOST} * source_size / weight AS ratio, sum({MOST} * source_size) OVER f AS full_below,
    sum(weight) OVER f AS weight_below, (SELECT sum(source_size) FROM w) AS total, (SELECT sum(weight) FROM w) AS weights
  FROM w
  WINDOW f AS (ORDER BY {MOST} * source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lv AS (
  SELECT (total - coalesce(full_below, 0))::DOUBLE / (weights - coalesce(weight_below, 0))::DOUBLE AS level
  FROM o WHERE (total - coalesce(full_below, 0))::DOUBLE / (weights - coalesce(weight_below, 0))::DOUBLE <= ratio
  ORDER BY ratio, number LIMIT 1
), t AS (
  SELECT number, source, source_size, least(weight * (SELECT level FROM lv), ({MOST} * source_size)::DOUBLE) AS target,
    (SELECT sum(source_size) FROM w)::BIGINT AS total
  FROM w
), sh AS (
  SELECT *, floor(target * ({2**LATTICE_BITS}::DOUBLE / total::DOUBLE))::BIGINT AS share FROM t
), lo AS (
  SELECT *, coalesce(sum(share) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low
  FROM sh
), slots AS (
  SELECT ((j % {2**LATTICE_BITS}) * {GOLDEN}) % {2**LATTICE_BITS} AS point
  FROM (SELECT unnest(range(0, (SELECT (max(total) + {BLOCK - 1}) // {BLOCK} FROM lo)::BIGINT)) AS j)
), k AS (
  SELECT number, count(*) AS slots
  FROM slots ASOF JOIN (SELECT number, low FROM lo WHERE share > 0) b ON slots.point >= b.low GROUP BY number
), p AS (
  SELECT d.*, coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d
)
SELECT p.doc_id, p.size, lo.source_size, lo.target,
  ({" + ".join(
    f"greatest(0, least({e} * lo.source_size + before + size, coalesce(k.slots, 0) * {BLOCK}) - ({e} * lo.source_size + before))"
    for e in range(MOST))})::BIGINT AS taken
FROM p JOIN lo ON p.source IS NOT DISTINCT FROM lo.source LEFT JOIN k ON k.number = lo.number
"""


@query("op8_mixing", ORACLE)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, from the schedule's pieces."""
    pieces = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["doc_id"])
    out = pieces.groupBy("number", "rank", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
