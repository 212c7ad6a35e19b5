"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; a row of rank r among n gets the fraction (r + u) / n, where
u in [0, 1) is fixed for the source. Sorted by that fraction all sources run evenly side by side, so cutting the order
into equal runs gives every shard the mixture of the whole: of each source it holds n / shards rows, to within one or two while
sources are few. Sources of a few rows lie at random places, so very many of them move the cuts by about the square root of
their rows in a shard.

Law `rows`: shard sizes differ by at most one row. Neither rank nor order is taken in one task: rows are sorted inside
buckets of the hash (of the fraction) and shifted by the counts of the buckets before.

Defined results: null and empty texts have size 8 and checksum 0; null sources form one source; repeated rows are ranked
one after the other; rows equal in id, size and checksum are interchangeable; an empty table gives no rows; of a text, however
long, only size and checksum move; extra columns are not returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadspark.llm.common import clean_text, order_shift, seeded_order, seeded_order_sql, totals_before
from loadspark.llm.registry import query, table
from loadspark.session import materialise

SHARDS = 24
SEED = 17
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
ORDER_BITS = 60
FRACTION_BITS = 52


def byte_size(text: str) -> Column:
    return (F.octet_length(clean_text(text)) + ROW_BYTES).cast("long")


def start_of_source(seed: int, source: str) -> Column:
    """u of a source: 32 bits of its md5 as a fraction."""
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("double") / 2.0**32


def interleave(
    df: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Key, size, text_crc32, source, fraction, shard and slot of every row (texts themselves do not move)."""
    rows = materialise(
        df.select(
            F.col(key).alias("key"),
            F.col(source).alias("source"),
            byte_size(text).alias("size"),
            F.crc32(clean_text(text)).alias("text_crc32"),
            seeded_order(seed, key).alias("place"),
            start_of_source(seed, source).alias("u"),
        )
    )
    n = rows.count()
    bucketed = rows.withColumn("part", F.shiftright("place", order_shift(n, ORDER_BITS)))
    ranked = totals_before(
        bucketed, ["source"], "part", ["place", "key", "size", "text_crc32"], {"rank": F.lit(1)}, {"of": "rank"}
    )
    fraction = (F.col("rank") + F.col("u")) / F.col("of")
    cut = FRACTION_BITS - order_shift(n, FRACTION_BITS)
    placed = materialise(
        ranked.select(
            "key", "source", "size", "text_crc32", "place", fraction.alias("fraction"),
            F.floor(fraction * 2.0**cut).alias("part"),
        )
    )
    order = ["fraction", "source", "place", "key", "size", "text_crc32"]
    numbered = totals_before(placed, [], "part", order, {"at": F.lit(1)})
    shard = F.expr(f"(at * {shards}) div {max(n, 1)}")
    return numbered.select("key", "source", "size", "text_crc32", "fraction", "at", shard.alias("shard")).select(
        "key", "source", "size", "text_crc32", "fraction", F.col("shard").cast("int").alias("shard"),
        F.expr(f"at - (shard * {n} + {shards - 1}) div {shards}").alias("slot"),
    )


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        for _ in range(8):
            b = (b >> 1) ^ (0xEDB88320 * (b & 1))
        out.append(b)
    return out


_NAME_SQL = "coalesce('s' || source, 'null')"
ORACLE = f"""
WITH b AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {seeded_order_sql(SEED, "doc_id")} AS place,
    ('0x' || substr(md5('{SEED}:' || {_NAME_SQL}), 1, 8))::BIGINT::DOUBLE / {2.0**32!r}::DOUBLE AS u
  FROM documents
), x AS (
  SELECT *, hex(encode(t)) AS hx, strlen(t) AS bytes FROM b
), c AS (
  SELECT doc_id, source, place, u, (bytes + {ROW_BYTES})::BIGINT AS size,
    xor(list_reduce(list_transform(range(0, bytes), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT),
      lambda crc, byte: xor(crc >> 8, {_crc_table()}[(xor(crc, byte) & 255) + 1]), 4294967295::BIGINT),
      4294967295::BIGINT)::BIGINT AS text_crc32
  FROM x
), r AS (
  SELECT *, ((row_number() OVER (PARTITION BY source ORDER BY place, doc_id, size, text_crc32) - 1) + u)
    / (count(*) OVER (PARTITION BY source)) AS fraction
  FROM c
), g AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, place, doc_id, size, text_crc32) - 1 AS pos,
    count(*) OVER () AS n
  FROM r
), s AS (SELECT *, (pos * {SHARDS}) // n AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard,
  (pos - (shard * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM s
"""


@query("op5_sharding", ORACLE)
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law of equal row counts."""
    out = interleave(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select(
        F.col("key").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
