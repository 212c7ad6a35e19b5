"""Vector code compression by product quantisation on per-dimension value dictionaries.

Components become integers, floor(SCALE * x), and vectors are cut into PARTS equal parts. Each part position has a codebook
of ENTRIES entries that ROUNDS rounds of assigning and averaging refine, in integers throughout.

Rows are packed into blocks of at most BLOCK_CELLS components. A block keeps, per dimension, the dictionary of its distinct
integers and one small code per row. A round tabulates the squared difference of every distinct integer to that component
of all entries; the distance of a part to an entry is then a gather of table rows by code, added over the part's
dimensions. Sums of the assigned parts come from counts of (entry, code) against the same dictionary. So no component is
subtracted or squared twice in a block, and a dictionary never grows beyond its block.

Per round a task hands over one sum and count per entry and component; the codebooks (ENTRIES x width integers) are all that
the driver sees or sends. Blocks are stored, so that a round reads codes, not vectors.

Defined results: a vector that is null, empty or holds null or non-finite components is left out; so is one whose length is
not that of the usable vector with the smallest (id, vector), or whose length PARTS does not divide, or which holds an
integer beyond MOST, as its error would not fit a long. With fewer than ENTRIES vectors the codebooks have as many entries as
there are vectors. Rows of one id, null ids (last in order) and null labels (one label) are rows as others; an empty table gives
no rows; extra columns are not returned, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loadspark.llm.registry import query, table
from loadspark.session import materialise

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Components of a block; its rows stay below 65,536 so that a code takes two bytes.
BLOCK_CELLS = 1 << 21
BLOCK_ROWS = 1 << 15
MOST = 1 << 26
#: Groups that the rows of one label are spread over when its error is attached.
SPREAD = 32


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position within the part."""

    entries: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label and integer vector `v` of every row that takes part."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda e: F.floor(e * SCALE))
    raw = F.col(vector)
    fine = F.forall(raw, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * SCALE) <= MOST))
    rows = df.select(
        F.col(key).alias("key"), F.col(label).alias("label"), F.when(fine, x).alias("v")
    ).where((F.size("v") > 0) & (F.size("v") % PARTS == 0))
    return rows


def _packed(width: int):
    """Rows to blocks: ids, labels, per dimension the distinct integers, and per row and dimension a code."""
    rows_of = max(1, min(BLOCK_ROWS, BLOCK_CELLS // width))

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        flat = pa.concat_arrays([c for c in whole.column("v").chunks]).flatten().to_numpy()
        cells = flat.reshape(-1, width)
        words, codes = zip(*(np.unique(cells[:, d], return_inverse=True) for d in range(width)), strict=True)
        sizes = np.array([len(w) for w in words], np.int32)
        codes = np.stack([c.ravel() for c in codes]).astype("<u2")
        single = lambda values, kind: pa.ListArray.from_arrays([0, len(values)], values.cast(kind))
        key, label = (pa.concat_arrays(whole.column(c).chunks) for c in ("key", "label"))
        return pa.RecordBatch.from_arrays(
            [
                single(key, key.type),
                single(label, label.type),
                single(pa.array(sizes), pa.int32()),
                single(pa.array(np.concatenate(words).astype(np.int64)), pa.int64()),
                pa.array([codes.tobytes()], pa.binary()),
            ],
            names=["keys", "labels", "sizes", "words", "codes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows_of - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == rows_of:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return run


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Row number, dictionaries and codes (dimension by row) of each block."""
    for i in range(batch.num_rows):
        sizes = batch.column("sizes")[i].values.to_numpy()
        words = np.split(batch.column("words")[i].values.to_numpy(), np.cumsum(sizes)[:-1])
        codes = np.frombuffer(batch.column("codes")[i].as_buffer(), "<u2").reshape(len(sizes), -1)
        yield i, words, codes


def nearest(words: list[np.ndarray], codes: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its distance, by part and row; the lower index on ties."""
    parts, _, deep = entries.shape
    rows = codes.shape[1]
    which, far = np.empty((parts, rows), np.uint8), np.empty((parts, rows), np.int64)
    for p in range(parts):
        total = np.zeros((rows, entries.shape[1]), np.int64)
        for k in range(deep):
            d = p * deep + k
            squares = (words[d][:, None] - entries[p, :, k][None, :]) ** 2
            total += squares[codes[d]]
        which[p] = total.argmin(1)
        far[p] = total[np.arange(rows), which[p]]
    return which, far


def _sums(entries: np.ndarray):
    """One row per part, entry and position of a task: sum and count of the components assigned."""
    parts, k, deep = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, deep), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for _, words, codes in _read(batch):
                which, _ = nearest(words, codes, entries)
                for p in range(parts):
                    counts[p] += np.bincount(which[p], minlength=k)
                    for j in range(deep):
                        d = p * deep + j
                        n = len(words[d])
                        met = np.bincount(which[p].astype(np.int64) * n + codes[d], minlength=k * n).reshape(k, n)
                        sums[p, :, j] += met @ words[d]
        if counts.any():
            at = np.arange(parts * k * deep, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(sums.ravel()), pa.array(np.repeat(counts.ravel(), deep))], names=["at", "s", "n"]
            )

    return run


def _assigned(entries: np.ndarray):
    """key, label, code and error of every row of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, words, codes in _read(batch):
                which, far = nearest(words, codes, entries)
                text = np.ascontiguousarray(which.T).tobytes().hex()
                step = 2 * len(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("keys")[i].values,
                        batch.column("labels")[i].values,
                        pa.array([text[a : a + step] for a in range(0, len(text), step)]),
                        pa.array(far.sum(0)),
                    ],
                    names=["key", "label", "code", "error"],
                )

    return run


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks | None]:
    """key, label, code (two hex digits a part) and error of every usable vector, and the codebooks (None without rows)."""
    rows = usable(df, key, vector, label)
    kinds = f"key {rows.schema['key'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}"
    first = rows.orderBy(F.col("key").asc_nulls_last(), "v").limit(1).select(F.size("v")).collect()
    if not first:
        return df.sparkSession.createDataFrame([], f"{kinds}, code string, error long"), None
    width = first[0][0]
    rows = rows.where(F.size("v") == width)
    start = rows.orderBy(F.col("key").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    entries = np.array([r[0] for r in start], np.int64).reshape(len(start), PARTS, -1).transpose(1, 0, 2)
    lists = T.StructType(
        [
            T.StructField("keys", T.ArrayType(rows.schema["key"].dataType)),
            T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)),
            T.StructField("sizes", T.ArrayType(T.IntegerType())),
            T.StructField("words", T.ArrayType(T.LongType())),
            T.StructField("codes", T.BinaryType()),
        ]
    )
    blocks = materialise(rows.mapInArrow(_packed(width), lists))
    for _ in range(rounds):
        sums = blocks.select("sizes", "words", "codes").mapInArrow(_sums(entries), "at int, s long, n long")
        found = {r["at"]: r for r in sums.groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
        flat = entries.ravel().tolist()
        entries = np.array(
            [r["s"] // r["n"] if (r := found.get(i)) and r["n"] else old for i, old in enumerate(flat)], np.int64
        ).reshape(entries.shape)
    out = blocks.mapInArrow(_assigned(entries), f"{kinds}, code string, error long")
    return out, Codebooks(entries)


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add the error summed over rows of equal label, nulls together.

    Errors are summed before they move, and the rows of a label meet its sum in SPREAD groups.
    """
    slot = F.pmod(F.xxhash64("key", "code"), F.lit(SPREAD)).cast("int")
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    sums = sums.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    on = F.col("label").eqNullSafe(F.col("__label")) & (F.col("__slot") == F.col("__at"))
    return coded.withColumn("__slot", slot).join(sums, on).drop("__slot", "__at", "__label")


def _oracle() -> str:
    """The same rounds in SQL: all part-to-entry distances by joining components, one pair of tables a round."""
    steps = [
        f"""raw AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(e::DOUBLE * {SCALE})::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0)""",
        f"""cells AS MATERIALIZED (SELECT vec_id, label, d // (len(v) // {PARTS}) AS part, d % (len(v) // {PARTS}) AS pos, v[d + 1] AS x
  FROM (SELECT vec_id, label, v, unnest(range(len(v))) AS d FROM raw))""",
        f"""book0 AS MATERIALIZED (SELECT part, entry, pos, x AS e FROM cells JOIN
  (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM raw QUALIFY entry < {ENTRIES}) USING (vec_id))""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (SELECT vec_id, part, entry, dist FROM
  (SELECT vec_id, part, entry, sum((x - e) * (x - e))::BIGINT AS dist FROM cells JOIN book{r} USING (part, pos) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) = 1)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""book{r + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m, e) AS e FROM book{r} LEFT JOIN
  (SELECT part, entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m FROM cells JOIN near{r} USING (vec_id, part) GROUP BY ALL)
  USING (part, entry, pos))"""
            )
    steps.append(
        f"""coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error
  FROM near{ROUNDS} GROUP BY vec_id)"""
    )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(e::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN raw USING (vec_id)"""


@query("op12_vector_codes", _oracle())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every usable vector, its label's error, and the digest of the codebooks."""
    coded, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    out = with_label_error(coded)
    digest = F.lit(None).cast("string") if books is None else F.lit(books.digest)
    return out.select(F.col("key").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))
