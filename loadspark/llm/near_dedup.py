"""Near-duplicate documents by b-bit MinHash.

1. Shingles of WORDS words of the lower-cased text become 64-bit hashes; equal sets are one class, known by a digest.
2. A class keeps HASHES minima. Groups of ROWS minima give the band keys; of each minimum only the low BITS bits are kept,
   packed into bit planes (64 bytes at 128 hashes and 4 bits).
3. Classes that share a band key are candidates. Within such a bucket every class is paired with the smallest one; the
   share of equal low bits, corrected for chance collisions, estimates the similarity, and pairs clearly below the
   limit (by MARGIN, over five standard deviations) are left out.
4. What remains is confirmed on the full sets, and confirmed links are joined into components.
5. Confirmed links make components, likely ones make groups of components. In a group of several components, members
   outside the main one are compared with all others, sets against sets, in blocks of BLOCK rows that report links only.
   Pairs that share a bucket but no group are tested one by one. So no link that the bands can see is lost, and a group
   of copies is never listed pair by pair.

At a similarity of exactly 0.8 two classes share no band with a chance of 5e-8 (32 bands of 4); hashes of 64 bits make two
different shingles of one pair equal with a chance of about (words)^2 / 2^64.

Inside a group of copies that no single member links, comparing blocks against blocks takes work in proportion to the square
of the members outside its main component, and so do buckets whose members differ; the output stays small.

Defined results: null, empty and blank texts have an empty set and no links; a text with fewer than WORDS words is one
shingle; a row without a key has no links and no component and is kept; a row is known by its key and text, so different texts
of one key are linked each by itself and only equal or linked ones are dropped; ties go to the smallest key, then to the
smallest digest of the text; copies share their class; long texts are read in pieces; an empty table gives an empty table;
extra columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loadspark.llm.common import clean_text
from loadspark.llm.hashing import BYTE_VALUES, POWER, SEED, mix, seeded
from loadspark.llm.links import connected_components
from loadspark.llm.registry import query, table
from loadspark.session import materialise

HASHES = 128
ROWS = 4
BITS = 4
MARGIN = 0.2
#: Rows of a block, and columns of the matrix that compares two blocks.
BLOCK = 512
COLUMNS = 4096
#: Bytes of a text read at once.
PIECE = 1 << 22


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FACTOR = np.uint64(POWER)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, letters A-Z in lower case; long texts are read in pieces cut at blanks."""
    data = text.encode("utf-8", "replace").translate(LOWER)
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not (data[end] == 32 or 9 <= data[end] <= 13):
            end += 1
        code = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.flatnonzero(~((code == 32) | ((code >= 9) & (code <= 13))))
        if len(inside):
            starts = np.flatnonzero(np.diff(inside, prepend=-2) != 1)
            lengths = np.diff(starts, append=len(inside))
            place = np.arange(len(inside)) - np.repeat(starts, lengths)
            # Every byte at every place has a value of its own, so structured words do not cancel out.
            values = mix(BYTE_VALUES[code[inside]] + place.astype(np.uint64) * FACTOR)
            found.append(mix(np.add.reduceat(values, starts, dtype=np.uint64) + lengths.astype(np.uint64)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words; fewer words are one run."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, np.uint64(n))
    for i in range(n):
        h = mix(h * FACTOR + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """Smallest value of each of n seeded hash functions over a set."""
    factors, shifts = seeded(n, SEED + 1) | np.uint64(1), seeded(n, SEED + 2)
    out = np.full(n, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 1024):
        values = hashes[i : i + 1024, None] * factors + shifts
        values ^= values >> np.uint64(32)
        np.minimum(out, values.min(axis=0), out=out)
    return out


def band_keys(mins: np.ndarray, rows: int) -> np.ndarray:
    groups = mins.reshape(-1, rows)
    h = np.arange(len(groups), dtype=np.uint64)
    for i in range(rows):
        h = mix(h * FACTOR + groups[:, i])
    return h.view(np.int64)


def packed_bits(mins: np.ndarray, bits: int) -> np.ndarray:
    """Low bits as planes: all lowest bits first, 64 to a value."""
    planes = [np.packbits(((mins >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for b in range(bits)]
    return np.concatenate(planes)


def _signatures(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, own, text in zip(pdf["key"], pdf["own"], pdf["text"], strict=True):
                s = shingle_set(text, words)
                if len(s):
                    m = minima(s, HASHES)
                    rows.append((key, own, len(s), hashlib.md5(s.tobytes()).digest(), band_keys(m, ROWS), packed_bits(m, BITS)))
                else:
                    rows.append((key, own, 0, None, None, None))
            yield pd.DataFrame(rows, columns=["key", "own", "n_shingles", "digest", "bands", "bits"]).astype({"key": "Int64"})

    return run


def _sets(words: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["own"], "hashes": sets})

    return run


def estimated_similarity(a: str, b: str) -> Column:
    """Similarity from two packed signatures: share of equal low bits, less the share that is equal by chance."""
    values = HASHES // 64
    differ = F.lit(0)
    for v in range(values):
        any_bit = F.lit(0).cast("long")
        for plane in range(BITS):
            i = plane * values + v
            any_bit = any_bit.bitwiseOR(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
        differ = differ + F.bit_count(any_bit)
    chance = 0.5**BITS
    return ((HASHES - differ) / F.lit(float(HASHES)) - chance) / (1 - chance)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures do not rule the limit out."""
    bits = classes.select("node", "bits")
    both = pairs.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("bits_a")), "a")
    both = both.join(bits.select(F.col("node").alias("b"), F.col("bits").alias("bits_b")), "b")
    return both.where(estimated_similarity("bits_a", "bits_b") >= percent / 100 - MARGIN).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the limit."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - common
    return both.where(100 * common >= percent * either).select("a", "b")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as products of incidence matrices over the hashes both hold."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def places(flat: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(shared, flat)
        held = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == flat)
        order = np.argsort(at[held], kind="stable")
        return at[held][order], owner[held][order]

    if len(shared):
        (at_a, of_a), (at_b, of_b) = places(flat_a, a), places(flat_b, b)
        for first in range(0, len(shared), COLUMNS):
            sides = []
            for at, of, n in ((at_a, of_a, len(a)), (at_b, of_b, len(b))):
                lo, hi = np.searchsorted(at, (first, first + COLUMNS))
                m = np.zeros((n, COLUMNS), np.float32)
                m[of[lo:hi], at[lo:hi] - first] = 1
                sides.append(m)
            out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _block_links(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Confirmed links between the two sides of each group, one to each component a member reaches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in pdf.groupby("g", sort=False):
            left, right = group[group["outside"]], group[~group["outside"]]
            if not len(left) or not len(right):
                continue
            sets_l, sets_r = list(left["hashes"]), list(right["hashes"])
            common = _common(sets_l, sets_r)
            sizes_l, sizes_r = np.array([len(x) for x in sets_l]), np.array([len(x) for x in sets_r])
            near = 100 * common >= percent * (sizes_l[:, None] + sizes_r - common)
            near &= left["c"].to_numpy()[:, None] != right["c"].to_numpy()
            i, j = np.nonzero(near)
            pairs = pd.DataFrame(
                {"a": left["node"].to_numpy()[i], "b": right["node"].to_numpy()[j], "c": right["c"].to_numpy()[j]}
            )
            found.append(pairs.drop_duplicates(["a", "c"])[["a", "b"]])
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}, dtype="object")

    return run


def links_in_groups(labelled: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across the components `c` of each group `g`; pairs of two members are known already."""
    parts = labelled.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("g").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members"), F.max(F.struct("n", "c")).alias("m")
    )
    groups = groups.where("parts > 1 AND members > 2").select(
        F.col("g").alias("of"),
        F.col("m.c").alias("main"),
        F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("members") - F.col("m.n")) / BLOCK).cast("int").alias("out_blocks"),
    )
    rows = materialise(labelled.join(groups, F.col("g") == F.col("of")).drop("of"))
    small = (F.col("blocks") == 1) & (F.col("out_blocks") == 1)
    # Groups of one block share a task, as many as make up about a block.
    packs = max(1, rows.where(small).count() // BLOCK)

    def side(part: DataFrame, mine: str, theirs: str, outside: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("node"), F.col(mine)).cast("int")
        cut = part.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias("other"))
        # Larger groups have a task for each pair of blocks.
        return cut.select(
            F.when(small, F.pmod(F.xxhash64("g"), F.lit(packs)).cast("string").cast("binary")).otherwise(F.col("g")).alias("pack"),
            small.alias("small"),
            F.col("own" if outside else "other").alias("x"),
            F.col("other" if outside else "own").alias("y"),
            "g", "c", "node", F.lit(outside).alias("outside"),
        )

    both = side(rows.where("c <> main"), "out_blocks", "blocks", True).unionByName(
        side(rows, "blocks", "out_blocks", False)
    )
    both = both.join(sets.withColumnRenamed("node", "n"), F.col("node") == F.col("n")).drop("n")
    return both.groupBy("pack", "small", "x", "y").applyInPandas(_block_links(percent), "a binary, b binary")


def _own(key: str, text: str) -> Column:
    """What tells a row: its key, then the digest of its text, in bytes that sort in this order; null without a key."""
    flipped = F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    return F.concat(F.unhex(F.lpad(F.hex(flipped), 16, "0")), F.unhex(F.md5(clean_text(text).cast("binary"))))


def _key_of(own: str) -> Column:
    flipped = F.conv(F.hex(F.substring(own, 1, 8)), 16, -10).cast("long")
    return flipped.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _labelled(df: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """key, own, n_shingles and component (the smallest `own` linked; null without a set or key) of every row."""
    texts = df.select(F.col(key).cast("long").alias("key"), _own(key, text).alias("own"), clean_text(text).alias("text"))
    docs = materialise(
        texts.mapInPandas(
            _signatures(words),
            "key long, own binary, n_shingles long, digest binary, bands array<long>, bits array<long>",
        )
    )
    linked = docs.where("digest IS NOT NULL AND key IS NOT NULL")
    classes = materialise(
        linked.groupBy("digest")
        .agg(F.min("own").alias("node"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    )
    members = classes.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    shared = materialise(members.join(buckets.drop("last"), "band"))
    stars = materialise(
        likely(shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(),
               classes, percent)
    )
    wanted = shared.select("node").distinct()
    sets = materialise(
        texts.join(wanted, F.col("own") == F.col("node"))
        .select("own", "text")
        .dropDuplicates(["own"])
        .mapInPandas(_sets(words), "node binary, hashes array<long>")
    )
    links = materialise(confirmed(stars, sets, percent))
    found = materialise(connected_components(links))
    groups = connected_components(stars).select(F.col("node").alias("gn"), F.col("component").alias("group"))
    labelled = materialise(
        wanted.select("node")
        .join(found.select(F.col("node").alias("n"), "component"), F.col("node") == F.col("n"), "left")
        .join(groups, F.col("node") == F.col("gn"), "left")
        .select("node", F.coalesce("group", "node").alias("g"), F.coalesce("component", "node").alias("c"))
    )
    inside = links_in_groups(labelled, sets, percent)
    # Members of a bucket outside the group of its first class, against all others of other groups.
    of_first = labelled.select(F.col("node").alias("first"), F.col("g").alias("main"))
    placed = shared.join(labelled.drop("c"), "node").join(of_first, "first").select("band", "node", "g", "main")
    open_bands = placed.where("g <> main").select("band").distinct()
    placed = placed.join(open_bands, "band", "left_semi").join(classes.select("node", "bits"), "node")
    placed = materialise(placed)
    away = placed.where("g <> main").drop("main")
    others = placed.select(
        "band", F.col("node").alias("other"), F.col("g").alias("its"), "main", F.col("bits").alias("its_bits")
    )
    # The estimate is part of the join, so that ruled-out pairs are never rows.
    across = (away["band"] == others["band"]) & (F.col("g") != F.col("its"))
    across = across & ((F.col("its") == F.col("main")) | (F.col("node") < F.col("other")))
    across = across & (estimated_similarity("bits", "its_bits") >= percent / 100 - MARGIN)
    rest = (
        away.join(others, across)
        .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        .distinct()
    )
    more = materialise(inside.unionByName(confirmed(rest, sets, percent)))
    if more.limit(1).count():
        tied = found.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
        found = connected_components(tied.unionByName(more))
    of_class = classes.select("digest", "node").join(
        found.select(F.col("node").alias("n"), "component"), F.col("node") == F.col("n"), "left"
    )
    of_class = of_class.select(F.col("digest").alias("d"), F.coalesce("component", "node").alias("component"))
    alone = docs.where("digest IS NULL OR key IS NULL").select("key", "own", "n_shingles", F.lit(None).cast("binary").alias("component"))
    rows = linked.join(of_class, F.col("digest") == F.col("d")).select("key", "own", "n_shingles", "component")
    return rows.unionByName(alone)


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """`key`, n_shingles, component_id, kept for every row: components of similarity >= percent / 100."""
    rows = _labelled(df, key, text, words, percent).withColumn("component_id", F.coalesce(_key_of("component"), "key"))
    return rows.select(
        F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """The rows with one document of each component, the one with the smallest key; rows without a key stay."""
    gone = _labelled(df, key, text, words, percent).where("own <> component").select(F.col("own").alias("__gone")).distinct()
    rows = df.withColumn("__own", _own(key, text))
    left = rows.where("__own IS NOT NULL").join(gone, F.col("__own") == F.col("__gone"), "left_anti")
    return left.dropDuplicates(["__own"]).unionByName(rows.where("__own IS NULL")).drop("__own")


@query("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on two-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, words=2)
