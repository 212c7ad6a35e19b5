"""Removal of repeated byte strings, a sample of places standing for all suffixes.

A string of LENGTH bytes is repeated if it starts at two places of the corpus. Sorting all suffixes to depth LENGTH would
answer that for every place, but needs a row per byte. As in a difference cover, a sample of places is enough if any two
equal strings hold sampled places at the same distance. What follows is grouping by hashes, though, not sorting by ranks:

1. Sample: of the TUPLE-byte strings inside a window of LENGTH bytes the one with the smallest hash, leftmost on ties, is
   sampled. It depends on content and not on a remainder, so about one place in 140 is enough instead of two in three.
2. Names: sampled tuples are grouped by hash. A name found once ends the matter for all windows that lead to it.
3. Runs: all windows that lead to a sampled place form one run of bytes, which is named by hash in turn, once and not
   recursively. A run found twice is repeated as a whole. One example of every other run goes on, and only in names that
   have several runs.
4. Windows: those of one name are keyed by the hash of the whole window, and equal ones are repeated. Names are dealt over
   groups of about GROUP_RUNS runs; a name with more than MOST_RUNS runs is instead compared window by window over all tasks.

The order of unequal suffixes is not needed for that and not computed: no ranks, no recursion on names, no merge of sorted
suffixes. Sampling two places in three by remainder would shuffle a row for two thirds of all bytes on each level.

Covered bytes are then cut out of the texts. Copies of a text share their rows: texts are known by their md5.

Equality is by hashes over two prime fields, 62 bits for the name and 62 for the window or run: two different windows of
one name are taken for equal with a chance of about 2^-62 a pair.

Defined results: a null text counts as empty; texts under LENGTH bytes are kept whole; a text repeats itself too, overlaps
included; kept bytes need not be valid UTF-8; long texts are read in pieces of PIECE windows; repeated rows are copies; an
empty table gives no rows; extra columns are not returned, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loadspark.llm.common import clean_text
from loadspark.llm.hashing import Substrings, mix
from loadspark.llm.registry import query, table
from loadspark.session import materialise

LENGTH = 400
TUPLE = 128
#: Windows read at once; their places fit PLACE_BITS.
PIECE = 1 << 19
PLACE_BITS = 20
GROUP_RUNS = 2000
MOST_RUNS = 4096


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each run of `width` values, by running minima inside blocks from both sides."""
    n = len(values)
    filled = np.full(n + (-n % width), np.iinfo(values.dtype).max, values.dtype)
    filled[:n] = values
    blocks = filled.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def sampled(data: bytes, hashes: Substrings, length: int, size: int) -> tuple[np.ndarray, ...]:
    """name, run, first window, last window of every sampled place of a text."""
    found = []
    for begin in range(0, len(data) - length + 1, PIECE):
        part = np.frombuffer(data, np.uint8, min(len(data) - begin, PIECE + length - 1), begin)
        hashes.read(part)
        names = hashes.all(size)
        place = np.arange(len(names), dtype=np.uint64)
        low = np.uint64((1 << PLACE_BITS) - 1)
        least = window_minima((names & ~low) | place, length - size + 1)
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        place = place[first]
        whole = hashes.at(first, last + length)
        run = mix(mix(whole + (place - first).astype(np.uint64)) + (last - first).astype(np.uint64))
        found.append((names[place], run, first + begin, last + begin))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _samples(length: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Substrings(PIECE + length)
        for batch in batches:
            rows, parts = [], []
            for i, data in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                if len(data) >= length:
                    part = sampled(data, hashes, length, size)
                    parts.append(part)
                    rows.append(np.full(len(part[0]), i))
            if not rows:
                continue
            take = pa.array(np.concatenate(rows))
            name, run_, first, last = (np.concatenate(x).view(np.int64) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(take), batch.column("digest").take(take), pa.array(name), pa.array(run_),
                 pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                names=["key", "digest", "name", "run", "first", "last"],
            )

    return run


def _contexts(length: int):
    """Texts with the runs wanted from them, to the bytes of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                out += [(r["name"], r["run"], r["times"], data[r["first"] : r["last"] + length]) for r in runs]
            name, run_, times, data = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(name, pa.int64()), pa.array(run_, pa.int64()), pa.array(times, pa.int64()), pa.array(data, pa.binary())],
                names=["name", "run", "times", "bytes"],
            )

    return run


def _window_hashes(pieces: list[bytes], hashes: dict[int, Substrings], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of every piece, and the piece it is in."""
    longest = max(map(len, pieces))
    room = 1 << max(12, longest.bit_length())
    if room not in hashes:
        hashes[room] = Substrings(room)
    values = [hashes[room].read(np.frombuffer(p, np.uint8)).all(length) for p in pieces]
    return np.concatenate(values), np.repeat(np.arange(len(pieces)), [len(v) for v in values])


def _ranges(covered: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> pd.DataFrame:
    """Runs of covered windows: piece, first and last window in it."""
    edge = np.diff(covered.astype(np.int8), prepend=0) != 0
    edge[1:] |= owner[1:] != owner[:-1]
    start = np.flatnonzero(edge & covered)
    stop = np.flatnonzero(np.append((edge[1:] | ~covered[1:]), True) & covered)
    return pd.DataFrame({"piece": owner[start], "a": offset[start], "b": offset[stop]})


def _merged(length: int):
    """Groups of whole names: which windows of runs found once are equal to another window."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["name", "run"]).reset_index(drop=True)
        values, owner = _window_hashes(list(pdf["bytes"]), {}, length)
        offset = np.arange(len(owner)) - np.searchsorted(owner, owner)
        values = mix(values ^ pdf["name"].to_numpy().view(np.uint64)[owner])
        _, which, count = np.unique(values, return_inverse=True, return_counts=True)
        covered = (count[which] > 1) & (pdf["times"].to_numpy() == 1)[owner]
        out = _ranges(covered, owner, offset)
        return pd.DataFrame(
            {"name": pdf["name"].to_numpy()[out["piece"]], "run": pdf["run"].to_numpy()[out["piece"]],
             "a": out["a"].astype(np.int32), "b": out["b"].astype(np.int32)}
        )

    return run


def _all_windows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes: dict[int, Substrings] = {}
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                values, owner = _window_hashes(list(part["bytes"]), hashes, length)
                offset = np.arange(len(owner)) - np.searchsorted(owner, owner)
                columns = {c: part[c].to_numpy()[owner] for c in ("name", "run", "times")}
                yield pd.DataFrame({**columns, "value": values.view(np.int64), "a": offset.astype(np.int32)})

    return run


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts and their covered ranges to what is left."""
    for pdf in batches:
        rows = []
        for key, text, ranges in zip(pdf["key"], pdf["text"], pdf["ranges"], strict=True):
            data = (text or "").encode("utf-8", "replace")
            spans: list[list[int]] = []
            for a, b in sorted((r["first"], r["end"]) for r in (ranges if ranges is not None else ())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            cuts = [0, *(x for s in spans for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
            rows.append((key, len(data), len(data) - len(kept), len(spans), spans, kept))
        yield pd.DataFrame(rows, columns=["key", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def repeated_ranges(docs: DataFrame, length: int = LENGTH, size: int = TUPLE) -> DataFrame:
    """digest, ranges (first byte, end) covered by repeated strings; `docs` has key, digest and text."""
    kind = docs.schema["key"].dataType.simpleString()
    samples = docs.mapInArrow(
        _samples(length, size), f"key {kind}, digest binary, name long, run long, first int, last int"
    )
    # Stored, so that both sides of the join are dealt for it alone and a name with very many places can be split.
    names = materialise(samples.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"))
    again = materialise(samples.join(names, "name"))
    one = F.struct("digest", "key", "first", "last")
    runs = materialise(again.groupBy("name", "run").agg(F.count(F.lit(1)).alias("times"), F.min(one).alias("one")))
    many = runs.groupBy("name").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")
    open_runs = materialise(
        runs.join(many, "name").select("name", "run", "times", "runs", "one.*")
    )
    # Whole runs that are repeated.
    whole = again.join(runs.where("times > 1").select("name", "run"), ["name", "run"])
    covered = whole.select("digest", "first", (F.col("last") + length).alias("end"))
    # Bytes of one example of every open run.
    by_text = open_runs.groupBy("digest", "key").agg(
        F.collect_list(F.struct("name", "run", "times", "first", "last")).alias("runs")
    )
    examples = docs.select(F.col("digest").alias("d"), F.col("key").alias("k"), "text").join(
        by_text, (F.col("d") == F.col("digest")) & F.col("k").eqNullSafe(F.col("key"))
    )
    bytes_of = examples.select("text", "runs").mapInArrow(
        _contexts(length), "name long, run long, times long, bytes binary"
    )
    wide = open_runs.where(f"runs > {MOST_RUNS}").select("name").distinct()
    total = open_runs.count()
    groups = max(1, total // GROUP_RUNS)
    result = "name long, run long, a int, b int"
    if wide.limit(1).count():
        bytes_of = materialise(bytes_of)
        few = bytes_of.join(wide, "name", "left_anti")
        windows = bytes_of.join(wide, "name", "left_semi").mapInPandas(
            _all_windows(length), "name long, run long, times long, value long, a int"
        )
        windows = materialise(windows.dropDuplicates(["name", "run", "a"]))
        equal = windows.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        hits = windows.where("times = 1").join(equal, ["name", "value"]).select("name", "run", "a", F.col("a").alias("b"))
    else:
        few, hits = bytes_of, None
    merged = few.groupBy(F.pmod(F.xxhash64("name"), F.lit(groups)).alias("group")).applyInPandas(_merged(length), result)
    merged = merged if hits is None else merged.unionByName(hits)
    part = merged.join(open_runs.where("times = 1").select("name", "run", "digest", "first"), ["name", "run"])
    covered = covered.unionByName(
        part.select("digest", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b") + length).alias("end"))
    )
    return covered.groupBy("digest").agg(F.collect_set(F.struct("first", "end")).alias("ranges"))


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, size: int = TUPLE
) -> DataFrame:
    """`key`, n_bytes, n_removed, n_spans, spans (first byte, end) and kept (bytes) of every row."""
    docs = df.select(F.col(key).alias("key"), clean_text(text).alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    ranges = materialise(repeated_ranges(docs, length, size))
    joined = docs.join(ranges.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left")
    kind = docs.schema["key"].dataType.simpleString()
    out = joined.select("key", "text", "ranges").mapInPandas(
        _cut, f"key {kind}, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary"
    )
    return out.withColumnRenamed("key", key)


@query("op9_repeated_text")
def op9_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once strings of 400 bytes that start elsewhere too are cut out.

    `text` shows the remaining bytes; halves of characters that a cut leaves are replaced.
    """
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", digest, F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
