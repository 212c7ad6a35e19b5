"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers cut a space and the text into tokens A and B. Where an A token and a B token start at the same byte, a group
starts. A fragment is what a byte range of a document says about its groups: the tokens that start in the range, cut into an
open prefix (it belongs to a group that started before the range), closed groups, and an open suffix (its end is not known
yet). Two neighbours compose by joining the suffix of the left with the prefix of the right; a range without a common start is
prefix and suffix in one. This is associative and an empty fragment changes nothing, so any tree of compositions gives the
groups of the document.

1. Documents up to LONG bytes are one range. Longer ones are cut into ranges of RANGE bytes; a range goes to a task of its own
   with the text around it up to the nearest single space between two characters that are not white space. No token of
   either tokenizer crosses such a place, so the tokens that start in the range are those of the whole document.
2. The fragments of a long document are composed in a tree, FAN at a time, each composition a task of its own.
3. Aligned documents lie in blocks of about BLOCK_BYTES of text. A block says in how many of its documents every linked id
   pair occurs; summed over blocks these are the corpus counts, and the highest per A id follows.
4. The counts of the pairs of a block come back to it and are added up over the links of its documents. So what moves are
   distinct pairs per block, not links. Rows of one pair are spread over SPREAD groups in both joins.

A group of m A and n B tokens has m * n links. Groups of many links are reduced to distinct ids with their multiplicity first.

Defined results: a text that is null, empty, or whose joined A or B bytes differ from space and text has no tokens; any length
of text is read whole; rows are documents, whatever their key, so repeated rows count each; a null key stays null; an empty
table gives an empty table; extra columns are not returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loadspark.llm.arrow import Strings, list_column, slices
from loadspark.llm.bpe_tokens import model_path
from loadspark.llm.registry import query, table
from loadspark.session import materialise, spread_groups

RANGE = 1 << 16
LONG = 1 << 17
FAN = 8
BLOCK_BYTES = 1 << 23
#: Groups with more links than this are reduced to distinct ids before their links are listed.
LINKS = 1 << 12
SPREAD = 32
#: How hard packed documents, which are stored once and shuffled once, are compressed.
LEVEL = 6
SPACE = "▁"
#: Characters beyond those scripts and punctuation whose classes are settled.
RARE = re.compile("[^\\x00-\\u04ff\\u2000-\\u206f]")
#: Characters of a run that the faster library is spared.
LONG_RUN = 1000


# --- fragments


@dataclass
class Fragment:
    """Tokens of a byte range and the sizes of its groups; the first and the last group are open."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray

    def then(self, other: Fragment) -> Fragment:
        return compose([self, other])


EMPTY = Fragment(*(np.zeros(n, np.int32) for n in (0, 0, 1, 1)))


def compose(parts: list[Fragment]) -> Fragment:
    """Neighbouring fragments in order: each open suffix is joined with the open prefix behind it."""
    if not parts:
        return EMPTY

    def sizes(which: str) -> np.ndarray:
        flat = np.concatenate([getattr(p, which) for p in parts])
        lengths = np.array([len(getattr(p, which)) for p in parts])
        # Groups of the concatenation, less one at each seam.
        group = np.arange(len(flat)) - np.repeat(np.arange(len(parts)), lengths)
        out = np.zeros(group[-1] + 1, np.int32)
        np.add.at(out, group, flat)
        return out

    return Fragment(
        np.concatenate([p.a for p in parts]), np.concatenate([p.b for p in parts]), sizes("of_a"), sizes("of_b")
    )


def fragment(ids_a: np.ndarray, ids_b: np.ndarray, starts_a: np.ndarray, starts_b: np.ndarray) -> Fragment:
    """The fragment of tokens with these starts."""
    common = np.intersect1d(starts_a, starts_b, assume_unique=True)
    cut_a = np.concatenate([[0], np.searchsorted(starts_a, common), [len(ids_a)]])
    cut_b = np.concatenate([[0], np.searchsorted(starts_b, common), [len(ids_b)]])
    return Fragment(ids_a, ids_b, np.diff(cut_a).astype(np.int32), np.diff(cut_b).astype(np.int32))


def _blank(data: bytes, at: int, forward: bool) -> bool:
    """The character behind (before) a place is white space, or there is none."""
    if forward:
        end = at + 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        char = data[at:end]
    else:
        start = at - 1
        while start > 0 and data[start] & 0xC0 == 0x80:
            start -= 1
        char = data[max(start, 0) : at]
    return not char or char.decode("utf-8", "replace").isspace()


def _border(data: bytes, at: int) -> bool:
    return at == 0 or (data[at] == 32 and not _blank(data, at, False) and not _blank(data, at + 1, True))


def windows(data: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges (from, to) that cover `data`, and the window (start, end) of each, which begins and ends at a border."""
    at = 0
    while at < len(data):
        stop = min(len(data), at + size)
        start = at
        while not _border(data, start):
            start = max(0, data.rfind(b" ", 0, start))
        end = stop
        while end < len(data) and not _border(data, end):
            found = data.find(b" ", end + 1)
            end = len(data) if found < 0 else found
        if end - stop > size:
            # A long stretch without a border: the range takes all of it, so that no text is read over and over.
            stop = end
        yield at, stop, start, end
        at = stop


# --- tokens


def _rare(text: str) -> bool:
    """Rare characters, or a long run with or without white space."""
    if not text.isascii() and RARE.search(text):
        return True
    runs = list(map(len, text.split()))
    return max(runs, default=0) >= LONG_RUN or (len(text) - sum(runs) >= LONG_RUN and bool(re.search(rf"\s{{{LONG_RUN}}}", text)))


def byte_values() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Files:
    """The contents of both vocabulary files."""

    a: str = field(repr=False)
    b: bytes = field(repr=False)
    _tokens: Tokens | None = field(default=None, repr=False)

    def tokens(self) -> Tokens:
        """Made once per worker: broadcast files, and with them the tokenizers, outlive a task."""
        if self._tokens is None:
            self._tokens = Tokens(self)
        return self._tokens

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tokens": None}


def load_files(a: str, b: str) -> Files:
    """Read a byte-level BPE file (A) and a SentencePiece model with byte pieces (B)."""
    with open(a, encoding="utf-8") as f:
        text = f.read()
    with open(b, "rb") as f:
        return Files(text, f.read())


def _spelt(strings: Strings, ids: list[np.ndarray]) -> list[bytes]:
    """The joined strings of each array of ids."""
    flat = np.concatenate([np.zeros(0, np.int32), *ids])
    data, ends = strings.joined(flat), np.concatenate([[0], np.cumsum(strings.lengths[flat])])
    cuts = ends[np.cumsum([0, *map(len, ids)])].tolist()
    return [data[i:j] for i, j in pairwise(cuts)]


class Tokens:
    """Both tokenizers of one task, and the bytes of their tokens."""

    def __init__(self, files: Files):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.of_a = Tokenizer.from_str(files.a)
        self.of_a.encode_special_tokens = True
        self.of_b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        values = byte_values()
        file = json.loads(files.a)
        names = {i: t for t, i in file["model"]["vocab"].items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.bytes_a = [b""] * (max(names) + 1)
        for i, name in names.items():
            known = all(c in values for c in name)
            self.bytes_a[i] = bytes(values[c] for c in name) if known else name.encode()
        model = self.of_b
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces must have spaces in front only")
        self.fast = self._fast(file)
        self.strings_a, self.strings_b = Strings(self.bytes_a), Strings(self.bytes_b)

    def _fast(self, file: dict):
        """The same merges in the tiktoken library, which is faster, where ranks are ids and splitting is by the usual pattern."""
        import public_tokenizers
        import tiktoken

        model, ranks = file["model"], {}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        cutter = file["pre_tokenizer"]
        usual = cutter["type"] == "ByteLevel" and cutter["use_regex"] and not cutter["add_prefix_space"]
        if made != sorted(set(made)) or not usual or file["normalizer"] is not None or model.get("ignore_merges"):
            return None
        ranks = {self.bytes_a[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, texts: list[str]) -> list[np.ndarray]:
        # Character classes that Unicode still adds to, and long runs, are for the library the file belongs to.
        slow = [i for i, t in enumerate(texts) if self.fast is None or _rare(t)]
        out: list = [None] * len(texts)
        for i, e in zip(slow, self.of_a.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.int32)
        return [np.array(self.fast.encode_ordinary(t), np.int32) if x is None else x for x, t in zip(out, texts, strict=True)]

    def encode(self, datas: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
        """A ids and B ids of texts that begin with a space, and whether both give the text's bytes."""
        texts = [d.decode("utf-8", "replace") for d in datas]
        a = self._ids_a(texts)
        b = [np.array(i, np.int32) for i in self.of_b.encode([t[1:] for t in texts], num_threads=1)]
        fine = [x == d and y == d for x, y, d in zip(_spelt(self.strings_a, a), _spelt(self.strings_b, b), datas, strict=True)]
        return a, b, fine

    def starts(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = self.strings_a.lengths[a], self.strings_b.lengths[b]
        return np.cumsum(x) - x, np.cumsum(y) - y

    def whole(self, a: list[np.ndarray], b: list[np.ndarray]) -> Documents:
        """Groups of whole documents, whose first group starts with them and whose last one ends with them."""
        docs = [len(x) for x in a], [len(y) for y in b]
        flat_a, flat_b = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (a, b))
        # One behind the other, every document starts at a common start.
        f = fragment(flat_a, flat_b, *self.starts(flat_a, flat_b))
        first = np.concatenate([[0], np.cumsum(f.of_a[1:])])
        groups = np.diff(np.searchsorted(first, np.concatenate([[0], np.cumsum(docs[0])])))
        return Documents(flat_a, flat_b, f.of_a[1:], f.of_b[1:], *map(np.array, docs), groups)


FIELDS = ("a", "b", "of_a", "of_b", "in_a", "in_b", "groups")


@dataclass
class Documents:
    """Documents one behind the other: ids, group sizes, and per document the number of A ids, B ids and groups."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    in_a: np.ndarray
    in_b: np.ndarray
    groups: np.ndarray

    def packed(self) -> bytes:
        """All numbers in the fewest bytes each, compressed."""
        arrays = [getattr(self, n) for n in FIELDS]
        small = [x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0).newbyteorder("<")) for x in arrays]
        head = np.array([(len(x), x.itemsize) for x in small], "<u8").tobytes()
        data = head + b"".join(x.tobytes() for x in small)
        return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)

    @staticmethod
    def unpacked(packed: bytes) -> Documents:
        data = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
        at, out = 16 * len(FIELDS), []
        for n, size in np.frombuffer(data, "<u8", 2 * len(FIELDS)).reshape(-1, 2).tolist():
            out.append(np.frombuffer(data, f"<u{size}", n, at).astype(np.int64))
            at += n * size
        return Documents(*out)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, id pair and multiplicity of links; those of one group and id pair may come in several entries."""
        doc = np.repeat(np.arange(len(self.groups)), self.groups)
        a, b, of_a, of_b = (x.astype(np.int64) for x in (self.a, self.b, self.of_a, self.of_b))
        big = np.flatnonzero(of_a * of_b > LINKS)
        first_a, first_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        found = [_pairs(a, b, first_a, first_b, np.where(of_a * of_b > LINKS, 0, of_a), of_b, doc)]
        for g in big.tolist():
            x, n = np.unique(a[first_a[g] : first_a[g] + of_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g] : first_b[g] + of_b[g]], return_counts=True)
            pair = (x[:, None] << 32 | y[None, :]).ravel()
            found.append((np.full(len(pair), doc[g]), pair, (n[:, None] * m[None, :]).ravel()))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def _pairs(a, b, first_a, first_b, of_a, of_b, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = of_a * of_b
    group = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    per = of_b[group]
    pair = a[first_a[group] + at // per] << 32 | b[first_b[group] + at % per]
    return doc[group], pair, np.ones(len(pair), np.int64)


def pair_counts(d: Documents) -> tuple[np.ndarray, np.ndarray]:
    """Linked id pairs and the number of documents that hold each."""
    doc, pair, _ = d.links()
    a, b, n = pair >> 32, pair & 0xFFFFFFFF, len(d.groups)
    if len(pair) and max(a.max(), b.max()) < 1 << 20 and n < 1 << 22:
        # Both ids and the document fit one number: one sort.
        held = a << 42 | b << 22 | doc
        held.sort()
        held = held[np.diff(held, prepend=-1) != 0] >> 22
        first = np.flatnonzero(np.diff(held, prepend=-1))
        return held[first] >> 20 << 32 | held[first] & 0xFFFFF, np.diff(first, append=len(held))
    pairs, which = np.unique(pair, return_inverse=True)
    n = max(1, len(d.groups))
    held = np.unique(which * n + doc)
    return pairs, np.bincount(held // n, minlength=len(pairs))


def written(n_a: int, n_b: int) -> list[str]:
    """Ids as they stand in the text of a group: A ids, then B ids, each followed by a comma, a bar, a semicolon."""
    return [f"{i}{end}" for n in (n_a, n_b) for end in (",", "|", ";") for i in range(n)]


def digests(d: Documents, names: Strings, n_a: int, n_b: int) -> list[str]:
    """Digest of each document's groups as text; an empty text for documents without tokens."""
    code = np.zeros(len(d.a) + len(d.b), np.int64)
    end_a, end_b = np.cumsum(d.of_a), np.cumsum(d.of_b)
    # 0 for a comma, 1 for the last A and 2 for the last B token of a group.
    kind_a, kind_b = np.zeros(len(d.a), np.int64), np.zeros(len(d.b), np.int64)
    kind_a[end_a - 1], kind_b[end_b - 1] = 1, 2
    code[np.arange(len(d.a)) + np.repeat(end_b - d.of_b, d.of_a)] = d.a + kind_a * n_a
    code[np.arange(len(d.b)) + np.repeat(end_a, d.of_b)] = 3 * n_a + d.b + kind_b * n_b
    text = memoryview(names.joined(code))
    ends = np.concatenate([[0], np.cumsum(names.lengths[code])])
    cuts = ends[np.concatenate([[0], np.cumsum(d.in_a + d.in_b)])].tolist()
    return [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in pairwise(cuts)]


# --- jobs

INTS, LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
GROUPED = [T.StructField(n, INTS) for n in ("a", "b", "of_a", "of_b")]


def _stored_schema(kind: T.DataType) -> T.StructType:
    """Rows of three kinds: some documents (packed is set), the pairs of a block (pair is set), a window (window is set)."""
    return T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("keys", T.ArrayType(kind)),
            T.StructField("packed", T.BinaryType()),
            T.StructField("pair", LONGS),
            T.StructField("docs", LONGS),
            T.StructField("part", T.IntegerType()),
            T.StructField("window", T.BinaryType()),
            T.StructField("first", T.IntegerType()),
            T.StructField("last", T.IntegerType()),
        ]
    )


def _row(schema: pa.Schema, block: int, **columns: pa.Array) -> pa.RecordBatch:
    columns["block"] = pa.array([block])
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)


def _one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _pair_row(schema: pa.Schema, block: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    pairs, counts = map(np.concatenate, zip(*held, strict=True))
    pairs, which = np.unique(pairs, return_inverse=True)
    total = np.zeros(len(pairs), np.int64)
    np.add.at(total, which, counts)
    return _row(schema, block, pair=_one_list(pa.array(pairs)), docs=_one_list(pa.array(total)))


def _first_pass(shared, schema: pa.Schema):
    """Texts to aligned documents and pairs of blocks; of long texts to windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens()
        # Blocks are numbered within the task; the rows are stored before they are used, so the numbers stay. A long document
        # takes the next number and leaves the open block its own, whose documents are partly handed over already.
        block = used = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                datas = [b" " + t.encode("utf-8", "replace") if t else b"" for t in texts]
                short = [i for i, d in enumerate(datas) if len(d) <= LONG]
                for i in (i for i, d in enumerate(datas) if len(d) > LONG):
                    used += 1
                    for k, (at, stop, start, end) in enumerate(windows(datas[i], RANGE)):
                        yield _row(
                            schema, used, keys=_one_list(part.column("key").take(pa.array([i]))),
                            part=pa.array([k], pa.int32()), window=pa.array([datas[i][start:end]]),
                            first=pa.array([at - start], pa.int32()), last=pa.array([stop - start], pa.int32()),
                        )
                if not short:
                    continue
                a, b, fine = tokens.encode([datas[i] for i in short])
                none = np.zeros(0, np.int32)
                docs = tokens.whole(*([x if ok else none for x, ok in zip(y, fine, strict=True)] for y in (a, b)))
                yield _row(
                    schema, block, keys=_one_list(part.column("key").take(pa.array(short))), packed=pa.array([docs.packed()])
                )
                held.append(pair_counts(docs))
                held = [h for h in held if len(h[0])]
                size += sum(len(datas[i]) for i in short)
                if size > BLOCK_BYTES:
                    if held:
                        yield _pair_row(schema, block, held)
                    used += 1
                    held, size, block = [], 0, used
        if held:
            yield _pair_row(schema, block, held)

    return run


def _range_fragments(shared):
    """Windows to the fragments of their ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value.tokens()
        for batch in batches:
            for i in range(batch.num_rows):
                (a,), (b,), (fine,) = tokens.encode([batch.column("window")[i].as_py()])
                starts_a, starts_b = tokens.starts(a, b)
                limits = batch.column("first")[i].as_py(), batch.column("last")[i].as_py()
                (from_a, to_a), (from_b, to_b) = np.searchsorted(starts_a, limits), np.searchsorted(starts_b, limits)
                f = fragment(a[from_a:to_a], b[from_b:to_b], starts_a[from_a:to_a], starts_b[from_b:to_b]) if fine else EMPTY
                yield _fragment_row(batch.slice(i, 1).select(["block", "keys", "part"]), f, fine)

    return run


def _fragment_row(head: pa.RecordBatch, f: Fragment, fine: bool) -> pa.RecordBatch:
    lists = [list_column(x, np.array([len(x)])) for x in (f.a, f.b, f.of_a, f.of_b)]
    return pa.RecordBatch.from_arrays(
        [*head.columns, *lists, pa.array([fine])], names=["block", "keys", "part", "a", "b", "of_a", "of_b", "fine"]
    )


def _composed(rows: pa.Table) -> pa.Table:
    """One group of neighbouring fragments to one fragment."""
    rows = rows.sort_by("part").combine_chunks()
    lists = [rows.column(n).chunk(0) for n in ("a", "b", "of_a", "of_b")]
    parts = [Fragment(*(c[i].values.to_numpy() for c in lists)) for i in range(rows.num_rows)]
    head = rows.select(["block", "keys", "part"]).slice(0, 1).to_batches()[0]
    head = head.set_column(2, "part", pa.array([rows.column("part")[0].as_py() // FAN], pa.int32()))
    return pa.Table.from_batches([_fragment_row(head, compose(parts), all(rows.column("fine").to_pylist()))])


def _closed(schema: pa.Schema):
    """Fragments of whole documents to aligned documents, each a block of its own with its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                # Before the first byte nothing starts, so the open prefix is empty; the end closes the suffix.
                a, b, of_a, of_b = (batch.column(n)[i].values.to_numpy() for n in ("a", "b", "of_a", "of_b"))
                if not batch.column("fine")[i].as_py():
                    a, b, of_a, of_b = (np.zeros(n, np.int32) for n in (0, 0, 1, 1))
                d = Documents(a, b, of_a[1:], of_b[1:], np.array([len(a)]), np.array([len(b)]), np.array([len(of_a) - 1]))
                block = batch.column("block")[i].as_py()
                yield _row(schema, block, keys=batch.column("keys").take(pa.array([i])), packed=pa.array([d.packed()]))
                held = pair_counts(d)
                if len(held[0]):
                    yield _pair_row(schema, block, [held])

    return run


def align(df: DataFrame, files: Files, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Aligned documents (keys, and their ids and group sizes packed) and the pairs of their blocks, stored."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(files)
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = _stored_schema(docs.schema["key"].dataType)
    schema = to_arrow_schema(kind)
    stored = materialise(docs.mapInArrow(_first_pass(shared, schema), kind))
    cut = stored.where("window IS NOT NULL").select("block", "keys", "part", "window", "first", "last")
    longest = cut.agg(F.max("part")).first()[0]
    done = stored.drop("part", "window", "first", "last")
    if longest is None:
        return done
    state = T.StructType([kind["block"], kind["keys"], kind["part"], *GROUPED, T.StructField("fine", T.BooleanType())])
    parts = spread_groups(cut, "block", "part").mapInArrow(_range_fragments(shared), state)
    left = longest + 1
    while left > 1:
        parts = parts.groupBy("block", F.floor(F.col("part") / FAN).alias("above")).applyInArrow(_composed, state)
        left = -(-left // FAN)
    whole = materialise(parts.mapInArrow(_closed(schema), kind).drop("part", "window", "first", "last"))
    return done.unionByName(whole)


def _block_pairs(aligned: DataFrame) -> DataFrame:
    cells = aligned.where("pair IS NOT NULL").select("block", F.explode(F.arrays_zip("pair", "docs")).alias("c"))
    slot = F.pmod(F.xxhash64("block"), F.lit(SPREAD)).cast("int").alias("slot")
    return cells.select("block", slot, "c.pair", "c.docs")


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair (A id and B id in one long), documents that hold it linked, and whether no pair of that A id is in more."""
    total = _block_pairs(aligned).groupBy("pair").agg(F.sum("docs").alias("documents"))
    of = F.shiftright("pair", 32)
    highest = total.groupBy(of.alias("of")).agg(F.max("documents").alias("most"))
    # At most one row per B id meets one A id here.
    both = total.withColumn("a", of).join(highest, F.col("a") == F.col("of"))
    return both.select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def _scored(files_sizes: tuple[int, int], schema: pa.Schema):
    """Documents of a block and the counts of its pairs to one row a document."""
    made: list[Strings] = []

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        if not made:
            made.append(Strings([n.encode() for n in written(*files_sizes)]))
        names = made[0]
        order = np.argsort(pairs.column("pair").to_numpy())
        known, count, best = (pairs.column(n).to_numpy()[order] for n in ("pair", "documents", "best"))
        found = [pa.Table.from_batches([], schema)]
        for keys, packed in zip(docs.column("keys"), docs.column("packed"), strict=True):
            d = Documents.unpacked(packed.as_py())
            doc, pair, times = d.links()
            n_links, n_best, total = np.zeros((3, len(d.groups)), np.int64)
            if len(pair):
                at = np.searchsorted(known, pair)
                np.add.at(n_links, doc, times)
                np.add.at(n_best, doc, times * best[at].astype(np.int64))
                np.add.at(total, doc, times * count[at])
            numbers = [pa.array(x) for x in (d.in_a, d.in_b, d.groups, n_links, n_best, total)]
            text = pa.array(digests(d, names, *files_sizes), pa.string())
            found.append(pa.Table.from_arrays([keys.values, *numbers, text], schema=schema))
        return pa.concat_tables(found)

    return run


def score(aligned: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document; ids lie below n_a and n_b."""
    from pyspark.sql.pandas.types import to_arrow_schema

    cells = _block_pairs(aligned).drop("docs")
    held = cells.select("pair", "slot").distinct().join(link_counts(aligned), "pair")
    counted = cells.join(held, ["pair", "slot"]).select(F.col("block").alias("of"), "pair", "documents", "best")
    docs = aligned.where("packed IS NOT NULL").select("block", "keys", "packed")
    longs = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    kind = T.StructType(
        [T.StructField("key", docs.schema["keys"].dataType.elementType), *(T.StructField(n, T.LongType()) for n in longs), T.StructField("groups_sha256", T.StringType())]
    )
    both = docs.groupBy("block").cogroup(counted.groupBy("of"))
    return both.applyInArrow(_scored((n_a, n_b), to_arrow_schema(kind)), kind)


def groups(aligned: DataFrame) -> DataFrame:
    """key and the groups of every document, each with its A ids and its B ids."""
    docs = aligned.where("packed IS NOT NULL").select("keys", "packed")
    group = T.ArrayType(T.StructType([T.StructField("a", INTS), T.StructField("b", INTS)]))
    kind = T.StructType([T.StructField("key", docs.schema["keys"].dataType.elementType), T.StructField("groups", group)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, packed in zip(batch.column("keys"), batch.column("packed"), strict=True):
                d = Documents.unpacked(packed.as_py())
                lists = [list_column(x.astype(np.int32), n) for x, n in ((d.a, d.of_a), (d.b, d.of_b))]
                offsets = pa.array(np.concatenate([[0], np.cumsum(d.groups)]).astype(np.int32))
                column = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(lists, names=["a", "b"]))
                yield pa.RecordBatch.from_arrays([keys.values, column], names=["key", "groups"])

    return docs.mapInArrow(run, kind)


def sizes(files: Files) -> tuple[int, int]:
    """How many ids both tokenizers have."""
    tokens = files.tokens()
    return len(tokens.bytes_a), len(tokens.bytes_b)


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, per document, weighed by corpus counts."""
    files = load_files(model_path("byte_bpe_50k.json"), model_path("piece_bpe_32k.model"))
    aligned = align(table(spark, sf_dir, "documents").select("doc_id", "text"), files)
    return score(aligned, *sizes(files)).withColumnRenamed("key", "doc_id")
