"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

A sequence of tokens is what the merge procedure gives if and only if every two neighbours are: merging the characters of
both must not merge across their border. That is a table over pairs of tokens, filled on demand from the merge list alone.
So a word needs no merging. From the left the longest token that matches is taken, if it may follow the token before it;
otherwise the next shorter one; if none may, the token before it is taken back and its place is closed for good. Every
place is closed at most once, and longest matches come from an Aho-Corasick automaton that reads the word on from the place
it is at, so the work is linear in its length for a given vocabulary.

Normalising and cutting texts into words are the tokenizer file's own rules. Both work inside runs without white space,
so a run is encoded once and remembered in a cache bounded by bytes. Special tokens' strings in a text become their ids.

Decoding gathers the tokens' bytes from one buffer by a table of offsets.

Defined results: a null or empty text has no ids and decodes to an empty text; a text or single word of any length is read
whole, in memory in proportion to it; repeated rows give the same ids; ids outside the vocabulary are an error; columns of
the names that are added are replaced; an empty table gives an empty table with the added columns.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loadspark.llm.arrow import Memo, list_column, slices, with_columns
from loadspark.llm.registry import query, table

#: Bytes that a worker's caches of runs and words may take each, and remembered pairs of tokens.
CACHE_BYTES = 48 << 20
CACHE_PAIRS = 1 << 19
#: White space of Unicode; runs without it are encoded one by one.
RUN = re.compile("[^\t-\r \x85\xa0  -     　]+")
END = ""
#: Rules by which a run of printable ASCII characters can be cut without the library: the file's, and the same for such runs.
USUAL = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+")
NEVER = 1 << 60


def model_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a vocabulary file: in the folder that LOADSPARK_TOKENIZERS names, else in that of the installed package."""
    folder = os.environ.get("LOADSPARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Vocabulary:
    """Token strings by id (in END for the mark of a word's end), the two parts and the rank of each, and the text rules."""

    strings: list[str]
    suffix: str
    left: array = field(repr=False)
    right: array = field(repr=False)
    rank: array = field(repr=False)
    special: dict[str, int]
    rules: str = field(repr=False)
    _tools: tuple | None = field(default=None, repr=False)

    def tools(self) -> tuple[Encoder, Decoder]:
        """Made once per worker: a broadcast vocabulary, and with it the encoder's caches, outlives a task."""
        if self._tools is None:
            self._tools = Encoder(self), Decoder(self)
        return self._tools

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    @property
    def texts(self) -> list[str]:
        """Tokens as the vocabulary file spells them."""
        return [s.replace(END, self.suffix) for s in self.strings]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizers file with a BPE model that has a token for every byte and makes every other token by one merge."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, suffix = file["model"], file["model"].get("end_of_word_suffix") or ""
    plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"))
    added = file["added_tokens"]
    easy = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    if model["type"] != "BPE" or not plain or not easy or file["decoder"] is not None:
        raise ValueError("only plain BPE models without a decoder and with plain special tokens are read")
    size = max([*model["vocab"].values(), *(t["id"] for t in added)]) + 1
    strings, left, right, rank = [""] * size, *(array("i", [-1]) * size for _ in range(3))
    for token, i in model["vocab"].items():
        marked = suffix and len(token) > len(suffix) and token.endswith(suffix)
        strings[i] = token[: -len(suffix)] + END if marked else token
    special = {t["content"]: t["id"] for t in added}
    for content, i in special.items():
        strings[i] = content
    for n, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        made = model["vocab"][a + b]
        x, y = model["vocab"][a], model["vocab"][b]
        if rank[made] >= 0 or max(rank[x], rank[y]) >= n:
            raise ValueError("every token must come from one merge, of tokens made before")
        left[made], right[made], rank[made] = x, y, n
    # Only the text rules are used of the library's object, so it gets an empty model.
    rules = json.dumps(file | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None})
    return Vocabulary(strings, suffix, left, right, rank, special, rules)


def _usual(file: dict) -> bool:
    """Texts are composed, blanks made one space, letters small, then cut by USUAL; nothing of it but the letters' case changes ASCII runs."""
    normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    cut = [
        {"type": "Split", "pattern": {"Regex": USUAL}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]
    return (file.get("normalizer"), file.get("pre_tokenizer")) == (
        {"type": "Sequence", "normalizers": normal}, {"type": "Sequence", "pretokenizers": cut}
    )


class Encoder:
    """Encodes texts; holds the automaton, the tables and the caches of one task."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        from tokenizers import Tokenizer

        v = vocabulary
        self.left, self.right, self.rank, self.suffix = v.left, v.right, v.rank, v.suffix
        self.merges = {v.left[i] << 32 | v.right[i]: r for i, r in enumerate(v.rank) if r >= 0}
        self.pairs: dict[int, bool] = {}
        standing = self._standing(v)
        self.longest = max(map(len, standing))
        self.automaton = ahocorasick.Automaton()
        for string, i in standing.items():
            self.automaton.add_word(string, (len(string), i))
        self.automaton.make_automaton()
        #: Next shorter token that starts the same way, and lengths, by id.
        self.shorter, self.lengths = array("i", [-1]) * len(v.strings), array("i", map(len, v.strings))
        for string, i in standing.items():
            self.shorter[i] = next((standing[string[:k]] for k in range(len(string) - 1, 0, -1) if string[:k] in standing), -1)
        rules = Tokenizer.from_str(v.rules)
        self.normalizer, self.cutter = rules.normalizer, rules.pre_tokenizer
        self.usual = _usual(json.loads(v.rules))
        self.special = v.special
        names = sorted(map(re.escape, v.special), key=len, reverse=True)
        self.names = re.compile("(" + "|".join(names) + ")") if names else None
        if [w for w, _ in self.cutter.pre_tokenize_str("a a")] != ["a", "a"]:
            raise ValueError("words must not hold white space")
        self.words = Memo(self.word, CACHE_BYTES)
        self.runs = Memo(self.run, CACHE_BYTES)

    def _standing(self, v: Vocabulary) -> dict[str, int]:
        """Tokens that merging their own characters gives: both parts stand, and nothing merges across before they are whole."""
        stands: set[int] = set()
        for i in sorted(range(len(v.strings)), key=self.rank.__getitem__):
            a, b = self.left[i], self.right[i]
            if self.rank[i] < 0 or (a in stands and b in stands and self._border(a, b, self.rank[i])):
                stands.add(i)
        return {v.strings[i]: i for i in stands if v.strings[i] and v.strings[i] not in v.special}

    def _border(self, a: int, b: int, whole: int = NEVER) -> bool:
        """No merge across the border of tokens a and b comes before they are complete (or before rank `whole`).

        What touches the border grows along the right edge of a and the left edge of b, in the order of ranks. Ties go to the
        merge further left.
        """
        left, right, rank, merges = self.left, self.right, self.rank, self.merges
        one, two = [a], [b]
        while right[one[-1]] >= 0:
            one.append(right[one[-1]])
        while left[two[-1]] >= 0:
            two.append(left[two[-1]])
        x, y = one.pop(), two.pop()
        while True:
            across = merges.get(x << 32 | y, NEVER)
            before = rank[one[-1]] if one else NEVER
            behind = rank[two[-1]] if two else NEVER
            if across < before and across <= behind and across < whole:
                return False
            if not one and not two:
                return True
            if before <= behind:
                x = one.pop()
            else:
                y = two.pop()

    def may_follow(self, a: int, b: int) -> bool:
        fits = self._border(a, b)
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = fits
        return fits

    def _longest(self, word: str) -> list[int]:
        """The longest token that starts at each place; -1 without one."""
        found = [-1] * len(word)
        # Matches come by their ends, so the longest one of a place comes last.
        for end, (size, i) in self.automaton.iter(word):
            found[end - size + 1] = i
        return found

    def word(self, word: str) -> bytes:
        """Ids of one word, as 32-bit integers."""
        if self.suffix:
            word += END
        length, pairs, out, at, left = len(word), self.pairs, array("i"), 0, -1
        # Mostly each longest match may follow the one before.
        for end, (size, right) in self.automaton.iter_long(word):
            if end - size + 1 != at:
                break
            if left >= 0:
                fits = pairs.get(left << 32 | right)
                if not (self.may_follow(left, right) if fits is None else fits):
                    break
            out.append(right)
            left, at = right, at + size
        if at < length:
            self._search(word, out, at)
        return out.tobytes()

    def _search(self, word: str, out: array, at: int) -> None:
        """Go on behind the tokens found so far: shorter ones where the longest does not fit, and back where none does."""
        length, lengths, shorter, pairs = len(word), self.lengths, self.shorter, self.pairs
        open_ = bytearray(b"\1") * (length + 1)
        if self.suffix:
            # The mark belongs to the last character.
            open_[length - 1] = 0
        left, longest = out[-1] if out else -1, self._longest(word)
        while at < length:
            right = longest[at]
            while right >= 0:
                end = at + lengths[right]
                if open_[end]:
                    if left < 0:
                        break
                    fits = pairs.get(left << 32 | right)
                    if self.may_follow(left, right) if fits is None else fits:
                        break
                right = shorter[right]
            if right >= 0:
                out.append(right)
                at, left = end, right
                continue
            if not out:
                raise ValueError("a character without a token")
            # Nothing can go on from here: close the place and try a shorter token in front of it.
            open_[at] = 0
            at -= lengths[out.pop()]
            left = out[-1] if out else -1

    def _plain(self, text: str) -> bytes:
        words = self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text) if self.normalizer else text)
        return b"".join([self.words[w] for w, _ in words if w])

    def run(self, run: str) -> bytes:
        """Ids of a run without white space."""
        if self.names is None or not self.names.search(run):
            return self._plain(run)
        parts = self.names.split(run)
        return b"".join(array("i", [self.special[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def learn(self, runs: list[str]) -> None:
        """Remember the ids of many short runs; one call of the rules reads all that are not cut here."""
        if self.usual:
            words, keep, others = self.words, self.runs.keep, []
            for run in runs:
                if not (run.isascii() and run.isprintable()):
                    others.append(run)
                elif run.isalpha():
                    keep(run, words[run.lower()])
                else:
                    keep(run, b"".join([words[w] for w in ASCII_WORDS.findall(run.lower())]))
            runs = others
        text = " ".join(runs)
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        ends = np.cumsum([len(r) + 1 for r in text.split(" ")]).tolist()
        if len(ends) != len(runs):
            return
        found: list[list[bytes]] = [[] for _ in runs]
        at = 0
        for word, (start, _) in self.cutter.pre_tokenize_str(text):
            while start >= ends[at]:
                at += 1
            found[at].append(self.words[word])
        for run, ids in zip(runs, found, strict=True):
            self.runs.keep(run, b"".join(ids))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, as 32-bit integers."""
        return b"".join(map(self.runs.__getitem__, RUN.findall(text))) if text else b""

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of several texts."""
        cut = [RUN.findall(t) if t else [] for t in texts]
        known, longest, names = self.runs, self.runs.longest, self.names
        new = [r for r in set().union(*cut) if r not in known and len(r) <= longest]
        self.learn([r for r in new if not names.search(r)] if names else new)
        return [b"".join(map(self.runs.__getitem__, runs)) for runs in cut]


class Decoder:
    """Bytes of all tokens in one buffer, found by offsets."""

    def __init__(self, vocabulary: Vocabulary):
        # The file has no decoder: tokens come as they are spelt, one space between them.
        tokens = [(t + " ").encode() for t in vocabulary.texts]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, a space behind each, and where each one ends."""
        lengths = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        take = np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.data[take], ends

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """One text for each count of ids."""
        data, ends = self.bytes_of(ids)
        last = np.cumsum(counts)
        stop = np.concatenate([[0], ends])[last]
        has = counts > 0
        # The space behind a text's last token is not part of it.
        keep = np.ones(len(data), bool)
        keep[stop[has] - 1] = False
        sizes = np.diff(np.concatenate([[0], stop])) - has
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes()))


def _schema(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    names = {f.name for f in added}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + added)


def encode(
    df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str | None = None, packed: bool = False
) -> DataFrame:
    """Add the ids of each text (`packed`: as little-endian 32-bit integers in one binary) and, if named, what they decode to."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    added = [T.StructField(ids, T.BinaryType() if packed else T.ArrayType(T.IntegerType()))]
    added += [T.StructField(decoded, T.StringType())] if decoded else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shared.value.tools()
        for batch in batches:
            for part in slices(batch, text):
                found = encoder.encode_all(part.column(text).to_pylist())
                counts = np.array([len(f) // 4 for f in found], np.int64)
                flat = np.frombuffer(b"".join(found), "<i4")
                new = {ids: pa.array(found, pa.binary()) if packed else list_column(flat, counts)}
                if decoded:
                    new[decoded] = decoder.texts(flat, counts)
                yield with_columns(part, new)

    return df.mapInArrow(run, _schema(df, added))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each row's ids (an array of integers); null ids decode to an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = shared.value.tools()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [np.asarray(r or [], np.int64) for r in part.column(ids).to_pylist()]
                counts = np.array([len(r) for r in rows], np.int64)
                yield with_columns(part, {out: decoder.texts(np.concatenate(rows), counts)})

    return df.mapInArrow(run, _schema(df, [T.StructField(out, T.StringType())]))


@query("op11_bpe_tokens")
def op11_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digest of every document's ids, and digest of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, load_vocabulary(model_path()), decoded="decoded", packed=True)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
