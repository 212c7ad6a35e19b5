"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice of a text has a node between any two characters and an edge for every piece. The pass goes left to right and
keeps, per node, the best last piece. In a BPE model the score that decides is the order of merges: an edge may follow
another only if merging the two pieces' characters from scratch gives these two pieces again. Exactly one chain of
such edges reaches each node, and it is the segmentation the merge procedure itself would give.

Only nodes within the longest piece of the current one can still be extended, so that window is all that is kept. As soon
as the backpointers of all nodes in it lead through one boundary, everything before is committed and forgotten. White
space is such a boundary by itself (pieces carry it in front only), and so is any place between two characters that stand
side by side in no piece: the runs between are segmented once and remembered in a bounded cache.

Characters without a piece are written as UTF-8 byte pieces, and so is U+2581, which stands for the space inside the
model: decoding gives back every text exactly.

Defined results: a null or empty text has no ids and decodes to an empty text; texts and single runs of any length are read
whole; repeated rows give the same ids; ids outside the model are an error; an empty table stays empty; columns of the names
that are added are replaced, other columns stay.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from operator import add, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loadspark.llm.arrow import Memo, Strings, list_column, slices, with_columns
from loadspark.llm.bpe_tokens import model_path
from loadspark.llm.registry import query, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes that each of a worker's two caches of runs may take, and pairs of pieces remembered; full ones start anew.
CACHE_BYTES = 64 << 20
CACHE_PAIRS = 500_000
CACHED_LENGTH = 48
DECODED_ROWS = 64
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class Vocabulary:
    """Pieces by id, their scores, the ids of the 256 byte pieces, of ordinary pieces, and of those that merging reaches."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    ordinary: list[int]
    standing: list[int]
    _encoder: Encoder | None = field(default=None, repr=False)

    def encoder(self) -> Encoder:
        """Made once per worker: a broadcast vocabulary, and with it the encoder's caches, outlives a task."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoder": None}


def merged(text: str, ids: dict[str, int], scores: list[float]) -> list[str]:
    """The merge procedure itself, on the few characters of one or two pieces."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            i = ids.get(parts[k] + parts[k + 1])
            if i is not None and (best is None or scores[i] > best):
                best, at = scores[i], k
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """Read a model file (a BPE model with byte pieces, spaces in front of pieces only)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or model_path(MODEL))
    size = model.vocab_size()
    pieces = [model.id_to_piece(i) for i in range(size)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    ordinary = [
        i for i in range(size)
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    inner = [p for i in ordinary if SPACE in (p := pieces[i]).lstrip(SPACE)]
    if inner or len(set(byte_ids)) != 256:
        raise ValueError("the model must have byte pieces and spaces in front of pieces only")
    scores, ids = [model.get_score(i) for i in range(size)], {pieces[i]: i for i in ordinary}
    standing = [i for i in ordinary if merged(pieces[i], ids, scores) == [pieces[i]]]
    return Vocabulary(pieces, scores, byte_ids, ordinary, standing)


class Encoder:
    """Segments texts; holds the caches of one task."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.ids = {vocabulary.pieces[i]: i for i in vocabulary.ordinary}
        #: Pieces by id; characters without a piece get ids of their own behind them.
        self.pieces = list(vocabulary.pieces)
        self.size = len(self.pieces)
        self.lone: dict[str, int] = {}
        self.scores = vocabulary.scores
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = vocabulary.byte_ids
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: By piece: which pieces may come behind it, as far as known.
        self.after: dict[int, dict[int, bool]] = defaultdict(dict)
        self.known = 0
        #: The pieces as a tree: per character the id of a piece that the merge procedure reaches, and what may follow.
        self.root: dict[str, list] = {}
        for i in vocabulary.standing:
            node = [None, self.root]
            for char in self.pieces[i]:
                node = node[1].setdefault(char, [None, {}])
            node[0] = i
        #: The same pieces in one automaton, each with its length less one and its id.
        self.automaton = ahocorasick.Automaton()
        for i in vocabulary.standing:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]) - 1, i))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.runs = Memo(self.ids_of, CACHE_BYTES, CACHED_LENGTH)
        self.words = Memo(self.word, CACHE_BYTES, CACHED_LENGTH)
        as_bytes = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            as_bytes[i] = bytes([b])
        self.as_bytes = as_bytes
        self.strings = Strings(as_bytes)

    def follows(self, left: int, right: int) -> bool:
        """`right` may come after `left`: merging both from scratch gives them again."""
        a, b = self.pieces[left], self.pieces[right]
        fits = merged(a + b, self.ids, self.scores) == [a, b]
        if self.known >= CACHE_PAIRS:
            self.after.clear()
            self.known = 0
        self.known += 1
        self.after[left][right] = fits
        return fits

    def lone_id(self, char: str) -> int:
        i = self.lone.get(char)
        if i is None:
            i = self.lone[char] = len(self.pieces)
            self.pieces.append(char)
        return i

    def segment(self, run: str) -> Iterator[int]:
        """Ids of pieces (or of lone characters) of a run, committed as soon as they are certain."""
        root, after, longest = self.root, self.after, self.longest
        length, window = len(run), 4 * longest
        done, tail = 0, None
        # Last piece of the chain to each node from `done` on; None where no chain ends (yet).
        last: list[int | None] = [None] * (min(length, window + longest) + 1)
        for start in range(length):
            left = last[start - done] if start > done else tail
            if left is None and start > done:
                continue
            tree, at = root, start - done
            if last[at + 1] is None and (run[start] not in root or root[run[start]][0] is None):
                last[at + 1] = self.lone_id(run[start])
            for char in run[start : start + longest]:
                found = tree.get(char)
                if found is None:
                    break
                right, tree = found
                at += 1
                if right is not None and last[at] is None:
                    if left is not None:
                        fits = after[left].get(right)
                        if not (self.follows(left, right) if fits is None else fits):
                            continue
                    last[at] = right
            if start - done >= window:
                # Any longer chain passes one of the nodes behind `start`: where theirs meet, all meet.
                upto = self._common(last, start - done + 1)
                if upto:
                    path = self._path(last, upto)
                    yield from path
                    tail = path[-1]
                    done += upto
                    last = last[upto:] + [None] * upto
                else:
                    window += longest
                    last += [None] * longest
        if done < length:
            yield from self._path(last, length - done)

    def _short(self, run: str) -> list[int]:
        """The same pass over a run that fits the window whole, so that nothing is committed before its end.

        The automaton names the pieces that end at a node. All nodes are reached, unless a character has no piece.
        """
        after, length = self.after, len(run)
        last: list[int | None] = [None] * (length + 1)
        behind: list[dict[int, bool] | None] = [None] * (length + 1)
        for end, (before, right) in self.automaton.iter(run):
            if last[end + 1] is None:
                start = end - before
                if start:
                    known = behind[start]
                    if known is None:
                        return list(self.segment(run))
                    fits = known.get(right)
                    if not (self.follows(last[start], right) if fits is None else fits):
                        continue
                last[end + 1], behind[end + 1] = right, after[right]
        return self._path(last, length) if None not in last[1:] else list(self.segment(run))

    def _path(self, last: list[int | None], node: int) -> list[int]:
        out = []
        while node > 0:
            out.append(last[node])
            node -= len(self.pieces[last[node]])
        return out[::-1]

    def _common(self, last: list[int | None], first: int) -> int:
        """The last node that the chains of all nodes from `first` on pass; 0 if there is none."""
        shared: set[int] | None = None
        for node in range(first, len(last)):
            if last[node] is not None:
                passed, at = set(), node
                while at > 0:
                    passed.add(at)
                    at -= len(self.pieces[last[at]])
                shared = passed if shared is None else shared & passed
        return max(shared, default=0) if shared else 0

    def ids_of(self, run: str) -> bytes:
        """Ids of a run between two certain boundaries, as 32-bit integers."""
        path = self._short(run) if self.root and len(run) <= 4 * self.longest else self.segment(run)
        if isinstance(path, list) and max(path, default=0) < self.size:
            return array("i", path).tobytes()
        out: list[int] = []
        for i in path:
            if i < self.size:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in self.pieces[i].encode("utf-8", "replace"))
        return array("i", out).tobytes()

    def _cuts(self, unit: str) -> list[int]:
        """Places between two characters that stand side by side in no piece."""
        inner = self.inner
        return [k for k, pair in enumerate(map(add, unit, unit[1:]), 1) if pair not in inner]

    def word(self, word: str) -> bytes:
        """Ids of a word behind one space; it is cut where two characters meet that stand side by side in no piece."""
        unit = SPACE + word
        # Letters stand side by side in most scripts' pieces; a run that could be cut and is not gives the same ids.
        cuts = [] if word.isascii() and word.isalpha() else self._cuts(unit)
        if not cuts:
            return self.ids_of(unit)
        head = unit[1 : cuts[0]]
        first = self.words.get(head) if head else self.runs[SPACE]
        if first is None:
            first = self.ids_of(unit[: cuts[0]])
            if len(head) <= CACHED_LENGTH:
                self.words.keep(head, first)
        rest = [self.runs[unit[i:k]] for i, k in zip(cuts, [*cuts[1:], len(unit)], strict=True)]
        return b"".join([first, *rest])

    def unit(self, unit: str) -> bytes:
        """Ids of spaces and what comes behind them."""
        cuts = self._cuts(unit)
        return b"".join([self.runs[unit[i:k]] for i, k in zip([0, *cuts], [*cuts, len(unit)], strict=True)])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        if not text:
            return np.zeros(0, np.int32)
        words = text.split(" ")
        if "" in words or SPACE in text:
            return np.frombuffer(self._encode_spaces(text), np.int32)
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)

    def _encode_spaces(self, text: str) -> bytes:
        """A text with runs of spaces, or with U+2581, which goes to byte pieces."""
        mark = array("i", [self.byte_ids[b] for b in SPACE.encode()]).tobytes()
        first, *rest = text.split(SPACE)
        parts = (SPACE + first.replace(" ", SPACE), *(p.replace(" ", SPACE) for p in rest))
        return mark.join(b"".join(map(self.unit, UNITS.findall(p))) for p in parts)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        text = b"".join(map(self.as_bytes.__getitem__, ids))
        return text.decode("utf-8", "replace")[1:]


    def texts(self, flat: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of arrays of ids that lie one after another."""
        data, ends = self.strings.joined(flat), np.concatenate([[0], np.cumsum(self.strings.lengths[flat])])
        cuts = ends[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        return [data[i:j].decode("utf-8", "replace")[1:] for i, j in pairwise(cuts)]


def _with(df: DataFrame, *added: T.StructField) -> T.StructType:
    names = {f.name for f in added}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + list(added))


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", same: str | None = None) -> DataFrame:
    """Add the ids of each text, and in column `same`, if named, whether they decode to the text again.

    Columns of these names are replaced. Texts are read and ids handed over in slices of bounded bytes.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    added = [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(same, T.BooleanType())] if same else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for batch in batches:
            for part in slices(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                found = [encoder.encode(t) for t in texts]
                flat = np.concatenate([np.zeros(0, np.int32), *found])
                lengths = np.array(list(map(len, found)), np.int64)
                new = {out: list_column(flat, lengths)}
                if same:
                    new[same] = pa.array(list(map(eq, encoder.texts(flat, lengths), texts)), pa.bool_())
                yield with_columns(part, new)

    return df.mapInArrow(run, _with(df, *added))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each row's ids; a column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(at, DECODED_ROWS)
                texts = ["" if r is None else encoder.decode(r) for r in part.column(ids).to_pylist()]
                yield with_columns(part, {out: pa.array(texts, pa.string())})

    return df.mapInArrow(run, _with(df, T.StructField(out, T.StringType())))


@query("op10_sentence_pieces")
def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text again."""
    vocabulary = load_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, vocabulary, same="round_trip")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
