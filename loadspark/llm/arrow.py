"""Record batches in slices of bounded text, and columns of flat lists, for functions that turn texts into ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 19
#: Bytes that a remembered entry takes beside its key and value.
ENTRY_BYTES = 160
#: Strings put together at once.
JOINED = 1 << 14


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold at most `limit` bytes of `column`, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


def list_column(flat: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """One list per length, from their values one after another."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns added behind; columns of these names are left out of it."""
    kept = [n for n in batch.schema.names if n not in added]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *added.values()], names=[*kept, *added])


class Strings:
    """Byte strings by id in one buffer, to be put one after another."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.lengths = np.array(list(map(len, strings)), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def joined(self, ids: np.ndarray) -> bytes:
        """The strings of all ids, one after another."""
        return b"".join([self._some(ids[at : at + JOINED]) for at in range(0, len(ids), JOINED)])

    def _some(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.data[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()


class Memo(dict):
    """Values made on demand; all are forgotten when keys and values pass `limit` bytes, long keys are never kept."""

    def __init__(self, make: Callable[[str], bytes], limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.used = make, limit, longest, 0

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= self.longest:
            self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        size = len(key) + len(value) + ENTRY_BYTES
        if self.used + size > self.limit:
            self.clear()
            self.used = 0
        self.used += size
        self[key] = value
