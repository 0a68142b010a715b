"""Walking through Arrow batches of texts in small steps, and a growing store of id lists."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at once.
STEP_BYTES = 2_000_000

_MULTIPLY = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_MULTIPLY[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MULTIPLY[1])
    x ^= x >> np.uint64(31)
    return x


def mixed_int(x: int) -> int:
    x &= _MASK
    x = ((x ^ (x >> 30)) * _MULTIPLY[0]) & _MASK
    x = ((x ^ (x >> 27)) * _MULTIPLY[1]) & _MASK
    return x ^ (x >> 31)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b if b is not None else b"" for b in column.cast(kind).to_pylist()]


def steps(
    batches: Iterator[pa.RecordBatch], text_col: str = "text", each: int = STEP_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts, of at most `each` bytes (a longer text alone)."""
    for batch in batches:
        texts = as_bytes(batch.column(batch.schema.get_field_index(text_col)))
        first = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > each:
                yield batch.slice(first, i - first), texts[first:i]
                first, size = i, 0
            size += len(t)
        if first < len(texts):
            yield batch.slice(first), texts[first:]


class Kinds:
    """Distinct words of a step: their bytes one after the other, where each ends, and how long it is."""

    def __init__(self, column: pa.Array) -> None:
        self.column = column.cast(pa.binary())
        _, offsets, raw = self.column.buffers()
        bounds = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        self.raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.ends, self.sizes = bounds[1:], np.diff(bounds)

    def words(self) -> list[bytes]:
        raw, ends = self.raw.tobytes(), self.ends.tolist()
        return [raw[b - n : b] for b, n in zip(ends, self.sizes.tolist(), strict=True)]


def word_steps(
    batches: Iterator[pa.RecordBatch], text_col: str = "text", each: int = STEP_BYTES, lower: bool = True
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, Kinds]]:
    """Slices of the batches as `steps` gives them, with their words (with `lower`, A-Z in lower case): the number
    of words per text, each word's place among the distinct words, and those."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + each, side="right")))
            part = texts.slice(first, last - first)
            lists = pc.ascii_split_whitespace(pc.ascii_lower(part) if lower else part)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            kinds, which = Kinds(coded.dictionary), coded.indices.to_numpy().astype(np.int64)
            # white space at either end of a text leaves an empty word there
            some = kinds.sizes[which] > 0
            upto = np.concatenate([[0], np.cumsum(some)])
            yield batch.slice(first, last - first), np.diff(upto[offsets - offsets[0]]), which[some], kinds
            first = last


_HELD: dict = {}


def held(key, make):
    """What a worker process remembers under `key`, made if need be.  Workers are used again by
    later tasks of other operators, so only the last key's memory is kept."""
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def forget() -> None:
    """Drops what this worker remembers, and gives memory that is free back to the system."""
    _HELD.clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Gives memory that is free back to the system: the C library and Arrow keep it otherwise, in every worker
    beside the JVM.  Tasks go to waiting workers in turn, so more workers keep memory than tasks run at once."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def done_with_held() -> None:
    """For tasks that need nothing of what earlier ones remember."""
    if _HELD:
        forget()


class IdStore:
    """Lists of small integers, appended one after the other and gathered many at once."""

    def __init__(self, kind: type = np.int32) -> None:
        self.flat = np.empty(1 << 16, kind)
        self.starts = np.empty(1 << 14, np.int64)
        self.sizes = np.empty(1 << 14, np.int64)
        self.n = self.used = 0

    def add(self, ids: list[int]) -> int:
        self.add_all(np.array(ids, np.int32), np.array([len(ids)]))
        return self.n - 1

    def add_all(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Append lists that lie one after the other in `ids`."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(ends) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty(len(self.starts), np.int64)])
            self.sizes = np.concatenate([self.sizes, np.empty(len(self.sizes), np.int64)])
        self.flat[self.used : self.used + len(ids)] = ids
        if not len(ends):
            return
        begins = np.concatenate([[0], ends[:-1]])
        self.starts[self.n : self.n + len(ends)] = begins + self.used
        self.sizes[self.n : self.n + len(ends)] = ends - begins
        self.used += len(ids)
        self.n += len(ends)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers, concatenated, and where each begins (with the end)."""
        sizes = self.sizes[which]
        ends = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        return self.flat[np.repeat(self.starts[which] - ends[:-1], sizes) + np.arange(ends[-1])], ends
