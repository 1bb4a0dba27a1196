"""Words of whole Arrow batches and their hashes, a slice of text at a time.

Everything here works on arrays: a batch's words are split and dictionary-encoded
by Arrow, hashed once per distinct word, and combined to n-gram or span hashes by
arithmetic modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that is worked on at once; bounds a worker's memory whatever the batch size.
SLICE_BYTES = 3 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xD6E8FEB86659FD93


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; base is odd."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a))
        have = _powers[base] = (out[0], out[1])
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


class Spans:
    """Hashes of any span of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        up, down = powers(base, len(values) + 1)
        self.up = up
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * down[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For start < end: the sum of values[t] * base**(end-1-t), mixed."""
        return mixed((self.sums[end] - self.sums[start]) * self.up[end - 1])


def bytes_hash(words: pa.Array, base: int = BASE) -> np.ndarray:
    """64-bit hash of each string; its bytes and its length count."""
    offsets, data = buffers(words)
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    first = offsets[0]
    spans = Spans(_BYTE[data[first : offsets[-1]]], base)
    start, end = offsets[:-1] - first, offsets[1:] - first
    size = (end - start).astype(np.uint64)
    out = np.zeros(len(words), np.uint64)
    some = end > start
    out[some] = spans.of(start[some], end[some])
    return mixed(out + size * np.uint64(BASE2))


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string array without nulls."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
    _, offsets, data = strings.buffers()
    if offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(offsets, kind)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


_state: dict[str, object] = {}


def held(name: str, make):
    """What a worker keeps between tasks for the operator it serves now; that of others goes."""
    if name not in _state:
        _state.clear()
        released()
        _state[name] = make()
    return _state[name]


def released() -> None:
    """Give memory that is free back to the system: workers live as long as the application."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


@dataclass
class Words:
    """The words of some texts: word i of text t is words[codes[starts[t] + i]]."""

    codes: np.ndarray
    words: pa.Array
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def hashes(self) -> np.ndarray:
        return bytes_hash(self.words)[self.codes]


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z to a-z; every other character stays as it is."""
    return pc.ascii_lower(texts)


def split_words(texts: pa.Array) -> Words:
    """Runs of other characters than space and \\x09-\\x0D; null texts have none."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    bounds = np.asarray(lists.offsets, np.int64) - (lists.offsets[0].as_py() if len(lists) else 0)
    real = size > 0
    starts = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])[bounds]
    if not real.all():
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    return Words(np.asarray(coded.indices, np.int64), coded.dictionary, starts)


def column_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A column of a batch, or of the struct own that carries whole rows."""
    if column in batch.schema.names:
        return batch.column(column)
    return pc.struct_field(batch.column("own"), column)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about limit bytes of text each."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(column_of(batch, column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)
    released()


def position_in_text(starts: np.ndarray) -> np.ndarray:
    """For every word its index within its text."""
    counts = np.diff(starts)
    return np.arange(starts[-1], dtype=np.int64) - np.repeat(starts[:-1], counts)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
