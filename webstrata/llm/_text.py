"""Vectorised work on batches of UTF-8 texts, shared by the operators of this subpackage.

A batch is one flat byte array and the offsets of its texts. Words are maximal
runs of the bytes that a 256-entry table marks, so no Python object is made per
word. Word hashes are 64-bit; they depend on the word alone, not on its place.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are taken in pieces of about this many bytes, so a worker's memory is
#: bounded by this or by the longest single text.
SLICE_BYTES = 2 << 20
LONG_WORD = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW: dict[str, np.ndarray] = {}


def byte_table(pattern: str) -> np.ndarray:
    """256 flags: which bytes a class of one-byte characters holds; all bytes from 0x80 on are in it."""
    import re

    table = np.zeros(256, bool)
    rx = re.compile(pattern)
    for b in range(128):
        table[b] = bool(rx.fullmatch(chr(b)))
    table[128:] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between white space: `[^\x20\x09-\x0D]+`.
SPACED = byte_table(r"[^\x20\x09-\x0D]")
#: Words of letters and digits: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
ALNUM = byte_table(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def tidy() -> None:
    """Gives freed memory back, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library can
        pass


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` text bytes each; one row at least."""
    if not batch.num_rows:
        return
    _, offs = flat(batch.column(batch.schema.get_field_index(name)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    tidy()


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many come before each text (len(texts) + 1)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = table[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    inner = offs[(offs > 0) & (offs < n)]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good low and high bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if "up" not in _POW or len(_POW["up"]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for key, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
                steps = np.full(size, np.uint64(base))
                steps[0] = 1
                _POW[key] = np.multiply.accumulate(steps)
    return _POW["up"], _POW["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            if ends[i] - starts[i] >= LONG_WORD:
                out[i] = np.uint64(xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes()))
                i += 1
                continue
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + 2 * LONG_WORD, "right")))
            seg = data[base : int(ends[j - 1])]
            up, down = powers(len(seg))
            sums = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum((seg.astype(np.uint64) + np.uint64(1)) * up[: len(seg)], out=sums[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
    return out


def window_hashes(hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of `width` neighbours; shorter than the input by width - 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, np.uint64(width + salt))
    with np.errstate(over="ignore"):
        for k in range(width):
            acc = acc * _BASE + hashes[k : k + n]
    return mix(acc)


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Counts:
    """Counts of 64-bit keys, gathered batch by batch; sorted by key."""

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Adds distinct sorted keys; tells which of them are new."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.n[at[known]] += n[known]
        fresh = ~known
        if fresh.any():
            place = np.searchsorted(self.keys, keys[fresh])
            self.keys, self.n = np.insert(self.keys, place, keys[fresh]), np.insert(self.n, place, n[fresh])
        return fresh

    def drain(self, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """Batches (h, n) of all that was gathered; begins anew."""
        for at in range(0, len(self.keys), rows):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[at : at + rows].view(np.int64)), pa.array(self.n[at : at + rows])], ["h", "n"])
        self.__init__()


def look_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its place among sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, values), max(len(keys) - 1, 0))
    return at, (keys[at] == values if len(keys) else np.zeros(len(values), bool))
