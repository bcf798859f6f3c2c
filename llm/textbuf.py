"""Words, lines and window hashes of a whole Arrow batch of texts, as numpy arrays.

A string column is one byte buffer with offsets, so the texts of a batch are scanned together:
no Python code runs per word.  Batches are cut by bytes first, which bounds the arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned together; the arrays of one step are a few dozen times as large.
SCAN_BYTES = 2_000_000
#: Longest byte range that is hashed in steps of eight bytes.
STEPPED = 512

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


#: One 64-bit value per byte value.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def slices_by_bytes(batch: pa.RecordBatch, column: str, limit: int = SCAN_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most ``limit`` bytes of text, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Texts:
    """The texts of one column as bytes: ``data``, and where each text starts and ends in it."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        self.n = len(column)
        if lower:
            capital = (self.data >= 65) & (self.data <= 90)
            self.data = np.where(capital, self.data + 32, self.data).astype(np.uint8)

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Number of the text that holds each of the ascending byte positions."""
        return np.repeat(np.arange(self.n), np.diff(np.searchsorted(positions, self.bounds)))

    def counts(self, owners: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owners, weights=weights, minlength=self.n).astype(np.int64)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every maximal run of bytes that are not ASCII white space."""
        ink = ~_SPACE[self.data]
        starts, ends = ink.copy(), ink.copy()
        starts[1:] &= ~ink[:-1]
        ends[:-1] &= ~ink[1:]
        inner = self.bounds[:-1]
        inner = inner[inner < len(ink)]
        starts[inner] |= ink[inner]  # a word never runs over the end of a text
        last = self.bounds[1:] - 1
        last = last[last >= 0]
        ends[last] |= ink[last]
        first = np.flatnonzero(starts)
        return first, np.flatnonzero(ends) + 1, self.owner(first)

    def hashes(self) -> "RangeHash":
        return RangeHash(self.data)

    def hash_of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range, eight bytes a step with every step mixed; BLAKE2 for ranges above ``STEPPED``.

        Unlike a polynomial modulo 2**64 it has no strings of regular build that meet.
        """
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        size = ends - starts
        out = mixed(size.astype(np.uint64) * _BASE + _MIX1)
        left = np.flatnonzero((size > 0) & (size <= STEPPED))
        done = 0
        while len(left):
            rest = size[left] - done
            word = eight[starts[left] + done]
            short = rest < 8
            word[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
            out[left] = mixed((out[left] ^ word) * _BASE + _MIX2)
            done += 8
            left = left[rest > 8]
        for i in np.flatnonzero(size > STEPPED):
            digest = hashlib.blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = np.uint64(int.from_bytes(digest, "little"))
        return out


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    """Powers of the base (``up``) or of its inverse (``down``), 0 to n."""
    if len(_POWERS[kind]) <= n:
        out = np.full(max(n, SCAN_BYTES) + 1, _BASE if kind == "up" else _BASE_INVERSE, dtype=np.uint64)
        out[0] = 1
        _POWERS[kind] = np.cumprod(out)
    return _POWERS[kind]


class RangeHash:
    """Hash of any byte range in constant time, from running sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers("up", len(data))[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * _powers("down", len(self.sums))[starts]
        return mixed(value ^ ((ends - starts).astype(np.uint64) * _MIX2))
