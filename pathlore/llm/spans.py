"""Vectorised hashing of bytes and words over batches of texts (numpy only, no per-word Python)."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
BYTE_HASH = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_HASH = BYTE_HASH.copy()
LOWER_HASH[65:91] = BYTE_HASH[97:123]
BASE = U64(0x9E3779B97F4A7C15)
WORD_BASE = U64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def ngram_hash(h: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hash of every ``k`` consecutive values, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, part, size, power = None, 0, h, 1, base
    while True:
        if k & size:  # append a part of ``size`` values behind what is done
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * power + piece
            done += size
        if done == k:
            return mix(out)
        part = part[:-size] * power + part[size:]
        power = U64((int(power) * int(power)) & 0xFFFFFFFFFFFFFFFF)
        size *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    if len(h) < w:
        return np.empty(0, dtype=h.dtype)
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = w - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


class Texts:
    """Texts of one batch as UTF-8: ``data`` and the ``n + 1`` offsets into it. Null is empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        _, offsets, data = column.buffers()
        n, at = len(column), column.offset
        self.offsets = np.frombuffer(offsets, dtype=np.int64)[at : at + n + 1].copy() if n else np.zeros(1, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
        self.data = raw[self.offsets[0] : self.offsets[-1]]
        self.offsets -= self.offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def slices(self, most: int) -> list[tuple[int, int]]:
        """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
        out, i = [], 0
        while i < len(self):
            j = int(np.searchsorted(self.offsets, self.offsets[i] + most, side="right")) - 1
            j = max(i + 1, min(j, len(self)))
            out.append((i, j))
            i = j
        return out


def row_slices(column: pa.Array, most: int) -> list[tuple[int, int]]:
    """Row ranges of a string column of about ``most`` bytes; a longer text is a range of its own."""
    size = np.append(0, np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)))
    out, lo = [], 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most, side="right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts between ``offsets``.

    Returns word starts, word ends, the index of each text's first word (``n + 1`` values) and
    a 64-bit hash of each word (A-Z counts as a-z with ``lower``).
    """
    n = len(data)
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64), np.empty(0, dtype=np.uint64)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begins[edges] |= inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, first, np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    flat = np.flatnonzero(inside)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), BASE, dtype=np.uint64))
    value = (LOWER_HASH if lower else BYTE_HASH)[data[flat]] * powers[within]
    return starts, ends, first, mix(np.add.reduceat(value, np.cumsum(lengths) - lengths))


def pack(*arrays: np.ndarray, level: int | None = None) -> bytes:
    """Arrays in one binary value, compressed with zstd if ``level`` is given."""
    head = [struct.pack("<I", len(arrays))]
    for a in arrays:
        kind = a.dtype.str.encode()
        head.append(struct.pack("<B", len(kind)) + kind + struct.pack("<Q", a.nbytes))
    raw = b"".join(head + [np.ascontiguousarray(a).tobytes() for a in arrays])
    return raw if level is None else zstandard.ZstdCompressor(level=level).compress(raw)


def unpack(raw: bytes, compressed: bool = False) -> list[np.ndarray]:
    if compressed:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    raw = memoryview(raw)
    (count,), at, kinds, out = struct.unpack_from("<I", raw), 4, [], []
    for _ in range(count):
        size = raw[at]
        kind = bytes(raw[at + 1 : at + 1 + size]).decode()
        (nbytes,) = struct.unpack_from("<Q", raw, at + 1 + size)
        kinds.append((np.dtype(kind), nbytes))
        at += 9 + size
    for kind, nbytes in kinds:
        out.append(np.frombuffer(raw, dtype=kind, count=nbytes // kind.itemsize, offset=at))
        at += nbytes
    return out
