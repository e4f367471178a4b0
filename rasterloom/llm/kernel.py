"""Vectorised text kernels: whole Arrow batches as byte arrays, with numpy in place of loops over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: An odd multiplier, so it has an inverse modulo 2**64.
MULT = 0x9E3779B97F4A7C15 | 1
_ROLL = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(offsets) else whole[:0], offsets - (offsets[0] if len(offsets) else 0)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, other bytes as they are."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby inputs give unrelated outputs."""
    x = x.astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i for i <= n, modulo 2**64; kept between calls."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, m, U64)])) for m in (MULT, pow(MULT, -1, 1 << 64))]
    return _powers[0], _powers[1]


class Spans:
    """64-bit hashes of any spans of an array, from prefix sums of a random polynomial; of bytes, or of 64-bit values (whole)."""

    def __init__(self, data: np.ndarray, whole: bool = False):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data if whole else _ROLL[data]) * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * U64(MULT))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row and in all): maximal runs of bytes other than 32 and 9 to 13, cut at row ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = _SPACE[data]
    begin = ~blank
    begin[1:] &= blank[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] = ~blank[inner]
    starts = np.flatnonzero(begin)
    stop = blank.copy()
    stop[inner] = True
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, "right")]
    return starts, ends, np.searchsorted(starts, offsets, "left")


def member(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in a sorted table, whether it is there) of each key."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as compressed differences."""
    import zstandard

    steps = np.diff(keys.astype("<u8"), prepend=U64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel().astype(U64))
