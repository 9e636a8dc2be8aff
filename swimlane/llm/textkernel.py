"""Vectorised kernels over Arrow string buffers.

Texts stay in their Arrow buffers as UTF-8 bytes; tokens are byte spans, and
their hashes come from one prefix sum per chunk, so no Python string is made
per token.  A token is a maximal run of bytes above 0x20; ASCII letters are
folded to lower case inside the hash table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RI = np.uint64(pow(int(_R), -1, 1 << 64))


def _table() -> np.ndarray:
    t = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    t[65:91] = t[97:123]
    return t


_TABLE = _table()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    if len(_POWERS.get("p", ())) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("p", _R), ("i", _RI)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array) -> pa.Array:
    """The column as an Arrow string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    n = len(array)
    _, off, data = array.buffers()
    if not n or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(off, dtype=np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o


class Chunk:
    """Some consecutive rows: their bytes and where each of them begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.rows, self._sums = len(offsets) - 1, None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, blind to the case of ASCII letters."""
        p, inv = _powers(len(self.data))
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * p[: len(self.data)], out=self._sums[1:])
        h = (self._sums[ends] - self._sums[starts]) * inv[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all tokens, in text order."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        solid = self.data > 32
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = solid
        after = np.empty(n + 1, bool)
        after[:n] = solid
        after[n] = False
        cut = self.offsets
        before[cut] = False  # a row begins: nothing before it counts
        after[cut] = False  # a row ended just before this byte
        starts = np.flatnonzero(solid & ~before[:n])
        ends = np.flatnonzero(solid & ~after[1:]) + 1
        return starts, ends

    def row_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, starts, side="right") - 1

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def chunks(array: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Rows in chunks of about ``most`` bytes; a longer row is a chunk by itself, never cut."""
    array = strings(array)
    data, off = buffers(array)
    i, n = 0, len(array)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n)
        yield Chunk(i, data[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def first_of_rows(rows: np.ndarray) -> np.ndarray:
    """Where each new row number begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, np.int64)
