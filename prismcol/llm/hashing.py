"""Word and shingle hashes of whole texts in numpy, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
PIECE = 1 << 20  # bytes that are hashed together
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


class Words:
    """Splits UTF-8 into words at the given bytes, lower-cases A-Z, and hashes each word to 64 bits.

    A word's hash is a polynomial in BASE over a table of byte values, from differences of running sums, so
    a piece is hashed without a loop over its words.
    """

    def __init__(self, breaks: bytes) -> None:
        self.breaks = np.zeros(256, bool)
        self.breaks[list(breaks)] = True
        byte = np.arange(256, dtype=np.uint64)
        byte[65:91] += np.uint64(32)
        self.values = mix(byte * np.uint64(BASE) + np.uint64(1))
        self.up, self.down = self._powers(PIECE + 1)

    @staticmethod
    def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(BASE, -1, 1 << 64)
        out = []
        for b in (BASE, inverse):
            x = np.full(n, np.uint64(b), np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        return out[0], out[1]

    def hashes(self, text: memoryview | bytes) -> np.ndarray:
        data = np.frombuffer(text, np.uint8)
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            if end < len(data):  # a piece ends at a break; a longer word is taken whole
                cut = np.flatnonzero(self.breaks[data[at:end]])
                while not len(cut) and end < len(data):
                    start, end = end, min(len(data), end + PIECE)
                    cut = np.flatnonzero(self.breaks[data[start:end]]) + (start - at)
                end = at + int(cut[-1]) + 1 if len(cut) else len(data)
            out.append(self._piece(data[at:end]))
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def _piece(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self.up, self.down = self._powers(len(data) + 1)
        inside = np.empty(len(data) + 2, np.int8)
        inside[0] = inside[-1] = 0
        np.logical_not(self.breaks[data], out=inside[1:-1].view(bool))
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=run[1:])
        return mix((run[end] - run[start]) * self.down[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words, in their order; with fewer words, but not none, one for all of them."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(BASE) + words[k : k + n])
    return out


def utf8(column: pa.Array) -> Iterator[memoryview | None]:
    """The bytes of each text of an Arrow string column, without copies."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield None if valid is not None and not valid[i] else view[at[i] : at[i + 1]]
