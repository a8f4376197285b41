"""Whole-text features as numpy arrays over Arrow string buffers.

An Arrow column of texts is one UTF-8 buffer with offsets.  The helpers here lay
the texts of a small run of rows side by side, one space before, between and
after, and derive word bounds and 64-bit hashes of words and byte n-grams without a
Python loop over rows or words.  A run holds at most ``max_bytes`` of text, or
one longer text; no text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK64 = (1 << 64) - 1
RADIX = 0x9E3779B97F4A7C15 | 1
RADIX_INV = pow(RADIX, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2**64, kept per process and grown on demand."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text; a longer text is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


class Laid:
    """Texts laid side by side with spaces around each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.n = len(offsets) - 1
        self.buf = np.insert(data, offsets, 0x20)
        if lower:
            self.buf = LOWER[self.buf]
        rows = np.arange(self.n + 1)
        self.begin = (offsets + rows + 1)[:-1]  # of each text in buf
        self.end = (offsets + rows)[1:]
        self._prefix: np.ndarray | None = None

    def bounds(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal stretches where ``inside`` holds."""
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        return edge[::2], edge[1::2]  # buf starts and ends with a space

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.bounds(~SPACE[self.buf])

    def first_of(self, starts: np.ndarray) -> np.ndarray:
        """For each text, the index of its first word; one more entry at the end."""
        return np.append(np.searchsorted(starts, self.begin), len(starts))

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            out = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * _table("up", RADIX, len(self.buf)), out=out[1:])
            self._prefix = out
        return self._prefix

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes in [start, end), the same wherever they stand."""
        h = self.prefix()
        return mix((h[ends] - h[starts]) * _table("down", RADIX_INV, len(self.buf))[starts])


def char_grams(laid: Laid, space: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of characters inside words, word ends included: first byte, first byte of the
    second character, and bucket of each.  ``space`` has, for each byte, whether it parts words."""
    at = np.flatnonzero(laid.buf & 0xC0 != 0x80)  # where characters start
    ok = np.flatnonzero(inner_ok(space[at], n))
    ends = np.append(at, len(laid.buf))[ok + n]
    starts = at[ok]
    h = laid.prefix()
    key = (h[ends] - h[starts]) * _table("down", RADIX_INV, len(laid.buf))[starts]
    key = (key ^ (key >> np.uint64(29))) * np.uint64((0xBF58476D1CE4E5B9 * (2 * n + 1) & MASK64) | 1)
    return starts, at[ok + 1], (key >> np.uint64(64 - bits)).astype(np.intp)


def window_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive entries; entry i covers i .. i+k-1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        factor = np.uint64((pow(RADIX, 2 * j + 3, 1 << 64) | 1) & MASK64)
        out += hashes[j : j + n] * factor
    return mix(out)


def inner_ok(space: np.ndarray, n: int) -> np.ndarray:
    """Positions whose n characters have no space but at the ends: subwords with bounds."""
    m = len(space) - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    bad = np.zeros(m, bool)
    for j in range(1, n - 1):
        bad |= space[j : j + m]
    if n == 2:
        bad |= space[:m] & space[1 : 1 + m]
    return ~bad
