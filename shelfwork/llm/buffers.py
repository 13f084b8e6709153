"""Vectorised helpers over Arrow string columns: bytes, words, word hashes and shingles without per-row Python.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A batch is cut into blocks of about this many bytes, so that temporary arrays stay small; one row is the least.
BLOCK = 1 << 21
ROWS = 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All but ASCII letters, digits and the bytes of other characters.
NOT_ALNUM = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])

_RNG = np.random.default_rng(20240611)
#: A random 64-bit value for each byte.
BYTE_VALUE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.ones(0, dtype=np.uint64)


def factors(n: int) -> np.ndarray:
    """An odd number for each of ``n`` places. They aren't the powers of one number, for which some texts of powers of two
    in length (Thue-Morse words) have the same sums."""
    global _FACTORS
    if len(_FACTORS) < n:
        place = np.arange(max(n, 256, 2 * len(_FACTORS)), dtype=np.uint64)
        _FACTORS = mix(place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    return _FACTORS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copies; null counts as empty. offsets[0] may be above 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about ``most`` bytes and at most ROWS rows."""
    data, at = raw(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        end = min(end, n, row + ROWS)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the non-empty segments, ready for ``reduceat``; their indices are ``flatnonzero(lengths)``."""
    starts = np.cumsum(lengths) - lengths
    full = lengths > 0
    return starts[full], lengths[full]


def sums(values: np.ndarray, lengths: np.ndarray, dtype=None) -> np.ndarray:
    """Sum of each segment; 0 for an empty one."""
    out = np.zeros(len(lengths), dtype=dtype or values.dtype)
    starts, _ = segments(lengths)
    if len(starts):
        out[lengths > 0] = np.add.reduceat(values, starts, dtype=dtype or values.dtype)
    return out


class Words:
    """The words of a block: ``start``/``length`` in bytes, ``per_row`` counts and 64-bit ``hash`` of the lower-cased word."""

    __slots__ = ("start", "length", "per_row", "hash", "lower")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashed: bool = True, apart: np.ndarray = SPACE, fold: bool = True, kinds: np.ndarray | None = None):
        """``apart`` marks the bytes between words; ``fold`` lower-cases A-Z. With ``kinds`` (1, 2 or 0 for each byte) words
        end also where a byte of kind 1 is beside one of kind 2."""
        n = len(data)
        space = apart[data]
        before = np.empty(n, dtype=bool)
        before[1:] = space[:-1]
        after = np.empty(n, dtype=bool)
        after[:-1] = space[1:]
        lengths = np.diff(offsets)
        edges = offsets[:-1][lengths > 0]
        before[edges] = True
        after[offsets[1:][lengths > 0] - 1] = True
        if kinds is not None:
            own = kinds[data]
            change = (own[1:] ^ own[:-1]) == 3
            before[1:] |= change
            after[:-1] |= change
        inside = ~space
        self.start = np.flatnonzero(inside & before)
        self.length = np.flatnonzero(inside & after) + 1 - self.start
        self.per_row = np.diff(np.searchsorted(self.start, offsets))
        self.lower = LOWER[data] if fold else data
        self.hash = self._hashes(inside) if hashed else None

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        body = self.lower[inside]
        first = np.cumsum(self.length) - self.length
        factor, out = factors(int(self.length.max())), np.empty(len(first), np.uint64)
        # some megabytes at a time: a byte takes 24 here
        cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(body), BLOCK)), len(first)))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            start, end = int(first[a]), int(first[b]) if b < len(first) else len(body)
            at = np.arange(start, end) - np.repeat(first[a:b], self.length[a:b])
            out[a:b] = np.add.reduceat(BYTE_VALUE[body[start:end]] * factor[at], first[a:b] - start)
        return mix(out)

    def text(self, i: int) -> bytes:
        return self.lower[self.start[i] : self.start[i] + self.length[i]].tobytes()


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, per row) of runs of ``width`` words. A row of fewer words, but at least one, has one shingle of all of them."""
    h, per_row = words.hash, words.per_row
    step = np.resize(_STEP, width) + np.arange(width, dtype=np.uint64) * np.uint64(2)
    count = np.where(per_row >= width, per_row - width + 1, (per_row > 0).astype(np.int64))
    if not len(h):
        return np.zeros(0, np.uint64), count
    first = np.cumsum(per_row) - per_row
    padded = np.concatenate([h, np.zeros(width - 1, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    for k in range(width):
        total += padded[k : k + len(h)] * step[k]
    at = np.arange(len(h)) - np.repeat(first, per_row)
    keep = at < np.repeat(count, per_row)
    short = (per_row > 0) & (per_row < width)
    if short.any():  # their sum must not reach into the next row
        rows = np.flatnonzero(short)
        which = np.repeat(short, per_row)
        partial = h[which] * step[at[which]]
        total[first[rows]] = sums(partial, per_row[rows]) + per_row[rows].astype(np.uint64)
    return mix(total[keep]), count


def sequence_hash(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's whole word sequence (0 for a row without words)."""
    h, per_row = words.hash, words.per_row
    if not len(h):
        zero = np.zeros(len(per_row), np.uint64)
        return zero, zero.copy()
    first = np.cumsum(per_row) - per_row
    at = np.arange(len(h)) - np.repeat(first, per_row)
    p = factors(int(per_row.max()) + 1)[at]
    return sums(h * p, per_row), sums(mix(h + np.uint64(0x632BE59BD9B4E019)) * p, per_row)
