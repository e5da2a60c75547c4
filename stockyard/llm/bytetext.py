"""Words and hashes of many texts at once, on the UTF-8 bytes of an Arrow column.

White space here is [\\x20\\x09-\\x0D], all single bytes, so splitting bytes is splitting code points. Hashes are polynomials modulo
2**64 over the bytes of a segment, read off prefix sums, then mixed; equal segments have equal hashes in every task and run.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers of the two polynomials; they have inverses modulo 2**64.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Values hashed with one table of powers: all tables of a worker hold 4 x BLOCK numbers (4 MB), however long a text is.
BLOCK = 1 << 17


@functools.lru_cache(maxsize=2)
def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below BLOCK."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        x = np.full(BLOCK, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def segments(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each segment; its length counts too. Starts and ends rise; memory is of the segments and one block of values."""
    up, down = powers(base)
    before, after, back = (np.zeros(len(starts), np.uint64) for _ in range(3))
    total, scale, unscale = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.ones(1, np.uint64)
    step, unstep = up[-1:] * np.uint64(base), down[-1:] * np.uint64(pow(base, -1, 1 << 64))
    for lo in range(0, len(values) + 1, BLOCK):
        part = values[lo : lo + BLOCK].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        # Sums before the positions lo .. lo + BLOCK - 1, in powers of the whole.
        for at, to in ((starts, before), (ends, after)):
            a, b = np.searchsorted(at, (lo, lo + BLOCK))
            to[a:b] = total + sums[at[a:b] - lo] * scale
            if at is starts:
                back[a:b] = down[at[a:b] - lo] * unscale
        total, scale, unscale = total + sums[-1:] * scale, scale * step, unscale * unstep
    return mix((after - before) * back + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about `most` bytes, one row at least; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and len(column) else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (and one past the last)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    opens[inner] = solid[inner]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | opens[1:]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def points_before(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
