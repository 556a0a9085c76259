"""Vectorised work on whole texts: numpy over the bytes of an Arrow string column.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``.  All hashes here are 64-bit and seeded by constants, so a
retried task gives the same values.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a single longer text makes a chunk of its own, and takes up to 100 times its bytes
#: in its task while its words are hashed.
CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True where a byte begins a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTE_CODE[SPACE] = 0
#: For a second hash of the same words, independent of the first.
OTHER_CODE = mix(BYTE_CODE ^ np.uint64(0xA0761D6478BD642F))
OTHER_CODE[SPACE] = 0
BYTE_BASE, OTHER_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xE7037ED1A0B428DB | 1, 0xD1342543DE82EF95 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n; kept up to the chunk size, longer ones made on demand."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@cache
def _trim() -> object | None:
    """The allocator's call that gives free memory back to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return freed memory to the system: workers live on, and would hold the largest batch of every stage."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


def chunks(column: pa.Array, most: int = CHUNK_BYTES, most_rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of whole texts of about ``most`` bytes, or ``most_rows``."""
    data, offsets = string_buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, row + most_rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


class Words:
    """Words of several texts: ``starts`` and ``ends`` in bytes, ``doc`` the text of each, ``first`` the number of
    words before each text (one entry more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begin[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets).astype(np.int64)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def take(self, good: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Words:
        """The words of some of the texts, which ``data`` and ``offsets`` have."""
        out, mine = object.__new__(Words), good[self.doc]
        out.data, out.offsets, out.counts = data, offsets, self.counts[good]
        out.first = np.concatenate([[0], np.cumsum(out.counts)])
        out.doc = np.repeat(np.arange(len(out.counts)), out.counts)
        shift = (offsets[:-1] - self.offsets[:-1][good])[out.doc]
        out.starts, out.ends = self.starts[mine] + shift, self.ends[mine] + shift
        return out

    def hashes(self, other: bool = False) -> np.ndarray:
        """One 64-bit hash for each word, over its bytes as they are; ``other`` gives an independent one."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        up, down = powers(OTHER_BASE if other else BYTE_BASE, len(self.data))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat((OTHER_CODE if other else BYTE_CODE)[self.data] * up, self.starts)
            return mix(sums * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def ngrams(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive entries of ``words`` (word hashes), whatever texts they lie in."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    base = (WORD_BASE + 2 * seed * 0x9E3779B97F4A7C15) % (1 << 64) | 1
    with np.errstate(over="ignore"):
        terms = mix(words ^ np.uint64(mix(np.array([seed + 1], np.uint64))[0])) if seed else words
        out = np.zeros(len(words) - n + 1, np.uint64)
        for j in range(n):  # Horner's rule
            out = out * np.uint64(base) + terms[j : len(words) - n + 1 + j]
        return mix(out)


def spans_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run words[start:end] of varying length."""
    up, down = powers(WORD_BASE, len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(x.view(np.int64))
