"""Words of whole Arrow columns as arrays: positions, hashes and hashes of word windows.

A batch is handled in slices of whole texts of about ``SLICE_BYTES``, so the arrays of a task stay small
however many rows a batch has; a longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
_BYTE_CODES = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of words after lower-casing A-Z: digits, a-z, and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

#: Lower-cases the letters A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as they have been asked for."""

    def __init__(self, base: int) -> None:
        self.bases = (base, pow(base, -1, 1 << 64))
        self.tables = tuple(np.ones(1, np.uint64) for _ in self.bases)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << max(12, (n - 1).bit_length())
            made = []
            for base in self.bases:
                steps = np.full(size, base & _MASK, np.uint64)
                steps[0] = 1
                made.append(np.multiply.accumulate(steps))
            self.tables = tuple(made)
        return self.tables[0][:n], self.tables[1][:n]


_byte_powers, _word_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text array (nulls count as empty) and the n + 1 places where its texts begin and end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each."""
    if len(texts) == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield start, end
        start, done = end, int(ends[end - 1])


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, the same wherever the bytes stand."""
    up, down = _byte_powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Words:
    """Words of the texts of one slice: byte ranges, the text that each belongs to, and hashes."""

    def __init__(self, texts: pa.Array, allowed: np.ndarray = ALNUM, fold: np.ndarray | None = LOWER) -> None:
        raw, self.bounds = text_bytes(texts)
        self.data = raw if fold is None else fold[raw]
        self.n_texts = len(texts)
        inside = allowed[self.data]
        edge = np.ones(len(inside) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[self.bounds] = True
        cuts = np.flatnonzero(edge)
        kept = np.zeros(0, np.int64) if len(cuts) < 2 else np.flatnonzero(inside[cuts[:-1]])
        self.starts = cuts[kept]
        self.ends = cuts[kept + 1] if len(kept) else cuts[:0]
        first = np.searchsorted(self.starts, self.bounds)
        #: The words of text i are first[i] .. first[i + 1] - 1.
        self.first = first
        self.counts = np.diff(first)
        self.text = np.repeat(np.arange(self.n_texts), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands."""
        return range_hashes(self.data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every window of ``n`` words within one text."""
        if len(hashes) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        up, down = _word_powers(len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=sums[1:])
        at = np.flatnonzero(self.text[n - 1 :] == self.text[: len(hashes) - n + 1])
        return mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n)), at

    def joined(self, first: int, n: int) -> bytes:
        """``n`` words from ``first`` on, with a space between them."""
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(first, first + n))
