"""Words of many texts at once, as numpy arrays over Arrow buffers.

A word is a maximal run of bytes that are neither a space nor 0x09-0x0D, so it
is the same on UTF-8 bytes as on code points. Its hash is a polynomial over its
bytes modulo 2**64, taken from prefix sums and then mixed: no Python object is
made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: A block holds whole texts of so many bytes together, or one longer text.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: True where a code point begins.
LEADS = (np.arange(256) & 0xC0) != 0x80

_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + 1)
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > 8 * BLOCK_BYTES:  # one very long text: not worth keeping
            return made[0], made[1]
        _powers, _inverses = made
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@dataclass
class Block:
    """Some whole texts: their bytes, where each begins, and their words."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray  # of texts in data, one more than texts
    starts: np.ndarray  # of words in data
    ends: np.ndarray
    word_offsets: np.ndarray  # of texts in starts, one more than texts
    prefix: np.ndarray
    inverses: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the byte ranges."""
        h = (self.prefix[ends] - self.prefix[starts]) * self.inverses[starts]
        return mix(h ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def owners(self) -> np.ndarray:
        """The text, as an index into the block, of each word."""
        return np.repeat(np.arange(self.n), self.n_words)

    def sums(self, values: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
        """Of the values of each text; offsets: where each text's values begin."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return np.diff(total[self.offsets if offsets is None else offsets])


def block(data: np.ndarray, offsets: np.ndarray, rows: slice, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Block:
    if lower:
        data = LOWER[data]
    inside = ~separator[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    powers, inverses = _tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers[: len(data)], out=prefix[1:])
    return Block(rows, data, offsets, starts, ends, np.searchsorted(starts, offsets), prefix, inverses)


def blocks(texts: pa.Array, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Iterator[Block]:
    """The texts in order, as blocks; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
        yield block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], slice(at, to), lower, separator)
        at = to


def windows(hashes: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that lie in one text, and the index of each one's first word."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    size = len(hashes) - n + 1
    h = np.zeros(size, dtype=U64)
    for i in range(n):
        h = h * U64(0x9FB21C651E98DF25) + hashes[i : i + size]
    fits = np.ones(size, dtype=bool)
    for end in word_offsets[1:-1][np.diff(word_offsets)[:-1] > 0]:
        fits[max(0, end - n + 1) : end] = False
    at = np.flatnonzero(fits)
    return mix(h[at]), at


def sequences(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, of any lengths."""
    powers, inverses = _tables(len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * powers[: len(hashes)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverses[starts] ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))
