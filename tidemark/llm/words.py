"""Words and word sequences of many texts as arrays of 64-bit hashes, without a Python object a word.

A word is a run of bytes other than space and 0x09-0x0D (or other gaps). Its hash is the sum of its bytes, each times
a random number for its place in the word (multilinear hashing: words that differ agree with a probability of 2**-56
at most, whatever their letters are; a polynomial has whole families of words that agree). A sequence's hash is a
polynomial over its words' hashes, built by doubling; beyond 16 words each doubling is mixed again, as long
polynomials modulo a power of two have such families too. Bytes are hashed in pieces, so a text of any length
needs some 10 bytes of memory a byte beside what is kept for its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

Q, WRAP = 0xD6E8FEB86659FD93, (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True

SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
PIECE = 1 << 19  # bytes that are hashed at once


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def at_places(n: np.ndarray, seed: int) -> np.ndarray:
    """The random numbers of these places in a word."""
    return mix(mix(n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))) | np.uint64(1)


SEEDS = (20240229, 0xA0761D6478BD642F)
NEAR = [at_places(np.arange(256), s) for s in SEEDS]
VALUE = np.arange(1, 257, dtype=np.uint64)
LOWER = VALUE.copy()
LOWER[65:91] = VALUE[97:123]


class Texts:
    """The words of a slice of texts (nulls count as empty): hash, text, and place in the bytes.

    ``twin``: each word also gets a second hash that is independent of the first.
    """

    def __init__(self, column: pa.Array, lower: bool = False, gaps: np.ndarray = SPACE, twin: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.n, self.data, self.offsets = n, data, offsets
        inside = ~gaps[data]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[edges] |= inside[edges]
        self.begin = np.flatnonzero(begins)
        stops = begins
        stops[:] = inside
        stops[:-1] &= ~inside[1:]
        stops[edges - 1] |= inside[edges - 1]
        self.stop = np.flatnonzero(stops) + 1
        del begins, stops
        value = LOWER if lower else VALUE
        self.hash, self.twin = self._hashes(inside, value, 0), self._hashes(inside, value, 1) if twin else None
        self.text = np.searchsorted(offsets, self.begin, side="right") - 1
        self.words = np.bincount(self.text, minlength=n)  # of each text
        self.first = np.cumsum(self.words) - self.words

    def _hashes(self, inside: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
        """Sums are added up piece by piece, so a piece may end inside a word."""
        total = (self.stop - self.begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for a in range(0, len(inside), PIECE):
            b = min(a + PIECE, len(inside))
            lo, hi = np.searchsorted(self.stop, a, side="right"), np.searchsorted(self.begin, b)
            if lo == hi:
                continue
            start = self.begin[lo:hi]
            size = np.minimum(self.stop[lo:hi], b) - np.maximum(start, a)
            where = np.flatnonzero(inside[a:b])
            nth = where + a
            nth -= np.repeat(start, size)
            if int(nth.max()) < 256:
                times = NEAR[k][nth]
            else:
                times = NEAR[k][np.minimum(nth, 255)]
                far = np.flatnonzero(nth > 255)
                times[far] = at_places(nth[far], SEEDS[k])
            times *= value[self.data[a:b][where]]
            total[lo:hi] += np.add.reduceat(times, np.cumsum(size) - size)
        return mix(total)

    def sequences(self, n: int, twin: bool = False) -> np.ndarray:
        """Hashes of all sequences of ``n`` words, also of those that cross texts (see ``whole``)."""
        block = self.twin if twin else self.hash
        total = len(block)
        if total < n:
            return np.empty(0, np.uint64)
        done, out, size = 0, np.zeros(total, np.uint64), 1
        factor, scale = Q, 1
        while True:
            if n & size:
                out[: total - done] += block[done:] * np.uint64(scale)
                done += size
                scale = scale * factor & WRAP
            if 2 * size > n:
                return mix(out[: total - n + 1])
            shifted = np.zeros(total, np.uint64)
            shifted[: total - size] = block[size:]
            shifted *= np.uint64(factor)
            shifted += block
            block = mix(shifted) if size >= 16 else shifted
            factor, size = factor * factor & WRAP, 2 * size

    def whole(self, n: int) -> np.ndarray:
        """Of each such sequence whether it lies in one text."""
        return self.text[: len(self.text) - n + 1] == self.text[n - 1 :]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size, block = 1, values
    while 2 * size <= width:
        block = np.minimum(block[:-size], block[size:])
        size *= 2
    return block if size == width else np.minimum(block[: len(block) - (width - size)], block[width - size :])
