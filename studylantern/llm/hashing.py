"""Hashes of words and word sequences, for whole batches of texts at once. Arithmetic is modulo 2^64."""

from __future__ import annotations

import numpy as np

WORD_BASE, RUN_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
#: The white space of a word pattern, and the multipliers of the splitmix generator.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64: each result bit depends on all bits of x."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_HASH = mix(np.arange(256, dtype=np.uint64) + np.uint64(977))
_INVERSE = {int(b): np.uint64(pow(int(b), -1, 2**64)) for b in (WORD_BASE, RUN_BASE)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Windows:
    """Hashes of stretches [first, last) of one long sequence of symbols, each from two prefix sums."""

    def __init__(self, symbols: np.ndarray, base: np.uint64 = RUN_BASE):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(symbols * powers(base, len(symbols))[:-1], dtype=np.uint64)))
        self.back = powers(_INVERSE[int(base)], len(symbols))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(np.uint64))

    def runs(self, size: int) -> np.ndarray:
        """Hashes of all stretches of `size` symbols, as `of` gives them."""
        found = self.sums[size:] - self.sums[:-size]
        found *= self.back[: len(found)]
        found += np.uint64(size)
        return mix(found)


class Words:
    """The words of several texts: start and end byte of each word, its hash, and for each text its range of words."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        space = np.zeros(256, bool)
        space[list(SPACE_BYTES)] = True
        inside = ~space[data]
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        first = inside & (~before | cut[:-1])
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.bounds = np.searchsorted(self.start, at)
        windows = Windows(BYTE_HASH[data], WORD_BASE)
        self.hash = windows.of(self.start, self.end)
        self.runs = Windows(self.hash)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words in text order and the n + 1 bounds by text; a shorter text is one run of all its words."""
        counts = np.diff(self.bounds)
        own = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        bounds = np.concatenate(([0], np.cumsum(own)))
        first = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - self.bounds[:-1], own)
        last = np.minimum(first + size, np.repeat(self.bounds[1:], own))
        return self.runs.of(first, last), bounds
