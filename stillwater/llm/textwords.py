"""Words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PRIME = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2^64 for i < n; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 2 * len(have) if have is not None else 1), base, np.uint64)
        p[0] = 1
        _powers[base] = have = np.multiply.accumulate(p)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit sums over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Stretches:
    """Hashes of any stretch of a buffer, the same wherever and in whatever buffer it lies."""

    def __init__(self, data: np.ndarray):
        p = powers(PRIME, len(data) + 1)
        self.run = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], dtype=np.uint64)])
        self.back = powers(pow(PRIME, -1, 2**64), len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.run[end] - self.run[start]) * self.back[start])


class Words:
    """White-space separated words of a batch of texts (None: empty), with ASCII letters in lower case.

    ``raw`` and ``low`` start and end with a space and have one between texts. ``start``,
    ``end`` and ``doc`` have an entry per word, ``first`` one per text and one more.
    """

    def __init__(self, texts: list[bytes | None]):
        data = b" ".join([b"", *[t or b"" for t in texts], b""])
        self.raw = np.frombuffer(data, np.uint8)
        self.low = _LOWER[self.raw]
        space = _SPACE[self.raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
        begins = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
        self.first = np.searchsorted(self.start, begins)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self, symbols: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash per word of its lower-case bytes, or of other symbols in their places."""
        return Stretches(self.low if symbols is None else symbols).of(self.start, self.end)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start + length - 1 of every range, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def by_bytes(texts: list[bytes | None], most: int = 1 << 20):
    """(first, last) of runs of texts of about ``most`` bytes, so that arrays over them stay small."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
