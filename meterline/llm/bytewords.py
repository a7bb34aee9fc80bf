"""Words of many texts at once: numpy over the UTF-8 bytes of a batch."""

from __future__ import annotations

import numpy as np

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x += _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are runs of anything but blanks.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: Words are runs of letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


class Words:
    """The words of `texts`: bytes `data` (A-Z lower-cased), word bounds `start` and `end`, 64-bit `hash`, and `first`, the
    number of the first word of each text (one more entry than texts)."""

    def __init__(self, texts: list[str | None], letters: np.ndarray):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.raw = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        self.text_start = 1 + np.concatenate([[0], np.cumsum(size + 1)])
        self.data = LOWER[self.raw]
        inside = letters[self.raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.text_start)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        total = int(size.sum())
        before = np.cumsum(size) - size
        at = np.arange(total) - np.repeat(before, size)  # place in the word
        code = (at.astype(np.uint64) << np.uint64(8)) | self.data[np.arange(total) + np.repeat(self.start - before, size)]
        return mix(np.add.reduceat(mix(code), before) ^ size.astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive words; fewer than k give none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += mix(hashes[j : j + n] + np.uint64(j * int(_M1) & 0xFFFFFFFFFFFFFFFF))
    return mix(total)


def hash_words(words: list[str]) -> np.ndarray:
    w = Words(["\n".join(words)], NOT_BLANK)
    return w.hash
