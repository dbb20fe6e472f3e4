"""Words of texts as 64-bit hashes, and polynomial hashes of runs of words, in numpy."""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that their powers have inverses modulo 2^64
_M = np.uint64(0xBF58476D1CE4E5B9)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class WordHashes(dict):
    """word -> XXH64 under a seed, remembered until ``most`` words are held."""

    def __init__(self, seed: int, most: int = 1 << 19):
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1 << 12, 1 << int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = tuple(out)
    return _powers[base]


def prefix_polynomials(h: np.ndarray, which: int = 0) -> np.ndarray:
    """P with P[i] = sum of h[j] * base^j for j < i, modulo 2^64."""
    up = _power(_BASES[which], len(h) + 1)[0]
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=out[1:])
    return out


def run_hashes(prefix: np.ndarray, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of the n words from each position of ``at``: the same for the same words wherever they stand."""
    down = _power(_BASES[which], len(prefix))[1]
    x = (prefix[at + n] - prefix[at]) * down[at] + np.uint64(n)
    x = (x ^ x >> np.uint64(30)) * _M
    return x ^ x >> np.uint64(31)
