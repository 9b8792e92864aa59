"""Hashes of word sequences, many at once."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ORDER = 2**64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of an odd number and of its inverse, both modulo 2 ** 64, as far as asked for."""

    def __init__(self, which: int = 0):
        self.base = _BASE[which]
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        self.up, self.down = _powers(self.base, n), _powers(pow(self.base, -1, _ORDER), n)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        if len(h) >= len(self.up):
            self.grow(2 * len(h) + 1)
        return np.concatenate([np.zeros(1, _U), np.cumsum(h * self.up[: len(h)], dtype=_U)])

    def spans(self, prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from a to b (b not included)."""
        return (prefix[b] - prefix[a]) * self.down[a]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of h over all."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width values in a row."""
    done = 1
    out = x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
