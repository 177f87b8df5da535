"""The binary Golay [23, 12, 7] code as a fuzzy hash.

Every 23-bit word lies within 3 bits of exactly one codeword. A word's keys are the information bits of the codewords nearest to
the word itself and to its 23 neighbours at one bit: one key if the word is within 2 bits of its
codeword, six otherwise. Words at most two bits apart have a common neighbour (or are neighbours), and so share a key.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code.
GENERATOR = 0b110001110101
BITS = 23
KEYS = 6


def _remainder(x: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if x >> i & 1:
            x ^= GENERATOR << (i - 11)
    return x


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; for each syndrome the offsets to its codewords, and their number."""
    low = np.array([_remainder(i) for i in range(1 << 12)], np.int64)
    high = np.array([_remainder(i << 12) for i in range(1 << 11)], np.int64)
    leader = np.zeros(1 << 11, np.int64)
    for weight in range(4):
        for places in combinations(range(BITS), weight):
            e = sum(1 << p for p in places)
            leader[_remainder(e)] = e
    offsets, number = np.zeros((1 << 11, KEYS), np.int64), np.zeros(1 << 11, np.int64)
    for s in range(1 << 11):
        found = sorted({e ^ int(leader[s ^ _remainder(e)]) for e in [0, *(1 << i for i in range(BITS))]})
        offsets[s, : len(found)] = found
        offsets[s, len(found):] = found[0]
        number[s] = len(found)
    return low, high, offsets, number


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) keys of 12 bits and which of them count (the others repeat the first)."""
    low, high, offsets, number = tables()
    words = words.astype(np.int64)
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ offsets[syndrome]) >> 11, np.arange(KEYS)[None, :] < number[syndrome][:, None]
