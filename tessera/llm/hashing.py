"""Vectorised 64-bit hashes of words in a batch of texts."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = np.uint64(0x9E3779B97F4A7C55)
_powers = np.ones(1, np.uint64)

BLANKS = frozenset(b" \t\n\v\f\r")


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.Generator(np.random.Philox(key=20)).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)


VALUES = byte_values()


def plain_table() -> np.ndarray:
    """Words of the contracts: runs of bytes that aren't ASCII blanks, unchanged. Separators have value 0."""
    t = VALUES.copy()
    t[list(BLANKS)] = 0
    return t


def folded_table() -> np.ndarray:
    """Runs of ASCII letters and digits and of bytes from 128, in lower case."""
    t = np.zeros(256, np.uint64)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            t[b] = VALUES[ord(chr(b).lower()) if b < 128 else b]
    return t


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 256)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE), dtype=np.uint64)])
    return _powers[:n]


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """(hash, start byte, end byte, text index) of every word of the texts data[offs[i]:offs[i + 1]]."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    value = table[data]
    inside = value != 0
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if not len(starts):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    lens = ends - starts
    at = np.flatnonzero(inside)
    rank = np.arange(len(at)) - np.repeat(np.cumsum(lens) - lens, lens)
    value = value[at] * powers(int(lens.max()))[rank]
    h = np.add.reduceat(value, np.cumsum(lens) - lens)
    return mix(h + lens.astype(np.uint64)), starts, ends, np.searchsorted(offs, starts, side="right") - 1


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices of all spans, one after the other."""
    return np.arange(int(lens.sum())) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


def rehash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of the same words by another table; both together have 128 bits."""
    lens = ends - starts
    if not len(lens):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(lens) - lens
    at = spans(starts, lens)
    rank = np.arange(len(at)) - np.repeat(begin, lens)
    return mix(np.add.reduceat(table[data[at]] * powers(int(lens.max()))[rank], begin) + lens.astype(np.uint64))
