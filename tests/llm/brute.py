"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def suffix(docs, length):
    first, out = {}, {}
    for k, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s: s + length]
            first[w] = min(first.get(w, k), k)
    for k, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s: s + length]] < k:
                gone[s: s + length] = [True] * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(b), len(b) - len(left), spans, sha(left))
    return out


def passages(docs, length):
    w = {k: words(t) for k, t in docs}
    count = Counter(tuple(x[s: s + length]) for x in w.values() for s in range(len(x) - length + 1))
    out = {}
    for k, x in w.items():
        gone = [False] * len(x)
        for s in range(len(x) - length + 1):
            if count[tuple(x[s: s + length])] > 1:
                gone[s: s + length] = [True] * length
        left = [y for y, g in zip(x, gone) if not g]
        out[k] = (len(x), len(x) - len(left), sha(" ".join(left).encode()))
    return out


def crc(ids):
    import numpy as np

    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def components(fps, limit):
    """Smallest key reachable over fingerprints that differ in at most ``limit`` bits."""
    keys = list(fps)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= limit:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    least = {}
    for k in keys:
        least[find(k)] = min(k, least.get(find(k), k))
    return {k: least[find(k)] for k in keys}


def overlaps(docs, items, window, share, least):
    """(document, item): first covered word and number of covered words, over every alignment."""
    fold = [["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[0-9A-Za-z\\x80-\U0010ffff]+", t or "")] for t in docs]
    asked = [["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[0-9A-Za-z\\x80-\U0010ffff]+", t or "")] for t in items]
    out = {}
    for i, x in enumerate(fold):
        for j, y in enumerate(asked):
            n, m = len(x), len(y)
            if not n or not m:
                continue
            size, part = (m, 1.0) if m < least else (min(window, m), share)
            hit = [False] * n
            for shift in range(size - m, n - size + 1):
                lo, hi = max(0, shift), min(n, m + shift)
                same = [x[k] == y[k - shift] for k in range(lo, hi)]
                for k in range(len(same) - size + 1):
                    if sum(same[k: k + size]) >= part * size - 1e-9:
                        hit[lo + k: lo + k + size] = [True] * size
            if any(hit):
                out[i, j] = (hit.index(True), sum(hit))
    return out
