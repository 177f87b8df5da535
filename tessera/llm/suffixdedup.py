"""Suffix-array deduplication of byte strings by a common-prefix-aware distributed merge sort.

What is sorted are the suffixes of the records' texts from their anchors on (see ``repeats``). Each block sorts its own, sends
every range a front-coded run (length shared with the suffix before, and the rest), and the range merges the runs with a loser
tree whose nodes carry the length they share with the last winner: keys that share less lose without
a look at their bytes, and equal ones are compared from that length on. The merged order and its common-prefix lengths
give the classes of equal windows; each class's smallest doc_id keeps its bytes. Equal records of a block are one key with several places.

Removed is every byte covered by a ``length``-byte string that also starts in a document with a smaller doc_id, judged on the input.

Defined results: null and empty texts lose nothing (null counts as empty); a null doc_id comes after all others; rows that share a
doc_id count as one document and don't remove each other's bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from tessera.llm.common import documents
from tessera.llm.repeats import HOT, Block, Shape, cover, pack_runs, range_of, remove_repeats, squeeze, unpack_arrays, windows_to_remove


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be at least ``at``."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(keys: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Lengths shared with the key before, and the rests joined."""
    shared, rest, last = np.zeros(len(keys), np.uint8), [], b""
    for i, k in enumerate(keys):
        n = min(255, common(last, k, 0))
        shared[i] = n
        rest.append(k[n:])
        last = k
    return shared, b"".join(rest)


def front_decode(shared: np.ndarray, lengths: np.ndarray, rest: bytes) -> list[bytes]:
    out, last, a = [], b"", 0
    for n, size in zip(shared.tolist(), lengths.tolist()):
        b = a + size - n
        last = last[:n] + rest[a:b]
        out.append(last)
        a = b
    return out


def merge_runs(runs: list[list[bytes]], shared: list[list[int]]):
    """Loser-tree merge of sorted runs. ``shared[r][i]``: prefix length run r's key i shares with key i - 1.

    Gives (run, index) in order and the prefix length each shares with the one before. Invariant: every
    loser's number is the length it shares with the last winner that passed its node.
    """
    k = 1
    while k < len(runs):
        k *= 2
    n_runs = len(runs)
    head = [0] * k
    key: list[bytes | None] = [runs[r][0] if r < n_runs and runs[r] else None for r in range(k)]
    lcp = [0] * k
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's number becomes what it shares with the winner."""
        x, y = key[a], key[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        la, lb = lcp[a], lcp[b]
        if la > lb:
            return a, b
        if lb > la:
            return b, a
        n = common(x, y, la)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            if not (n == len(x) and n == len(y) and b < a):
                lcp[b] = n
                return a, b
        lcp[a] = n
        return b, a

    winner = [0] * (2 * k)
    for i in range(k):
        winner[k + i] = i
    for node in range(k - 1, 0, -1):
        winner[node], loser[node] = play(winner[2 * node], winner[2 * node + 1])
    top = winner[1]
    out_run, out_index, out_lcp = [], [], []
    while key[top] is not None:
        i = head[top]
        out_run.append(top)
        out_index.append(i)
        out_lcp.append(lcp[top])
        i += 1
        head[top] = i
        if i < len(runs[top]):
            key[top] = runs[top][i]
            lcp[top] = shared[top][i]
        else:
            key[top] = None
        node = (k + top) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2
    return np.array(out_run, np.int64), np.array(out_index, np.int64), np.array(out_lcp, np.int64)


def _send(shape: Shape):
    def send(block: Block, name: int, repeated, ranges: int):
        """The block's records with repeated anchors, one for each distinct text with the places that have it, as front-coded runs."""
        kept: dict[tuple, list] = {}
        for first, f, data, offs, _, _, bounds, unit in block.records():
            f = repeated(f, unit)
            if not len(f["text"]):
                continue
            raw = data.tobytes()
            r = range_of(f["to"], ranges).tolist()
            for t, s0, s1, p, to in zip(*(f[c].tolist() for c in ("text", "s0", "s1", "p")), r):
                row = (int(block.key[first + t]), first + t, s0 - int(bounds[t]))
                kept.setdefault((to, raw[p: s1 + shape.length], raw[s0:p], s1 - s0), []).append(row)
        by_range: dict[int, list] = {}
        for (to, right, left, more), own in kept.items():
            by_range.setdefault(to, []).append((right, left, more + 1, own))
        kept.clear()
        for to, items in by_range.items():
            items.sort(key=lambda x: x[:3])
            shared, rest = front_code([x[0] for x in items])
            own = [row for x in items for row in x[3]]
            arrays = [
                shared, np.array([len(x[0]) for x in items], np.uint16), np.frombuffer(rest, np.uint8), np.array([len(x[1]) for x in items], np.uint16),
                np.frombuffer(b"".join(x[1] for x in items), np.uint8), np.array([x[2] for x in items], np.int32), np.array([len(x[3]) for x in items], np.int32),
                np.array([r[0] for r in own], np.int64), np.array([r[1] for r in own], np.int32), np.array([r[2] for r in own], np.int64),
            ]
            parts = [squeeze(a) for a in arrays]
            yield (to, name, "run", len(items), b"".join(len(p).to_bytes(4, "little") + p for p in parts))

    return send


def _classes(right_lcp: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, last: np.ndarray, length: int):
    """For records in suffix order, (record, a, smallest doc_id) of the windows, starting a bytes before the anchor, that a smaller doc_id has too.

    ``doc`` and ``last``: smallest and largest doc_id of a record's places; ``left``: bytes before the anchor, nearest first; windows of a record have a in low..high.
    """
    n, width = left.shape
    wide = np.zeros((n, -(-max(width, 1) // 8) * 8), np.uint8)
    wide[:, :width] = left
    order = np.lexsort([c for c in wide.view(">u8").astype(np.uint64).T[::-1]])
    ranked = left[order]
    differ = ranked[1:] != ranked[:-1]
    llcp = np.zeros(n, np.int64)
    llcp[1:] = np.where(differ.any(1), differ.argmax(1), width) if width else 0
    rec, off, low_doc = [], [], []
    for a in range(int(low.min()), int(high.max()) + 1):
        use = np.flatnonzero((low <= a) & (a <= high))
        if not len(use):
            continue
        right = np.cumsum(right_lcp < length - a)
        near = np.empty(n, np.int64)
        near[order] = np.cumsum(llcp < a)
        cls = right[use] * (n + 1) + near[use]
        by = np.argsort(cls, kind="stable")
        c = cls[by]
        start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        least = np.repeat(np.minimum.reduceat(doc[use][by], start), np.diff(np.r_[start, len(c)]))
        gone = last[use][by] > least
        rec.append(use[by][gone])
        off.append(np.full(int(gone.sum()), a))
        low_doc.append(least[gone])
    z = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in (rec, off, low_doc)) if rec else (z, z, z)


def _meet(shape: Shape):
    def meet(t: pa.Table):
        """Merges a range's runs and answers each block."""
        runs, shared, cols, names = [], [], [], []
        for block, kind, payload in zip(*(t.column(c).to_pylist() for c in ("block", "kind", "payload"))):
            sh, rl, rest, ll, left, count, times, doc, text, s0 = unpack_arrays(payload)
            runs.append(front_decode(sh, rl, rest.tobytes()))
            shared.append(sh.tolist())
            cols.append([x.astype(np.int64) for x in (ll, count, times, doc, text, s0)] + [left])
            names.append(block)
        if not runs:
            return
        run, index, lcp = merge_runs(runs, shared)
        base = np.cumsum([0, *map(len, runs)])
        runs.clear()
        at = base[run] + index
        ll, count, times, doc, text, s0, flat = (np.concatenate(x) for x in zip(*cols))
        cols.clear()
        width = shape.spread - 1
        left = np.zeros((len(ll), width), np.uint8)
        rows_ = np.repeat(np.arange(len(ll)), ll)
        ends = np.cumsum(ll)
        left[rows_, ends[rows_] - 1 - np.arange(len(flat))] = flat
        owner = np.repeat(np.array(names, np.int64), np.diff(base))
        member = np.cumsum(times) - times  # where a record's places begin
        low, high = np.minimum.reduceat(doc, member), np.maximum.reduceat(doc, member)
        left, ll, low, high, count, times, owner, member = (x[at] for x in (left, ll, low, high, count, times, owner, member))
        rec, a, least = _classes(lcp, left, ll - count + 1, ll, low, high, shape.length)
        if not len(rec):
            return
        first = ll[rec] - a  # which of the record's windows
        order = np.lexsort((first, rec))
        rec, first, least = rec[order], first[order], least[order]
        f = np.flatnonzero(np.r_[True, (rec[1:] != rec[:-1]) | (first[1:] != first[:-1] + 1) | (least[1:] != least[:-1])])
        n = np.diff(np.r_[f, len(rec)])
        rec, first, least = rec[f], first[f], least[f]
        each = times[rec]
        place = np.repeat(member[rec], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        later = doc[place] > np.repeat(least, each)
        place = place[later]
        o, st, n = (np.repeat(x, each)[later] for x in (owner[rec], first, n))
        tx, st = text[place], s0[place] + st
        order = np.argsort(o, kind="stable")
        o, tx, st, n = o[order], tx[order], st[order], n[order]
        who, cuts = np.unique(o, return_index=True)
        for b, x, y in zip(who.tolist(), cuts, [*cuts[1:], len(o)]):
            yield (0, b, "answer", None, pack_runs(tx[x:y], st[x:y], n[x:y]))

    return meet


def kept_masks(block: Block):
    """For each text: its bytes and which of them stay."""
    gone = windows_to_remove(block)
    length = block.shape.length
    for i, (a, b) in enumerate(zip(block.offs[:-1].tolist(), block.offs[1:].tolist())):
        data = block.data[a:b]
        if block.role[i] == 2 and b - a >= length:
            yield data, np.zeros(b - a, bool)
        elif i in gone:
            yield data, ~cover(b - a, *gone[i], length)
        else:
            yield data, None


def _finish(block: Block) -> pa.Table:
    out = ([], [], [], [])
    for data, keep in kept_masks(block):
        left = data if keep is None else data[keep]
        spans = 0 if keep is None else int((~keep[1:] & keep[:-1]).sum()) + int(len(keep) > 0 and not keep[0])
        for c, x in zip(out, (len(data), len(data) - len(left), spans, hashlib.sha256(left.tobytes()).hexdigest())):
            c.append(x)
    return pa.table([pa.array(block.ids, pa.int64()), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(block: Block) -> pa.Table:
    left = [(data if keep is None else data[keep]).tobytes().decode("utf-8", "replace") for data, keep in kept_masks(block)]
    return pa.table([pa.array(block.ids, pa.int64()), pa.array(left, pa.string())], ["doc_id", "text"])


def suffix_dedup(docs, *, length: int = 50, gram: int = 24, digests: bool = False, block_bytes: int = 3 << 20, range_bytes: int | None = None, hot_places: int = HOT):
    """doc_id and the text that is left (bytes of a cut character become U+FFFD), or with ``digests`` counts and its SHA-256."""
    shape = Shape(length, min(gram, length), False, across=True)
    return remove_repeats(
        docs, shape, text="text", send=_send(shape), meet=_meet(shape), finish=_finish if digests else _texts, block_bytes=block_bytes, range_bytes=range_bytes, hot_places=hot_places,
        schema="doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" if digests else "doc_id long, text string",
    )


def op2_suffix_merge(spark, sf_dir):
    return suffix_dedup(documents(spark, sf_dir), digests=True)
