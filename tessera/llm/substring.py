"""Repeated word passages by suffix automata of reference shards.

The reference is what the whole table repeats: the records whose anchors occur twice or more (see ``repeats``). In the task of
its range, the distinct texts of the records are cut into shards of some ``shard_words`` words, all texts of an anchor in one; each shard's suffix
automaton is built once, every text with the number of its places, and all of the shard's texts are
streamed through it for matching statistics. Windows whose state has two places or more go: the automata decide every window of every record.
An automaton meets only the records that can match it (those of the same anchors): sending each to every document would
take time in the square of the corpus. Before the shuffle, a block puts equal records together with their number.

Removed is every word covered by a window of ``length`` consecutive words whose word sequence also starts anywhere else, the same
document included, judged on the input.

Defined results: null and empty texts have no words and lose nothing; texts under ``length`` words lose nothing; null doc_ids are kept;
repeated rows are repeated text and go; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa

from tessera.llm.common import documents
from tessera.llm.repeats import HOT, Block, Shape, cover, pack_runs, range_of, remove_repeats, squeeze, unpack_arrays, windows_to_remove


class SuffixAutomaton:
    """Of several token lists; after ``close``, ``places[state]`` is how often the state's strings occur."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.places.append(0)
        return len(self.length) - 1

    def _extend(self, last: int, token) -> int:
        nxt, link, length = self.next, self.link, self.length
        if token in nxt[last]:
            q = nxt[last][token]
            return q if length[q] == length[last] + 1 else self._clone(last, token, q)
        cur = self._state(length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, token, q)
        return cur

    def _clone(self, p: int, token, q: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, tokens, weight: int = 1) -> None:
        last = 0
        for t in tokens:
            last = self._extend(last, t)
            self.places[last] += weight

    def close(self) -> None:
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.places[self.link[v]] += self.places[v]

    def occurrences(self, tokens, window: int):
        """For every end of a window, how often those ``window`` tokens occur (matching statistics cut at the window)."""
        v, size = 0, 0
        nxt, link, length, places = self.next, self.link, self.length, self.places
        for i, t in enumerate(tokens):
            while v and t not in nxt[v]:
                v = link[v]
                size = length[v]
            if t in nxt[v]:
                v = nxt[v][t]
                size += 1
            while link[v] >= 0 and length[link[v]] >= window:
                v = link[v]
            size = min(size, max(window, 0)) if size >= window else size
            if i + 1 >= window:
                yield places[v] if size >= window else 0


def _send(shape: Shape):
    def send(block: Block, name: int, repeated, ranges: int):
        """The block's records with repeated anchors, one for each distinct text, with how often it occurs here and where."""
        kept: dict[tuple, list] = {}
        for first, f, data, offs, starts, ends, bounds, unit in block.records():
            f = repeated(f, unit)
            if not len(f["text"]):
                continue
            raw = data.tobytes()
            r = range_of(f["to"], ranges).tolist()
            a, b = starts[f["s0"]].tolist(), ends[f["s1"] + shape.length - 1].tolist()
            for t, s0, s1, p, to, x, y in zip(*(f[c].tolist() for c in ("text", "s0", "s1", "p")), r, a, b):
                entry = kept.setdefault((to, b" ".join(raw[x:y].split())), [0, p - s0, []])
                entry[0] += 2 if block.role[first + t] else 1
                entry[2].append((first + t, s0 - int(bounds[t])))
        by_range: dict[int, list] = {}
        for (to, text), (n, at, own) in kept.items():
            by_range.setdefault(to, []).append((text, n, at, own))
        kept.clear()
        for to, items in by_range.items():
            places = [row for x in items for row in x[3]]
            arrays = [
                np.frombuffer(b"\n".join(x[0] for x in items), np.uint8), np.array([x[1] for x in items], np.int64), np.array([x[2] for x in items], np.int32),
                np.array([len(x[3]) for x in items], np.int32), np.array([p[0] for p in places], np.int32), np.array([p[1] for p in places], np.int64),
            ]
            parts = [squeeze(x) for x in arrays]
            yield (to, name, "run", len(items), b"".join(len(p).to_bytes(4, "little") + p for p in parts))

    return send


def _shards(anchors: dict[bytes, bytes], shard_words: int):
    """The texts in lists of some ``shard_words`` words; an anchor's texts stay together."""
    groups: dict[bytes, list] = {}
    for text, anchor in anchors.items():
        groups.setdefault(anchor, []).append(text)
    shard, size = [], 0
    for group in groups.values():
        shard += group
        size += sum(x.count(b" ") + 1 for x in group)
        if size >= shard_words:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def _flag(shard: list[bytes], total: dict[bytes, int], length: int) -> dict[bytes, np.ndarray]:
    """Which windows of each text occur twice or more in the shard."""
    ids: dict[bytes, int] = {}
    tokens = {text: [ids.setdefault(w, len(ids)) for w in text.split()] for text in shard}
    automaton = SuffixAutomaton()
    for text, own in tokens.items():
        automaton.add(own, total[text])
    automaton.close()
    return {text: np.fromiter(automaton.occurrences(own, length), np.int64, len(own) - length + 1) > 1 for text, own in tokens.items()}


def _meet(shape: Shape, shard_words: int):
    def meet(t: pa.Table):
        total: dict[bytes, int] = {}
        anchors: dict[bytes, bytes] = {}
        sent = []
        for block, kind, payload in zip(*(t.column(c).to_pylist() for c in ("block", "kind", "payload"))):
            flat, n, at, times, doc, s0 = unpack_arrays(payload)
            texts = flat.tobytes().split(b"\n")
            for text, k, p in zip(texts, n.tolist(), at.tolist()):
                total[text] = total.get(text, 0) + k
                if text not in anchors:
                    anchors[text] = b" ".join(text.split()[p: p + shape.gram])
            sent.append((block, texts, times.tolist(), doc, s0))
        runs: dict[bytes, tuple] = {}
        for shard in _shards(anchors, shard_words):
            for text, flags in _flag(shard, total, shape.length).items():
                if flags.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
                    runs[text] = (edge[::2], edge[1::2] - edge[::2])
        for block, texts, times, doc, s0 in sent:
            found, a = [], 0
            for text, k in zip(texts, times):
                if text in runs:
                    start, n = runs[text]
                    m = len(start)
                    found.append((np.repeat(doc[a: a + k], m), np.repeat(s0[a: a + k], m) + np.tile(start, k), np.tile(n, k)))
                a += k
            if found:
                yield (0, block, "answer", None, pack_runs(*map(np.concatenate, zip(*found))))

    return meet


def kept_words(block: Block):
    """For each text: its words and which of them stay (None: all)."""
    gone = windows_to_remove(block)
    length = block.shape.length
    for i, (a, b) in enumerate(zip(block.offs[:-1].tolist(), block.offs[1:].tolist())):
        words = block.data[a:b].tobytes().split()
        if block.role[i] and len(words) >= length:
            yield words, np.zeros(len(words), bool)
        elif i in gone:
            yield words, ~cover(len(words), *gone[i], length)
        else:
            yield words, None


def _finish(block: Block) -> pa.Table:
    out = ([], [], [])
    for words, keep in kept_words(block):
        left = words if keep is None else list(compress(words, keep.tolist()))
        for c, x in zip(out, (len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())):
            c.append(x)
    return pa.table([pa.array(block.ids, pa.int64()), *(pa.array(c, pa.int64()) for c in out[:2]), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(block: Block) -> pa.Table:
    left = [b" ".join(words if keep is None else compress(words, keep.tolist())).decode("utf-8", "replace") for words, keep in kept_words(block)]
    return pa.table([pa.array(block.ids, pa.int64()), pa.array(left, pa.string())], ["doc_id", "text"])


def substring_dedup(docs, *, length: int = 35, gram: int = 12, shard_words: int = 200_000, digests: bool = False, block_bytes: int = 6 << 20, range_bytes: int | None = None, hot_places: int = HOT):
    """doc_id and the words that are left, joined by a blank, or with ``digests`` counts and their SHA-256."""
    shape = Shape(length, min(gram, length), True)
    return remove_repeats(
        docs, shape, text="text", send=_send(shape), meet=_meet(shape, shard_words), finish=_finish if digests else _texts, block_bytes=block_bytes, range_bytes=range_bytes, hot_places=hot_places,
        schema="doc_id long, n_words long, n_removed long, kept_sha256 string" if digests else "doc_id long, text string",
    )


def op10_suffix_automata(spark, sf_dir):
    return substring_dedup(documents(spark, sf_dir), digests=True)
