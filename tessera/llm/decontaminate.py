"""Benchmark decontamination with spaced seeds.

Words are runs of letters and digits, in lower case. A mask picks some of the words of a short window and ignores the others, so a
replaced word at an ignored place doesn't change the window's hash. The masks below meet every
15-word window with up to 3 replaced words (a test tries all cases). Hashes of all benchmark positions are joined with those
of all document positions; each hit fixes an alignment, which is verified word by word: a document
is contaminated by an item if some ``window`` aligned words (the item's length, if shorter) agree in at least ``share``.
Where words repeat so much that a text's hits are more than ``HITS``, they aren't listed but marked by alignment, in bounded pieces.

The benchmark goes to the executors in blocks of at most ``block_words`` words (or one item), one pass over the
documents for each block. With several blocks a pass is written out and its block is destroyed before the next is sent, so one block at a time
is broadcast and held by a worker, whatever the benchmark's size. Documents aren't shuffled.

Defined results: null and empty texts, on either side, never match; items under ``least_words`` words, which any text could
resemble by chance, match only where a text holds all their words as they are; repeated items or documents give a row each pair of ids (once); null ids are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, ship, stage, text_bytes
from tessera.llm.hashing import folded_table, mix, words

#: Places that count (1) and are ignored (0).
MASKS = ("10111", "11011", "1100101")
WINDOW, SHARE, LEAST = 15, 0.8, 8
HITS = 1 << 20  # hits listed together
MARKS = 1 << 25  # alignments marked together
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1) | 1) for i in range(64)]


def seeds(h: np.ndarray, doc: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the mask's words at every place where the mask fits in one text, and those places."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, len(mask) * 1000003, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            total += h[i: i + n] * _ODD[i % len(_ODD)]
    at = np.flatnonzero(doc[len(mask) - 1:] == doc[:n])
    return mix(total[at]), at


def covered(equal: np.ndarray, window: int, share: float) -> np.ndarray:
    """Places in windows of aligned words of which enough are equal."""
    n = len(equal)
    out = np.zeros(n + 1, np.int64)
    if n >= window:
        sums = np.cumsum(np.r_[0, equal])
        good = np.flatnonzero(sums[window:] - sums[:-window] >= np.ceil(share * window - 1e-9))
        np.add.at(out, good, 1)
        np.add.at(out, good + window, -1)
    return np.cumsum(out[:-1]) > 0


class Benchmark:
    """Seed hashes of a block of items, sorted."""

    def __init__(self, items, window: int, share: float, least: int):
        self.ids, texts = [i for i, _ in items], [(t or "").encode("utf-8", "surrogatepass") for _, t in items]
        self.window, self.share, self.least = window, share, least
        offs = np.cumsum([0, *map(len, texts)])
        self.h, _, _, doc = words(np.frombuffer(b"".join(texts), np.uint8), offs, folded_table())
        self.bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        sizes = np.diff(self.bounds)
        short = {n: "1" * n for n in np.unique(sizes[(sizes > 0) & (sizes < least)]).tolist()}
        self.masks = (*MASKS, *short.values())
        keys, places = [], []
        for mask, fits in [*((m, sizes >= least) for m in MASKS), *((m, (sizes == n) & (sizes < least)) for n, m in short.items())]:
            k, at = seeds(self.h, doc, mask)
            use = fits[doc[at]] if len(at) else np.zeros(0, bool)
            keys.append(k[use])
            places.append(at[use])
        key, at = np.concatenate(keys), np.concatenate(places)
        order = np.lexsort((at, key))
        self.key, self.at = key[order], at[order]
        self.item = np.searchsorted(self.bounds, self.at, side="right") - 1
        # entries of a key are in the order of their places: (key's number, place) finds those of some items
        rank = np.cumsum(np.r_[False, self.key[1:] != self.key[:-1]]) if len(self.key) else np.zeros(0, np.int64)
        self.place = rank * (len(self.h) + 1) + self.at
        self.near = np.zeros(1 << 22, bool)
        self.near[(self.key >> np.uint64(42)).astype(np.int64)] = True

    def search(self, data: np.ndarray, offs: np.ndarray):
        """(text index, item index, first word, covered words) for texts with a verified overlap."""
        h, _, _, doc = words(data, offs, self.table)
        bounds = np.searchsorted(doc, np.arange(len(offs)))
        hits = []
        for mask in self.masks:
            k, at = seeds(h, doc, mask)
            maybe = self.near[(k >> np.uint64(42)).astype(np.int64)]
            k, at = k[maybe], at[maybe]
            a, b = np.searchsorted(self.key, k, "left"), np.searchsorted(self.key, k, "right")
            use = b > a
            hits.append(np.stack([at[use], a[use], b[use]]))
        at, a, b = np.concatenate(hits, 1)
        n = np.bincount(doc[at], b - a, len(offs) - 1)
        out = []
        for d in np.flatnonzero(n > HITS).tolist():
            own = doc[at] == d
            out += [(d, *x) for x in self._marked(h[bounds[d]: bounds[d + 1]], at[own] - bounds[d], a[own], b[own])]
        order = np.argsort(doc[at], kind="stable")
        order = order[n[doc[at[order]]] <= HITS]
        at, a, b = at[order], a[order], b[order]
        total = np.cumsum(b - a)
        x = 0
        while x < len(at):  # some texts together
            y = int(np.searchsorted(total, (total[x - 1] if x else 0) + HITS, side="right"))
            y = max(int(np.searchsorted(doc[at], doc[at[x]], side="right")), int(np.searchsorted(doc[at], doc[at[y]])) if y < len(at) else len(at))
            place, where = self._listed(at[x:y], a[x:y], b[x:y])
            found: dict[tuple, np.ndarray] = {}
            for d, i, shift in np.unique(np.stack([doc[place], self.item[where], place - self.at[where]], 1), axis=0).tolist():
                self._verify(h, int(bounds[d]), int(bounds[d + 1]), i, shift, found, (d, i))
            out += [(d, i, int(np.argmax(w)), int(w.sum())) for (d, i), w in found.items()]
            x = y
        return out

    @staticmethod
    def _listed(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of a place and an entry that a hit stands for."""
        n = b - a
        return np.repeat(at, n), np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def _verify(self, h: np.ndarray, first: int, end: int, i: int, shift: int, found: dict, name) -> None:
        """Adds the places of the text h[first:end] that item i covers if its first word stands at ``shift``."""
        ia, ib = int(self.bounds[i]), int(self.bounds[i + 1])
        lo, hi = max(first, ia + shift), min(end, ib + shift)
        have = found.get(name)
        if have is not None and have[lo - first: hi - first].all():
            return
        good = covered(h[lo:hi] == self.h[lo - shift: hi - shift], *self.rule(ib - ia))
        if good.any():
            if have is None:
                have = found[name] = np.zeros(end - first, bool)
            have[lo - first: hi - first] |= good

    def _marked(self, h: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray):
        """(item index, first word, covered words) for one text with very many hits: alignments are marked item by item."""
        n, width = len(h), len(self.h) + 1
        base = self.place[a] // width * width
        sizes = np.diff(self.bounds)
        i = 0
        while i < len(sizes):
            e = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:] + n), MARKS)) + i)
            x, y = np.searchsorted(self.place, base + self.bounds[i]), np.searchsorted(self.place, base + self.bounds[e])
            use = y > x
            if use.any():
                start = np.cumsum(sizes[i:e] + n) - (sizes[i:e] + n)  # where an item's alignments begin
                marks = np.zeros(int((sizes[i:e] + n).sum()), bool)
                p, q, r = at[use], x[use], y[use]
                total = np.cumsum(r - q)
                s = 0
                while s < len(p):
                    t = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + HITS, side="right")))
                    place, where = self._listed(p[s:t], q[s:t], r[s:t])
                    item = self.item[where] - i
                    marks[start[item] + place - (self.at[where] - self.bounds[i:e][item]) + sizes[i:e][item]] = True
                    s = t
                hit = np.flatnonzero(marks)
                item = np.searchsorted(start, hit, side="right") - 1
                found: dict[int, np.ndarray] = {}
                for j, shift in zip((item + i).tolist(), (hit - start[item] - sizes[i:e][item]).tolist()):
                    self._verify(h, 0, n, j, shift - int(self.bounds[j]), found, j)
                for j, w in found.items():
                    yield j, int(np.argmax(w)), int(w.sum())
            i = e

    def rule(self, n: int) -> tuple[int, float]:
        """Aligned words of an item of n words, and the share of them that must agree."""
        return (n, 1.0) if n < self.least else (min(self.window, n), self.share)

    @property
    def table(self):
        if not hasattr(self, "_table"):
            self._table = folded_table()
        return self._table


def _blocks(items: DataFrame, block_words: int):
    """The benchmark in blocks of bounded size; rows come to the driver a partition at a time and leave with their block."""
    block, size = [], 0
    for r in items.toLocalIterator():
        n = len((r[1] or "").split())
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def _passes(docs: DataFrame, items: DataFrame, window: int, share: float, least_words: int, block_words: int, one_pass, whole: bool):
    """``one_pass(docs, shared)`` for each block of the benchmark. All results, or with ``whole`` the last one, made from the one before; all but that of an only block are written."""
    spark = docs.sparkSession
    ship(spark)
    blocks = _blocks(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")), block_words)
    out, block = [], next(blocks, None)
    while block is not None:
        shared = spark.sparkContext.broadcast(Benchmark(block, window, share, least_words))
        following = next(blocks, None)
        got = one_pass(docs, shared)
        if out or following is not None:
            got = stage(got, "pass")
            shared.destroy()
        if whole:
            docs = got
        out.append(got)
        block = following
    return out


def overlaps(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, share: float = SHARE, least_words: int = LEAST, block_words: int = 1 << 20) -> DataFrame:
    """A row per (doc_id, item_id) that overlap: first_word and n_words, the document's words in verified windows."""
    kind = "doc_id long, item_id long, first_word long, n_words long"

    def one_pass(docs, shared):
        def run(batches):
            bench = shared.value
            for batch in batches:
                for at, size in _runs(batch.column(1)):
                    part = batch.slice(at, size)
                    keys = part.column(0).to_pylist()
                    rows = [(keys[d], bench.ids[i], a, n) for d, i, a, n in bench.search(*text_bytes(part.column(1)))]
                    cols = list(zip(*rows)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "first_word", "n_words"])

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), kind)

    out = docs.sparkSession.createDataFrame([], kind)
    for got in _passes(docs, items, window, share, least_words, block_words, one_pass, False):
        out = out.union(got)
    return out


def clean(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, share: float = SHARE, least_words: int = LEAST, block_words: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns as they were."""
    at_text = docs.columns.index("text")

    def one_pass(docs, shared):
        def run(batches):
            bench = shared.value
            for batch in batches:
                for at, size in _runs(batch.column(at_text)):
                    part = batch.slice(at, size)
                    keep = np.ones(part.num_rows, bool)
                    keep[[d for d, *_ in bench.search(*text_bytes(part.column(at_text)))]] = False
                    yield part.filter(pa.array(keep))

        return docs.mapInArrow(lean(run), docs.schema)

    return ([docs] + _passes(docs, items, window, share, least_words, block_words, one_pass, True))[-1]


def _runs(texts, rows: int = 256, nbytes: int = 1 << 20):
    """(first, rows) of runs of texts with few bytes together (or one text)."""
    _, offs = text_bytes(texts)
    a, n = 0, len(offs) - 1
    while a < n:
        b = min(a + rows, max(a + 1, int(np.searchsorted(offs, offs[a] + nbytes, side="right")) - 1))
        yield a, b - a
        a = b


def op6_spaced_seeds(spark, sf_dir):
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).dropDuplicates(["doc_id", "item_id"])
