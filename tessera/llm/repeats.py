"""Finding repeated windows of fixed length without moving every window.

Texts are dealt once into blocks (by a hash of doc_id and text). In every window of ``length`` units (bytes or words) the
smallest-hashed run of ``gram`` units is its anchor; equal windows have equal anchors at equal places. Consecutive windows
with one anchor form a record: its text reaches from the first window's start to the last one's end.

1. Each block sends the hashes of its anchors, sorted and delta-coded, with how often they occur, to the task of their hash range, which
   answers with those that occur twice or more anywhere. Nothing else of a text is sent yet.
2. Each block sends the records with repeated anchors to their range. What is done there is the operator's own;
   it answers with the windows to remove. An anchor that occurs more than ``HOT`` times may have that many surroundings, which would all meet in one
   task: its records are sent window by window instead, each to the range of the whole window's hash, so only equal windows meet, and a block sends those once.
3. Each block removes what those windows cover.

Exact copies are found first by a digest of the text, counted before the shuffle, and take no part but for one row of each
group. A block is bounded by its bytes (or its longest text); a range by its share of the records, since a
block sends equal records once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.common import parts_for, release_and_trim, ship, text_bytes, volume

LAST = np.iinfo(np.int64).max  #: stands for a null doc_id, after all others
HOT = 4096  # places of an anchor that may meet in one task
_PLACE = 30  # bits for a unit's place in a slice of a block
_BASE = 0x9E3779B97F4A7C55


@dataclass(frozen=True)
class Shape:
    length: int  # units in a window
    gram: int  # units in an anchor
    words: bool  # units are words, else bytes
    across: bool = False  # only what different documents have in common counts

    @property
    def spread(self) -> int:
        """Places an anchor can have in a window."""
        return self.length - self.gram + 1


def squeeze(x: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    x = np.ascontiguousarray(x)
    return x.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())


def unsqueeze(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:3].decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[3:]), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(v: np.ndarray) -> bytes:
    d = np.diff(v, prepend=v.dtype.type(0))
    return squeeze(d.astype("<u4") if len(d) == 0 or d.max() < 1 << 32 else d.astype("<u8"))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b).astype(np.uint64), dtype=np.uint64)


def _grams(unit: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k units, by doubling."""
    n = len(unit)
    out, done, power, size = unit[:0], 0, unit, 1
    while done < k:
        if k & size:  # ``out`` covers the first ``done`` units
            m = n - done - size + 1
            out = out[:m] + np.uint64(pow(_BASE, done, 1 << 64)) * power[done: done + m] if done else power
            done += size
        if done < k:
            m = n - 2 * size + 1
            power = power[:m] + np.uint64(pow(_BASE, size, 1 << 64)) * power[size: size + m]
            size *= 2
    return hashing.mix(out)


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    size = 1
    while 2 * size <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size:]) if w > size else v


def records(data: np.ndarray, offs: np.ndarray, shape: Shape, table: np.ndarray):
    """dict of arrays over the records of a slice: text, hash, first and last window start and the anchor (in units of the slice);
    and unit starts and ends (bytes), first units of the texts and the units' hashes."""
    if shape.words:
        unit, starts, ends, text = hashing.words(data, offs, table)
        bounds = np.searchsorted(text, np.arange(len(offs)))
    else:
        unit, starts, ends, bounds = hashing.VALUES[data], None, None, offs
        text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    n, none = len(unit), np.zeros(0, np.int64)
    if n >= 1 << _PLACE:
        raise ValueError("a text has too many units")
    out = {"text": none, "hash": np.zeros(0, np.uint64), "s0": none, "s1": none, "p": none}
    if n >= shape.length:
        h = _grams(unit, shape.gram)
        v = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
        low = (_least(v, shape.spread) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        s = np.flatnonzero(text[: n - shape.length + 1] == text[shape.length - 1:])
        p = low[s]
        new = np.r_[True, (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)] if len(s) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        last = np.r_[at[1:], len(s)] - 1 if len(s) else at
        out = {"text": text[s[at]], "hash": h[p[at]], "s0": s[at], "s1": s[last], "p": p[at]}
    return out, starts, ends, bounds, unit


def by_window(found: dict, hot: np.ndarray, unit: np.ndarray, shape: Shape) -> dict:
    """The records, the hot ones as a record for each window; ``to`` is the hash that chooses the range."""
    out = found | {"to": found["hash"]}
    if not hot.any():
        return out
    n = np.where(hot, found["s1"] - found["s0"] + 1, 1)
    at = np.repeat(np.arange(len(n)), n)
    out = {k: v[at] for k, v in out.items()}
    s = found["s0"][at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    hot = hot[at]
    out["s0"], out["s1"] = s, np.where(hot, s, out["s1"])
    out["to"] = np.where(hot, _grams(unit, shape.length)[np.where(hot, s, 0)], out["to"])
    return out


def slices(data: np.ndarray, offs: np.ndarray, size: int = 1 << 19):
    """(first text, bytes, offsets) of runs of texts of about ``size`` bytes."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
        yield a, data[offs[a]: offs[b]], offs[a: b + 1] - offs[a]
        a = b


class Block:
    """The texts of a block in a fixed order, with what is known about exact copies."""

    def __init__(self, docs: pa.Table, told: pa.Table, shape: Shape):
        self.shape = shape
        self.table = hashing.plain_table()
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = docs.column("doc_id").to_pylist()
        self.key = np.array([LAST if d is None else d for d in self.ids], np.int64)
        self.data, self.offs = text_bytes(docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string()))
        kind, value, payload = (told.column(c).to_pylist() for c in ("kind", "value", "payload"))
        self.answers = [p for k, p in zip(kind, payload) if k == "answer"]
        self.hot = [p for k, p in zip(kind, payload) if k == "hot"]
        #: 2: a smaller doc_id has the same text, 1: other rows have it
        self.role = np.zeros(len(self.ids), np.int8)
        known = {(v, p): 2 if k == "copy" else 1 for k, v, p in zip(kind, value, payload) if k in ("copy", "first")}
        named = {v for v, _ in known}
        for i, d in enumerate(self.key.tolist()):
            if d in named:
                sha = hashlib.sha256(self.data[self.offs[i]: self.offs[i + 1]].tobytes()).hexdigest().encode()
                self.role[i] = known.get((d, sha), 0)

    def records(self, skip_copies: bool = True):
        """(slice's first text, records, bytes, offsets, unit starts, unit ends, first units, unit hashes) slice by slice."""
        for first, data, offs in slices(self.data, self.offs):
            found, starts, ends, bounds, unit = records(data, offs, self.shape, self.table)
            if skip_copies:
                use = self.role[first + found["text"]] < 2
                found = {k: v[use] for k, v in found.items()}
            yield first, found, data, offs, starts, ends, bounds, unit


ROWS = "r int, block int, kind string, value long, payload binary"
_NAMES = ["r", "block", "kind", "value", "payload"]
_KINDS = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]


def rows(items) -> pa.Table:
    cols = list(zip(*items)) or [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(cols, _KINDS)], _NAMES)


def pack_runs(text, start, count) -> bytes:
    """Runs of window starts to remove: text of the block, first start (in units of the text), how many."""
    parts = [squeeze(np.asarray(x, t)) for x, t in ((text, "<i4"), (start, "<i8"), (count, "<i4"))]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpack_arrays(b: bytes) -> list[np.ndarray]:
    out, a = [], 0
    while a < len(b):
        n = int.from_bytes(b[a: a + 4], "little")
        out.append(unsqueeze(b[a + 4: a + 4 + n]))
        a += 4 + n
    return out


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def room(spark) -> int:
    """GB of executor memory for each core, where the session says both, at least 1."""
    conf = spark.sparkContext.getConf()
    if not (conf.contains("spark.executor.memory") and conf.contains("spark.executor.cores")):
        return 1
    nbytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.executor.memory"))
    return max(1, int(nbytes // (int(conf.get("spark.executor.cores")) << 30)))


def remove_repeats(
    docs: DataFrame, shape: Shape, *, text: str, send: Callable, meet: Callable, finish: Callable, schema: str,
    block_bytes: int = 6 << 20, range_bytes: int | None = None, hot_places: int = HOT,
) -> DataFrame:
    """The three rounds. ``send(block, wanted)`` gives rows for ranges, ``meet(rows)`` answers, ``finish(block)`` the result.

    ``block_bytes`` and ``range_bytes`` (the same by default) set the numbers of blocks and ranges, and with them a task's memory, about thirty times as
    much. They are meant for 1 GB of executor memory a core and grow with it, which keeps the rows between blocks and ranges long: as in any exchange,
    there is one for each block and range.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    _, size = volume(docs)
    block_bytes, range_bytes = (x and x * room(spark) for x in (block_bytes, range_bytes))
    parts = max(parts_for(size, block_bytes, 1), min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts_for(size, 1 << 19, 1)))
    ranges = parts if range_bytes in (None, block_bytes) else parts_for(size, range_bytes, 1)
    bits = min(63, max(1, size).bit_length() + 10)
    # by the text too: rows without doc_id, or of one doc_id, are no block of their own
    docs = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int"))
    blocks = docs.repartition(parts, "block")

    key = F.coalesce("doc_id", F.lit(LAST))
    each = docs.where(F.octet_length("text") > 0).select(key.alias("id"), "block", F.sha2("text", 256).alias("sha"))
    first = each.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = each.join(first, "sha").select(
        F.lit(0).alias("r"), F.expr("block + 0").cast("int").alias("block"), F.when(F.col("id") > F.col("first"), "copy").otherwise("first").alias("kind"), F.col("id").alias("value"), F.col("sha").cast("binary").alias("payload")
    ).distinct()
    copies = copies.repartition(parts, "block")

    def announce(k, d, told):
        release_and_trim()
        block = Block(d, told, shape)
        found = [(f["hash"] >> np.uint64(64 - bits), block.key[first + f["text"]]) for first, f, *_ in block.records()]
        h = np.concatenate([x for x, _ in found] or [np.zeros(0, np.uint64)])
        if shape.across:
            doc = np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)])
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            h = h[np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]] if len(h) else h
        h, count = np.unique(h, return_counts=True)
        r = range_of(h << np.uint64(64 - bits), ranges)
        cuts = np.searchsorted(r, np.arange(ranges + 1))
        b = k[0].as_py()
        return rows((i, b, "hashes", y - x, len(p := pack_sorted(h[x:y])).to_bytes(4, "little") + p + squeeze(count[x:y].astype("<u4"))) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x)

    def compare(k, t):
        release_and_trim()
        own, values, count = [], [], []
        for b, n, p in zip(t.column("block").to_pylist(), t.column("value").to_pylist(), t.column("payload").to_pylist()):
            size = int.from_bytes(p[:4], "little")
            values.append(unpack_sorted(p[4: 4 + size]))
            count.append(unsqueeze(p[4 + size:]).astype(np.int64))
            own.append(np.full(n, b, np.int64))
        own, values, count = map(np.concatenate, (own, values, count))
        order = np.argsort(values, kind="stable")
        own, values, count = own[order], values[order], count[order]
        start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        total = np.repeat(np.add.reduceat(count, start), np.diff(np.r_[start, len(values)]))
        found = []
        for kind, use in (("answer", total > 1), ("hot", total > hot_places)):
            o, v = own[use], values[use]
            order = np.argsort(o, kind="stable")
            o, v = o[order], v[order]
            names, cuts = np.unique(o, return_index=True)
            found += [(0, b, kind, None, pack_sorted(v[x:y])) for b, x, y in zip(names.tolist(), cuts, [*cuts[1:], len(o)])]
        return rows(found)

    def offer(k, d, told):
        release_and_trim()
        block = Block(d, told, shape)
        wanted, hot = (np.sort(np.concatenate([unpack_sorted(p) for p in payloads])) if payloads else np.zeros(0, np.uint64) for payloads in (block.answers, block.hot))

        def among(h, some):
            h = h >> np.uint64(64 - bits)
            at = np.minimum(np.searchsorted(some, h), max(0, len(some) - 1))
            return some[at] == h if len(some) else np.zeros(len(h), bool)

        def repeated(found, unit):
            """The records with repeated anchors, split where those are hot."""
            use = among(found["hash"], wanted)
            found = {k: v[use] for k, v in found.items()}
            return by_window(found, among(found["hash"], hot), unit, shape)

        return rows(send(block, k[0].as_py(), repeated, ranges))

    def decide(k, t):
        release_and_trim()
        return rows(meet(t))

    def settle(k, d, told):
        release_and_trim()
        return finish(Block(d, told, shape))

    def with_copies(answers):
        return answers.select("r", "block", "kind", "value", "payload").union(copies)

    hashes = blocks.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(announce, ROWS)
    answers = hashes.repartition(ranges, "r").groupBy("r").applyInArrow(compare, ROWS)
    offers = blocks.groupBy("block").cogroup(with_copies(answers).repartition(parts, "block").groupBy("block")).applyInArrow(offer, ROWS)
    decided = offers.repartition(ranges, "r").groupBy("r").applyInArrow(decide, ROWS)
    return blocks.groupBy("block").cogroup(with_copies(decided).repartition(parts, "block").groupBy("block")).applyInArrow(settle, schema)


def windows_to_remove(block: Block):
    """By text of the block: arrays of first window starts and how many."""
    text, start, count = ([], [], [])
    for p in block.answers:
        for kept, x in zip((text, start, count), unpack_arrays(p)):
            kept.append(x)
    if not text:
        return {}
    text, start, count = (np.concatenate(x).astype(np.int64) for x in (text, start, count))
    order = np.argsort(text, kind="stable")
    text, start, count = text[order], start[order], count[order]
    names, cuts = np.unique(text, return_index=True)
    return {t: (start[a:b], count[a:b]) for t, a, b in zip(names.tolist(), cuts, [*cuts[1:], len(text)])}


def cover(n: int, start: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which of n units the windows cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, start + count - 1 + length, -1)
    return np.cumsum(d[:n]) > 0
