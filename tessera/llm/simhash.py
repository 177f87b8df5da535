"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints are cut into segments of at most 23 bits, 64 bits into three. If two fingerprints differ in at most 4 bits, two of the
segments differ in at most 2 bits each, so for some pair of segments both share a Golay key; the pair of keys
(24 bits) is what is joined on. Equal fingerprints are one row from the start. Candidates with a common key are
verified on all 64 bits, and only links that connect something new leave a task: a bucket gives at most a link per
member, found with pivots (members near a pivot link to it; by the triangle inequality only
clusters with pivots within 3 times the limit can touch).

Key ranges that outgrow ``range_entries`` are dealt out as pairs of blocks, so no task holds more than two blocks.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any
other; repeated rows share a component; a null doc_id is never a component's id unless it is alone with nulls.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import golay
from tessera.llm.common import documents, lean, parts_for, remove, rough_bytes, ship, stage, work_path
from tessera.llm.graph import components
from tessera.llm.hashing import mix
from tessera.llm.repeats import pack_sorted, range_of, squeeze, unpack_arrays, unpack_sorted

#: A segment is a list of (word of the fingerprint, first bit, bits), at most 23 bits together.
SEGMENTS_64 = (((0, 0, 22),), ((0, 22, 21),), ((0, 43, 21),))
MOST_BITS = 4  # guaranteed by these segments
#: Six segments over two words: the wider fingerprint for similarity, whose candidates are likely rather than sure.
SEGMENTS_128 = tuple(((word, first, 21),) for word in (0, 1) for first in (0, 21, 42))
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(data: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every k-word shingle of the text lower-cased in A-Z, repeats included; of the whole if it is shorter."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.diff(ends, prepend=0)).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in over half of the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    each, out = hashes.view(np.uint8).reshape(n, 8), 0
    for i in range(8):
        ones = np.bincount(each[:, i], minlength=256) @ _BIT
        for j in np.flatnonzero(2 * ones > n).tolist():
            out |= 1 << (8 * i + j)
    return out


def fingerprints(docs: DataFrame, shingle: int, text: str = "text", words: int = 1) -> DataFrame:
    """doc_id and fp, fp1, ... (64 bits each, as signed longs); words after the first are of remixed shingle hashes."""
    ship(docs.sparkSession)
    names = word_names(words)

    def run(batches):
        for batch in batches:
            fps = np.zeros((batch.num_rows, words), np.uint64)
            for i, t in enumerate(batch.column(1).to_pylist()):
                h = shingle_hashes((t or "").encode("utf-8", "surrogatepass"), shingle)
                for w in range(words):
                    fps[i, w] = majority(h)
                    h = mix(h)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fps[:, w].copy().view(np.int64)) for w in range(words))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(lean(run), ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def word_names(words: int) -> list[str]:
    return ["fp", *(f"fp{w}" for w in range(1, words))]


def key_entries(fps: np.ndarray, segments=SEGMENTS_64) -> tuple[np.ndarray, np.ndarray]:
    """Every (key, row) of (n, words) fingerprints."""
    got = []
    for segment in segments:
        value, at = np.zeros(len(fps), np.int64), 0
        for word, first, bits in segment:
            value |= ((fps[:, word] >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64) << at
            at += bits
        got.append(golay.keys(value))
    ks, who = [], []
    rows = np.arange(len(fps))
    for p, (a, b) in enumerate(combinations(range(len(segments)), 2)):
        key = (p << 24) | (got[a][0][:, :, None] << 12) | got[b][0][:, None, :]
        use = got[a][1][:, :, None] & got[b][1][:, None, :]
        ks.append(key[use])
        who.append(np.broadcast_to(rows[:, None, None], key.shape)[use])
    return np.concatenate(ks), np.concatenate(who)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ, over the last axis."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _find(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _bucket_links(fps: np.ndarray, rows: np.ndarray, limit: int):
    """Links that connect all members of one bucket that are connected by pairs within the limit."""
    pivots: list[int] = []
    clusters: list[np.ndarray] = []
    left = rows
    links = []
    while len(left):
        p = left[0]
        near = apart(fps[left], fps[p]) <= limit
        own = left[near]
        links += [(p, x) for x in own[1:].tolist()]
        pivots.append(int(p))
        clusters.append(own)
        left = left[~near]
    pv = fps[pivots]
    for i in range(len(pivots)):
        for j in (np.flatnonzero(apart(pv[i + 1:], pv[i]) <= 3 * limit) + i + 1).tolist():
            a, b = clusters[i], clusters[j]
            a = a[apart(fps[a], pv[j]) <= 2 * limit]
            b = b[apart(fps[b], pv[i]) <= 2 * limit]
            for s in range(0, len(a), 64):
                hit = np.argwhere(apart(fps[a[s: s + 64], None], fps[None, b]) <= limit) if len(b) else ()
                if len(hit):
                    links.append((a[s + hit[0, 0]], b[hit[0, 1]]))  # both clusters are connected already
                    break
    return links


def links_of(key: np.ndarray, fps: np.ndarray, limit: int, small: int = 24) -> np.ndarray:
    """(n, 2) first words of fingerprints: a spanning forest of the pairs within the limit that share a key."""
    order = np.lexsort((*fps.T[::-1], key))
    key, fps = key[order], fps[order]
    if not len(key):
        return np.zeros((0, 2), np.uint64)
    keep = np.r_[True, (key[1:] != key[:-1]) | (fps[1:] != fps[:-1]).any(1)]
    key, fps = key[keep], fps[keep]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    found = []
    big = sizes > small
    for s, n in zip(starts[big].tolist(), sizes[big].tolist()):
        found += _bucket_links(fps, np.arange(s, s + n), limit)
    fine = np.flatnonzero(np.repeat(~big, sizes))
    k2 = key[fine]
    pairs = [np.array(found, np.int64).reshape(-1, 2)]
    for d in range(1, small):
        same = np.flatnonzero(k2[d:] == k2[:-d])
        if not len(same):
            break
        a, b = fine[same], fine[same + d]
        near = apart(fps[a], fps[b]) <= limit
        pairs.append(np.stack([a[near], b[near]], 1))
    pairs = fps[np.concatenate(pairs), 0]
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    parent: dict = {}
    out = []
    for a, b in pairs.tolist():
        ra, rb = _find(parent, a), _find(parent, b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return np.array(out, np.uint64).reshape(-1, 2)


def near_links(fps: DataFrame, n_distinct: int, limit: int = MOST_BITS, segments=SEGMENTS_64, words: int = 1, range_entries: int = 8 << 20) -> DataFrame:
    """Links (a, b) between the first words of distinct fingerprints; their components are those of all pairs within ``limit`` bits that share a key."""
    ship(fps.sparkSession)
    names = word_names(words)
    volume = n_distinct * 28 * len(segments) * (len(segments) - 1) // 2 * (4 + 8 * words)
    ranges = parts_for(volume, 4 << 20)
    # a fixed order in each task, so that a task that runs again makes the same rows
    dealt_fps = fps.select(*names).repartition(parts_for(volume, 16 << 20), "fp").sortWithinPartitions(*names)

    def entries(batches):
        for batch in batches:
            both = np.stack([np.array(batch.column(w), np.int64).view(np.uint64) for w in range(words)], 1)
            for at in range(0, len(both), 10_000):
                part = both[at: at + 10_000]
                key, row = key_entries(part, segments)
                r = (key * 0x9E3779B1 >> 7) % ranges
                order = np.argsort(r, kind="stable")
                yield key[order].astype("<u4"), part[row[order]], r[order]

    def count(batches):
        total = np.zeros(ranges, np.int64)
        for _, _, r in entries(batches):
            total += np.bincount(r, minlength=ranges)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["r", "n"])

    def spread(batches):
        for key, fp, r in entries(batches):
            cuts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            ends = np.r_[cuts[1:], len(r)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(r[cuts].astype(np.int32)),
                    pa.array([key[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([fp[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                ],
                ["r", "keys", "fps"],
            )

    blocks = dealt_fps.mapInArrow(count, "r int, n long").groupBy("r").agg(F.sum("n").alias("total")).select("r", F.ceil(F.col("total") / range_entries).cast("int").alias("blocks"))
    blocks = stage(blocks, "blocks")
    own = F.pmod(F.xxhash64("fps"), F.col("blocks")).cast("int")
    blobs = dealt_fps.mapInArrow(spread, "r int, keys binary, fps binary")
    dealt = blobs.join(F.broadcast(blocks), "r").withColumn("own", own)  # a row per range, and ranges are as many as tasks
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("r", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "keys", "fps")

    def link(key, t):
        ks = np.frombuffer(b"".join(t.column("keys").to_pylist()), "<u4").astype(np.int64)
        fp = np.frombuffer(b"".join(t.column("fps").to_pylist()), np.uint64).reshape(-1, words)
        got = links_of(ks, fp, limit).view(np.int64)
        return pa.table({"a": pa.array(got[:, 0].copy()), "b": pa.array(got[:, 1].copy())})

    return dealt.repartition(ranges, "r", "i", "j").groupBy("r", "i", "j").applyInArrow(link, "a long, b long")


def _components(docs: DataFrame, shingle: int, limit: int, segments, words: int) -> DataFrame:
    names = word_names(words)
    fps = stage(fingerprints(docs, shingle, words=words), "fingerprints")
    distinct = stage(fps.groupBy(*names).agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(near_links(distinct, distinct.count(), limit, segments, words))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select(*names, "rep", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = joined.join(least, "root").select(*names, "component_id")
    return fps.join(labels, names).select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 4, limit: int = MOST_BITS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links of at most ``limit`` bits) of every row."""
    if not 0 <= limit <= MOST_BITS:
        raise ValueError(f"the segments find all pairs within {MOST_BITS} bits")
    return _components(docs, shingle, limit, SEGMENTS_64, 1)


def _prefix_length(n: int, p: int, q: int) -> int:
    """Of sets of Jaccard similarity p/q or more, one of n members shares some of its first this many members in any common order."""
    return n - -(-n * p // q) + 1


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode("utf-8", "surrogatepass"), shingle))


def _longs(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def repeated_texts(docs: DataFrame, shingle: int, p: int, q: int, text: str = "text", batch_shingles: int = 1 << 20, range_bytes: int = 6 << 20) -> DataFrame:
    """doc_id and t (hash of the text) of the rows that may have a partner: at least p/q of their shingles are in another row too.

    Rows are taken in batches of ``batch_shingles``; a batch sends each shingle once to the task of its hash range, cut to as many bits as keep
    chance low, and says whether several of its rows have it and else which, so a shingle of very many rows is an entry for each batch. Ranges
    answer with counts by row. A shingle that only seems to be repeated makes a candidate more, none less.
    """
    size = rough_bytes(docs)
    bits, ranges = min(63, max(1, size).bit_length() + 10), parts_for(size, range_bytes)
    kind = "r int, batch long, kind int, payload binary"
    names = ["r", "batch", "kind", "payload"]

    def packed(*arrays) -> bytes:
        parts = [squeeze(x) for x in arrays]
        return b"".join(len(x).to_bytes(4, "little") + x for x in parts)

    def announce(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        keys, marks, sets, size = [], [], [], 0

        def flush():
            nonlocal keys, marks, sets, size, number
            lens = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - bits)
            who = np.repeat(np.arange(len(sets), dtype=np.int32), lens)
            sets = []
            order = np.argsort(flat, kind="stable")
            flat, who = flat[order], who[order]
            new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            several = np.diff(np.r_[first, len(flat)]) > 1
            shared = np.repeat(several, np.diff(np.r_[first, len(flat)]))
            have = np.bincount(who[shared], minlength=len(lens))
            flat, one = flat[first], who[first]
            cuts = np.searchsorted(range_of(flat << np.uint64(64 - bits), ranges), np.arange(ranges + 1))
            rows = [(int(number % ranges), number, 0, packed(np.array([k is None for k in keys], np.uint8), np.array([k or 0 for k in keys], np.int64), np.array(marks, np.int64), lens, have))]
            for r, (x, y) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
                if y > x:
                    v = pack_sorted(flat[x:y])
                    rows.append((r, number, 1, len(v).to_bytes(4, "little") + v + packed(np.packbits(several[x:y]), one[x:y][~several[x:y]])))
            keys, marks, size, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names)

        for batch in batches:
            for key, mark, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keys.append(key)
                marks.append(mark)
                sets.append(shingle_set(t, shingle))
                size += len(sets[-1]) + 1
                if size >= batch_shingles:
                    yield flush()
        if keys:
            yield flush()

    def compare(_, t):
        own, out, values, flags, who = [], [], [], [], []
        for r, number, what, payload in zip(*(t.column(c).to_pylist() for c in names)):
            if what == 0:
                out.append((r, number, 0, payload))
                continue
            n = int.from_bytes(payload[:4], "little")
            v = unpack_sorted(payload[4: 4 + n])
            several, one = unpack_arrays(payload[4 + n:])
            several = np.unpackbits(several)[: len(v)].astype(bool)
            at = np.full(len(v), -1, np.int32)
            at[~several] = one
            own.append(number)
            values.append(v)
            flags.append(several)
            who.append(at)
        if values:
            lens = [len(v) for v in values]
            values, again = np.concatenate(values), np.concatenate(flags)
            order = np.argsort(values, kind="stable")
            ranked = values[order]
            same = np.r_[False, ranked[1:] == ranked[:-1]]
            again[order[same]] = True
            again[order[np.r_[same[1:], False]]] = True
            ends = np.cumsum([0, *lens]).tolist()
            for number, at, a, b in zip(own, who, ends, ends[1:]):
                hit = at[again[a:b] & (at >= 0)]
                if len(hit):
                    found, n = np.unique(hit, return_counts=True)
                    out.append((0, number, 2, packed(found, n)))
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names)

    def judge(_, t):
        what, payloads = t.column("kind").to_pylist(), t.column("payload").to_pylist()
        none, keys, marks, lens, have = unpack_arrays(next(x for k, x in zip(what, payloads) if k == 0))
        have = have.astype(np.int64)
        for k, x in zip(what, payloads):
            if k == 2:
                who, n = unpack_arrays(x)
                have[who] += n.astype(np.int64)
        use = np.flatnonzero(have * q >= lens * p)
        return pa.table({"doc_id": pa.array(keys[use], pa.int64(), mask=none[use].astype(bool)), "t": pa.array(marks[use], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("t"), F.col(text).cast("string").alias("text"))
    runs = rows.mapInArrow(lean(announce), kind).repartition(ranges, "r")
    return runs.groupBy("r").applyInArrow(compare, kind).groupBy("batch").applyInArrow(judge, "doc_id long, t long")


def sifted(texts: DataFrame, keys: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """The rows of ``texts`` (doc_id, t, text) whose t may be among ``keys``' t, so that few texts of others are shuffled to be joined.

    What is broadcast is a bitmap of ``bits``, however many keys there are; a full one lets all rows pass.
    """
    each = 1 << 19  # bits of a row of the bitmap

    def mark(key, t):
        own = np.zeros(each, bool)
        own[t.column("bit").to_numpy()] = True
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([np.packbits(own).tobytes()], pa.binary())})

    place = keys.select(F.pmod("t", F.lit(bits)).alias("p")).distinct().select((F.col("p") / each).cast("int").alias("at"), F.pmod("p", F.lit(each)).cast("int").alias("bit"))
    marks = np.zeros(max(1, bits // each) * (each // 8), np.uint8)
    for r in place.groupBy("at").applyInArrow(mark, "at int, marks binary").collect():  # at most ``bits`` together
        marks[r["at"] * (each // 8): (r["at"] + 1) * (each // 8)] = np.frombuffer(r["marks"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches):
        for batch in batches:
            p = np.array(batch.column(1)) % bits
            yield batch.filter(pa.array((shared.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1))

    return texts.mapInArrow(lean(run), "doc_id long, t long, text string")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """t, node (hash of the shingle set), n (its size), own (its hashes), fp, fp1 and bits (``parities``) of rows t, text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, shingle) for t in part.column(1).to_pylist()]
                cols = [part.column(0), pa.array([node_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())]
                cols += [_longs([majority(x) for x in sets]), _longs([majority(mix(x)) for x in sets]), pa.array([parities(x) for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["t", "node", "n", "own", "fp", "fp1", "bits"])

    return docs.select("t", "text").mapInArrow(lean(run), "t long, node long, n long, own binary, fp long, fp1 long, bits binary")


def frequent_shingles(sets: DataFrame, share: int = 16, least: int = 2, most: int = 1 << 16) -> np.ndarray:
    """Shingle hashes that several sets of a sample share, the rarer ones first. Their order steers cost only, no result."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], ["h"])

    sample = sets.where(F.pmod("node", F.lit(share)) == 0).dropDuplicates(["node"]).select("own")
    n = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rows = n.orderBy(F.desc("n"), "h").limit(most).collect()  # bounded by ``most``
    return np.array([r["h"] for r in rows[::-1]], np.int64).view(np.uint64)


def prefixes(sets: DataFrame, p: int, q: int, frequent: np.ndarray) -> DataFrame:
    """node, n, bits and the prefix of each set: rare shingles first, then by hash."""
    order = np.argsort(frequent)
    shared = sets.sparkSession.sparkContext.broadcast((frequent[order], order))

    def run(batches):
        known, place = shared.value
        for batch in batches:
            found = []
            for own in batch.column(2).to_pylist():
                own = np.frombuffer(own, np.uint64)
                n = len(own)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[at] == own, place[at] + 1, 0), kind="stable")]
                found.append(own[: _prefix_length(n, p, q)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), batch.column(3)], ["node", "n", "prefix", "bits"])

    return sets.where("n > 0").select("node", "n", "own", "bits").mapInArrow(lean(run), "node long, n long, prefix binary, bits binary").dropDuplicates(["node"])


def node_of(own: np.ndarray) -> int:
    """A name of a sorted shingle set, as a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def parities(own: np.ndarray) -> bytes:
    """Whether an even or odd number of the hashes falls into each of a power of two of bits, two to four for each hash."""
    n = 1 << max(2 * len(own) - 1, 63).bit_length()
    return np.packbits(np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1, bitorder="little").tobytes()


def least_apart(x: bytes, y: bytes) -> int:
    """Two sets differ in at least as many members as their parities do; the wider is folded onto the narrower."""
    x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)).sum())


class Parities:
    """``parities`` of many sets, for pairs of them at once."""

    def __init__(self, bits: list[bytes]):
        size = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
        self.kind, self.at, self.rows = size, np.zeros(len(bits), np.int64), {}
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            self.at[own] = np.arange(len(own))
            self.rows[k] = np.frombuffer(b"".join(bits[i] for i in own.tolist()), np.uint64).reshape(len(own), k)

    def least_apart(self, a: np.ndarray, b: np.ndarray, together: int = 1 << 14) -> np.ndarray:
        """``least_apart`` of the sets a[i] and b[i]."""
        swap = self.kind[a] > self.kind[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.zeros(len(a), np.int64)
        both = self.kind[a] * (1 << 32) + self.kind[b]
        for k in np.unique(both).tolist():
            x, y = k >> 32, k & ((1 << 32) - 1)
            own = np.flatnonzero(both == k)
            for s in range(0, len(own), max(1, together * 16 // y)):
                i = own[s: s + max(1, together * 16 // y)]
                wide = self.rows[y][self.at[b[i]]].reshape(len(i), y // x, x)
                wide = wide[:, 0] if y == x else np.bitwise_xor.reduce(wide, 1)
                out[i] = np.bitwise_count(self.rows[x][self.at[a[i]]] ^ wide).sum(1)
        return out


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    """The distinct ones of (m, 2) arrays of places, the smaller place first."""
    both = np.sort(np.concatenate([np.zeros((0, 2), np.int64), *pairs]), 1)
    key = np.unique(both[:, 0] << 32 | both[:, 1])
    return np.stack([key >> 32, key & 0xFFFFFFFF], 1)


def pairs_of(key: np.ndarray, node: np.ndarray, root: np.ndarray, n: np.ndarray, p: int, q: int, small: int = 24, near=None, tile: int = 512, side: np.ndarray | None = None, forest=None) -> np.ndarray:
    """(m, 2) nodes (places below 2^31) that share a key, differ in their roots, are near enough in size and for which ``near`` of the pairs holds.

    Keys of many nodes are gone through tile by tile, so no more than ``tile`` squared pairs are held before ``near`` has seen them. With ``side`` only pairs of
    different sides count. With ``forest``, a function that thins pairs out, nodes that its pairs have joined aren't paired again.
    """
    near = near or (lambda pairs: np.ones(len(pairs), bool))
    order = np.lexsort((node, n, key))
    key, node, root, n = key[order], node[order], root[order], n[order]
    side = None if side is None else side[order]
    if not len(key):
        return np.zeros((0, 2), np.int64)
    keep = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
    key, node, root, n = key[keep], node[keep], root[keep], n[keep]
    side = None if side is None else side[keep]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    fine = np.flatnonzero(np.repeat(mixed & (sizes <= small), sizes))
    k2, found = key[fine], []
    for d in range(1, small):
        same = np.flatnonzero(k2[d:] == k2[:-d])
        if not len(same):
            break
        a, b = fine[same], fine[same + d]
        use = (n[a] * q >= n[b] * p) & (root[a] != root[b])
        if side is not None:
            use &= side[a] != side[b]
        found.append(np.stack([node[a[use]], node[b[use]]], 1))
    pairs = _distinct(found)
    out = [pairs[near(pairs)]]
    for s, size in zip(starts[mixed & (sizes > small)].tolist(), sizes[mixed & (sizes > small)].tolist()):
        e, own = s + size, root[s: s + size].copy()
        for i in range(s, e, tile):
            top = int(np.searchsorted(n[s:e], n[min(e, i + tile) - 1] * q // p, side="right")) + s
            rows = np.arange(i, min(e, i + tile))
            for j in range(i, top, tile):
                cols = np.arange(j, min(top, j + tile))
                use = (own[rows - s][:, None] != own[cols - s]) & (n[rows][:, None] * q >= n[cols] * p) & (rows[:, None] < cols)
                if side is not None:
                    use &= side[rows][:, None] != side[cols]
                a, b = np.nonzero(use)
                if not len(a):
                    continue
                a, b = rows[a], cols[b]
                pairs = np.stack([node[a], node[b]], 1)
                hit = near(pairs)
                a, b, pairs = a[hit], b[hit], pairs[hit]
                if forest is not None and len(pairs):
                    keep = forest(pairs, own[a - s], own[b - s])
                    pairs = pairs[keep]
                    own = _joined(own, own[a[keep] - s], own[b[keep] - s])
                out.append(pairs)
    return _distinct(out)


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The labels after x[i] and y[i] have become one, for every i."""
    parent: dict = {}
    for a, b in zip(x.tolist(), y.tolist()):
        a, b = _find(parent, a), _find(parent, b)
        if a != b:
            parent[a] = b
    if not parent:
        return label
    old = np.array(sorted(parent), label.dtype)
    new = np.array([_find(parent, v) for v in old.tolist()], label.dtype)
    at = np.minimum(np.searchsorted(old, label), len(old) - 1)
    return np.where(old[at] == label, new[at], label)


def _forest(slack: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs of labels (x[i], y[i]) connect all that the pairs connect, the likeliest first."""
    parent: dict = {}
    keep = np.zeros(len(slack), bool)
    for i in np.argsort(slack, kind="stable").tolist():
        a, b = _find(parent, x[i].item()), _find(parent, y[i].item())
        if a != b:
            parent[a] = b
            keep[i] = True
    return keep


RANGE_ENTRIES = 1 << 20  # of the prefixes' shingles that meet in one task; a range that has more is dealt out as pairs of blocks


def _token_range(token: np.ndarray, ranges: int) -> np.ndarray:
    return (token % np.uint64(ranges)).astype(np.int64)


def token_ranges(n_entries: int) -> int:
    return parts_for(n_entries * 24, 8 << 20)


def oversize(prefixes: DataFrame, n_entries: int, most: int = RANGE_ENTRIES) -> dict[int, int]:
    """The ranges of shingles that have over ``most`` entries in the prefixes, and the blocks that they are dealt out to."""
    ranges = token_ranges(n_entries)

    def run(batches):
        total = np.zeros(ranges, np.int64)
        for batch in batches:
            token = mix(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64))
            total += np.bincount(_token_range(token, ranges), minlength=ranges)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["r", "n"])

    n = prefixes.select("prefix").mapInArrow(lean(run), "r int, n long").groupBy("r").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    return {r["r"]: -(-r["n"] // most) for r in n.collect()}  # hot ranges only


def prefix_pairs(sets: DataFrame, n_entries: int, p: int, q: int, forest: bool = False, blocks: dict[int, int] | None = None) -> DataFrame:
    """Candidates (a, b): every two nodes of different roots whose prefixes meet and whose parities don't rule out a similarity of p/q, so every two of that
    similarity or more; with ``forest`` only a task's likeliest ones that connect the same roots. ``sets``: node, root, n, prefix, bits. A range gets a node's bits once; pairs that they rule out, which in a group of loosely like
    texts are nearly all, leave no task. A range that ``blocks`` names is dealt out: its nodes by their hash, and every two of its blocks meet in a task of their own."""
    kinds = ("<u4", "<u4", "<i8", "<i8", "<i8", "<u4")
    blocks, ranges = blocks or {}, token_ranges(n_entries)
    n_blocks = np.ones(ranges, np.int64)
    n_blocks[list(blocks)] = list(blocks.values())
    shared = sets.sparkSession.sparkContext.broadcast(n_blocks)
    columns = ["r", "own", "keys", "which", "nodes", "roots", "sizes", "lens", "bits"]

    def spread(batches):
        for batch in batches:
            prefix, bits = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()], batch.column(4).to_pylist()
            cols = [np.array(batch.column(c), np.int64) for c in range(3)]
            token = mix(np.concatenate([np.zeros(0, np.uint64), *prefix]))
            row = np.repeat(np.arange(len(prefix)), [len(x) for x in prefix])
            r = _token_range(token, ranges)
            own = (mix(cols[0].view(np.uint64))[row] % shared.value[r].astype(np.uint64)).astype(np.int64)
            order = np.lexsort((own, r))
            row, r, own, token = row[order], r[order], own[order], token[order] >> np.uint64(32)  # a meeting by chance is one more candidate
            cuts = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (own[1:] != own[:-1])]) if len(r) else np.zeros(0, np.int64)
            out: list[list] = [[] for _ in columns]
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(r)]):
                here, which = np.unique(row[a:b], return_inverse=True)
                held = [bits[i] for i in here.tolist()]
                arrays = (token[a:b], which, *(c[here] for c in cols), [len(x) for x in held])
                for kept, x in zip(out, (r[a], own[a], *(np.asarray(x).astype(k).tobytes() for x, k in zip(arrays, kinds)), b"".join(held))):
                    kept.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in out[:2]] + [pa.array(x, pa.binary()) for x in out[2:]], columns)

    def link(k, t):
        keys, which, node, root, n, lens = ([np.frombuffer(x, z) for x in t.column(c).to_pylist()] for c, z in zip(columns[2:8], kinds))
        base = np.cumsum([0, *map(len, node)])
        at = np.concatenate([x.astype(np.int64) + b for x, b in zip(which, base)])
        side = None if k[1].as_py() == k[2].as_py() else np.repeat(np.array(t.column("own"), np.int64), [len(x) for x in which])
        node, root, n = map(np.concatenate, (node, root, n))
        bits = []
        for blob, sizes in zip(t.column("bits").to_pylist(), lens):
            ends = np.cumsum(sizes).tolist()
            bits += [blob[a:b] for a, b in zip([0, *ends], ends)]
        own = Parities(bits)

        def slack(pairs):
            a, b = pairs[:, 0], pairs[:, 1]
            return own.least_apart(a, b) * (p + q) - (n[a] + n[b]) * (q - p)

        thin = (lambda pairs, x, y: _forest(slack(pairs), x, y)) if forest else None
        pairs = pairs_of(np.concatenate(keys), at, root[at], n[at], p, q, near=lambda pairs: slack(pairs) <= 0, side=side, forest=thin)
        if forest and len(pairs):
            pairs = pairs[_forest(slack(pairs), root[pairs[:, 0]], root[pairs[:, 1]])]
        got = np.sort(node[pairs], 1)
        return pa.table({"a": pa.array(got[:, 0].copy()), "b": pa.array(got[:, 1].copy())})

    kind = "r int, own int, keys binary, which binary, nodes binary, roots binary, sizes binary, lens binary, bits binary"
    blobs = sets.select("node", "root", "n", "prefix", "bits").mapInArrow(lean(spread), kind)
    if blocks:
        hot = sets.sparkSession.createDataFrame(list(blocks.items()), "r int, blocks int")
        blobs = blobs.join(F.broadcast(hot), "r", "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))  # a row a hot range
    else:
        blobs = blobs.withColumn("other", F.lit(0))
    dealt = blobs.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).select("r", "i", "j", *columns[1:])
    return dealt.repartition(ranges, "r", "i", "j").groupBy("r", "i", "j").applyInArrow(link, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets have a Jaccard similarity of p/q or more. ``nodes``: node, n, bits and the t of one of its ``sets``.

    The parities rule out most pairs, and only such as can't reach the similarity; the others are compared set by set.
    """
    spark, path = sets.sparkSession, work_path(sets.sparkSession, "candidates")

    def may(batches):
        for batch in batches:
            both = zip(*(batch.column(c).to_pylist() for c in range(2, 6)))
            near = [least_apart(x, y) * (p + q) <= (m + n) * (q - p) for m, x, n, y in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    def check(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both * q >= (len(x) + len(y) - both) * p)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    one, two = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in ("a", "b"))
    sized = pairs.join(one, "a").join(two.drop("bits_b"), "b").where(f"n_a * {q} >= n_b * {p} AND n_b * {q} >= n_a * {p}")
    wide = sized.join(two.select("b", "bits_b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    wide.mapInArrow(lean(may), "a long, b long").write.parquet(path)
    pairs = spark.read.schema("a long, b long").parquet(path)
    wanted = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", "t")
    found = sets.join(wanted, ["node", "t"], "left_semi").groupBy("node").agg(F.first("own").alias("own"))
    both = pairs.join(found.toDF("a", "x"), "a").join(found.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = stage(both.mapInArrow(lean(check), "a long, b long"), "links")
    remove(spark, path)
    return links


def similar_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, slack: float = 0.05) -> DataFrame:
    """doc_id, t (hash of the text) and root (a name of the component over links of texts whose shingle sets have a Jaccard similarity of ``similarity``
    or more) of the rows that may have such a partner; all others are alone.

    All links, and only those, count: every candidate is verified on the shingle sets. Candidates come twice. 128-bit fingerprints come first
    (Jaccard j of sets of like size is a cosine of 2j/(1+j), and bits differ with the angle's share of pi, ``slack`` added); they join most groups cheaply
    but find by likelihood. Then texts not joined yet are candidates if the prefixes of their sets meet, which similar sets always do: two rounds verify
    a forest of the likeliest pairs, which joins large groups without all their pairs, and a last one all pairs that are left.
    """
    spark = docs.sparkSession
    ship(spark)
    exact = Fraction(similarity).limit_denominator(10_000)
    p, q = exact.numerator, exact.denominator
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi + slack
    rows = stage(repeated_texts(docs, shingle, p, q), "repeated")
    reps = rows.groupBy("t").agg(F.min("doc_id").alias("rep"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))
    texts = sifted(texts, reps).alias("d").join(reps.alias("r"), (F.col("d.t") == F.col("r.t")) & F.col("d.doc_id").eqNullSafe(F.col("r.rep")), "left_semi")
    sets = stage(shingle_sets(texts, shingle), "sets")
    nodes = stage(sets.groupBy("node").agg(F.min("t").alias("t"), F.min("fp").alias("fp"), F.min("fp1").alias("fp1"), F.min("n").alias("n"), F.first("bits").alias("bits")), "nodes")
    heads = stage(nodes.groupBy("fp", "fp1").agg(F.min("node").alias("head")), "distinct")
    # links name fingerprints by their first word
    named = heads.groupBy("fp").agg(F.min("head").alias("head"))
    links = near_links(heads, heads.count(), int(128 * share), SEGMENTS_128, 2)
    one, two = (named.select(F.col("fp").alias(c), F.col("head").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    likely = links.distinct().join(one, "a").join(two, "b").select("x", "y").union(nodes.join(named, "fp").where("node <> head").select("node", "head"))
    likely = likely.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    first = verified(likely, sets, nodes, p, q)
    state = stage(nodes.select("node").join(components(first), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")

    def joined(links: DataFrame) -> DataFrame:
        """The roots after links between them."""
        if links.isEmpty():
            return state
        for c in ("a", "b"):
            links = links.join(state.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c)
        tops = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
        return stage(state.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")

    heads_of = stage(prefixes(sets, p, q, frequent_shingles(sets)), "prefixes")
    n_entries = heads_of.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8
    blocks = oversize(heads_of, n_entries)
    # large groups are joined by forests of their likeliest pairs first; the last round has every pair that is left between two roots
    for forest in (True, True, False):
        rooted = heads_of.join(state, "node").select("node", "root", "n", "prefix", "bits")
        before, state = state, joined(verified(prefix_pairs(rooted, n_entries, p, q, forest, blocks), sets, nodes, p, q))
        if forest and state is before:  # no forest joins anything more
            state = joined(verified(prefix_pairs(rooted, n_entries, p, q, False, blocks), sets, nodes, p, q))
            break
    return rows.join(sets.select("t", "node").distinct(), "t").join(state, "node").select("doc_id", "t", "root")


def similar_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of its component) of every row."""
    rows = stage(similar_rows(docs, shingle, similarity), "rows")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = rows.join(least, "root").groupBy("doc_id", "t").agg(F.min("component_id").alias("component_id"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t")).alias("d")
    both = keyed.join(found.alias("f"), (F.col("d.t") == F.col("f.t")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    return both.select("d.doc_id", F.coalesce("f.component_id", "d.doc_id").alias("component_id"))


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each component, all columns as they were: that of the smallest doc_id (null after all others), then of the smallest hash of its
    text; of rows that repeat both, any one."""
    rows = stage(similar_rows(docs, shingle, similarity), "rows")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    first = rows.groupBy("root").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    each = rows.groupBy("root", "doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    marks = stage(each.join(first, "root").select("doc_id", "t", "n", (~own.eqNullSafe(F.col("first"))).alias("gone")).where("gone OR n > 1"), "marks")

    def those(part: DataFrame, marked: DataFrame, how: str) -> DataFrame:
        same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("m.t"))
        return part.alias("d").join(marked.alias("m"), same, how)

    again = marks.where(~F.col("gone"))
    if again.isEmpty():
        return those(docs, marks, "left_anti")
    return those(docs, marks, "left_anti").unionByName(those(docs, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def op5_simhash_golay(spark, sf_dir):
    got = simhash_components(documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
