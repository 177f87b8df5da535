"""Phrase collocations per language: merged count-min sketches, exact counts of what survives them, scores, subsumption.

1. Every task counts its n-grams of one to ``longest`` words in two rows of cells (hashes of 64 bits of language and words), a batch at a time, and sends
   each range of cells what it has there, sorted and delta-coded. A range adds the batches up: the merged sketch. A cell never counts less than any of its
   n-grams, so an n-gram with a cell under ``least`` is not frequent, and only it can be dropped.
2. The cells that reach ``least`` are broadcast as two bitmaps, folded to about eight bits a surviving cell; if they outgrow ``filter_bytes``, groups of ranges
   take turns, a scan each. N-grams with both bits are counted exactly: per batch by 128-bit hashes, then by language and
   phrase, first in the task and then in the phrase's hash range.
3. Parts, scores and longer phrases are joins of those counts. An n-gram that is contained in a longer one of nearly its count is contained in one that is just
   one word longer with at least that count, so only those are compared.

Defined results: null text is empty, null language is ``und``; a table without words gives no rows; repeated rows count each; other columns don't matter. Ties in
score go by count, then by the phrase's bytes. A word may be as long as its text; memory follows the batch's bytes (``batch_bytes``, or the longest text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import hashing
from tessera.llm.common import documents, lean, parts_for, rough_bytes, ship, stage, text_bytes
from tessera.llm.repeats import pack_sorted, squeeze, unpack_sorted, unsqueeze

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
ROWS = 2  # of the sketch
CELL_BITS = 22  # of a range, in each row
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.zeros(256, bool)
_CUT[list(SEPARATORS)] = True
_STEP = np.uint64(0x9E3779B97F4A7C55)
_SALTS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _table(seed: int) -> np.ndarray:
    t = np.random.Generator(np.random.Philox(key=seed)).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    t[list(SEPARATORS + BLANKS)] = 0
    return t


_TABLES = (_table(121), _table(122))


class Words:
    """The words of a batch of texts: two hashes each, with the language mixed in, bytes, and whether the next word follows in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offs = text_bytes(texts)
        self.data = _LOWER[data]
        langs = langs.fill_null("und").dictionary_encode()
        self.langs, self.lang = langs.dictionary.to_pylist(), np.asarray(langs.indices, np.int64)
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in self.langs] or [0], np.uint64)
        first, self.starts, self.ends, self.text = hashing.words(self.data, offs, _TABLES[0])
        own = seeds[self.lang[self.text]]
        self.h = hashing.mix(first ^ own)
        self.h2 = hashing.mix(hashing.rehash(self.data, self.starts, self.ends, _TABLES[1]) ^ own)
        cuts = np.concatenate([np.zeros(1, np.int64), np.cumsum(_CUT[self.data])])
        self.joined = (self.text[1:] == self.text[:-1]) & (cuts[self.starts[1:]] == cuts[self.ends[:-1]])

    def grams(self, longest: int, second: bool = False):
        """For each number of words k: (first words, hash, second hash) of the n-grams of k words."""
        h, h2, at = self.h, self.h2, np.arange(len(self.h))
        for k in range(1, longest + 1):
            if k > 1:
                use = at + k - 2 < len(self.joined)
                use[use] = self.joined[at[use] + k - 2]
                at = at[use]
                h = hashing.mix(h[use] * _STEP + self.h[at + k - 1])
                if second:
                    h2 = hashing.mix(h2[use] * _STEP + self.h2[at + k - 1])
            yield k, at, h, h2

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each of the words ``at`` on, joined by single blanks."""
        which = (at[:, None] + np.arange(k)).reshape(-1)
        lens = self.ends[which] - self.starts[which]
        last = np.tile(np.arange(k) == k - 1, len(at))
        full = lens + ~last
        idx = hashing.spans(self.starts[which], full)
        idx[np.cumsum(full)[~last] - 1] = len(self.data)
        size = full.reshape(-1, k).sum(1)
        raw = np.append(self.data, np.uint8(32))[idx]
        offs = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offs), pa.py_buffer(raw.tobytes())).cast(pa.string())


def cells(h: np.ndarray, row: int, range_bits: int) -> np.ndarray:
    """The cell of each n-gram in a row; its leading bits are the range, the same in all rows."""
    own = hashing.mix(h + _SALTS[row]) >> np.uint64(64 - CELL_BITS)
    return own if not range_bits else (h >> np.uint64(64 - range_bits) << np.uint64(CELL_BITS)) | own


def _batched(batches, nbytes: int):
    """(texts, langs) of about ``nbytes`` of text, of Arrow batches of both."""
    held, size = [], 0

    def joined():
        return tuple(pa.concat_arrays([b.column(i).cast(pa.large_string()) for b in held]) for i in range(2))

    for batch in batches:
        for a in range(0, batch.num_rows, 64):  # long texts may fill a batch many times over
            part = batch.slice(a, 64)
            held.append(part)
            size += part.column(0).nbytes
            if size >= nbytes:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _sketch(texts: DataFrame, longest: int, least: int, range_bits: int, batch_bytes: int) -> DataFrame:
    """Surviving cells: range, how many, and for each row the cells, packed. Saturated counts suffice: sums of them reach ``least`` if and only if the counts do."""
    kind = "range int, row int, cells binary, counts binary"
    most = min(least, 255)
    counted = "u1" if least <= 255 else "<i8"

    def count(batches):
        for t, lang in _batched(batches, batch_bytes):
            words = Words(t, lang)
            h = np.concatenate([x for _, _, x, _ in words.grams(longest)])
            for row in range(ROWS):
                c = np.sort(cells(h, row, range_bits))
                if not len(c):
                    continue
                at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
                n = np.diff(np.r_[at, len(c)])
                n = np.minimum(n, most).astype("u1") if least <= 255 else n.astype("<i8")
                c = c[at]
                cuts = np.searchsorted(c >> np.uint64(CELL_BITS), np.arange((1 << range_bits) + 1, dtype=np.uint64))
                rows = [(r, row, pack_sorted(c[a:b] & np.uint64((1 << CELL_BITS) - 1)), squeeze(n[a:b])) for r, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["range", "row", "cells", "counts"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for c, n in zip(batch.column("cells").to_pylist(), batch.column("counts").to_pylist()):
                at = unpack_sorted(c).astype(np.int64)
                total[at] += unsqueeze(n).view(counted)  # a cell is in a run once
        found = np.flatnonzero(total >= least).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([len(found)], pa.int64()), pa.array([pack_sorted(found)], pa.binary())], ["range", "row", "n", "cells"])

    runs = texts.mapInArrow(lean(count), kind)
    return runs.groupBy("range", "row").applyInArrow(merge, "range int, row int, n long, cells binary")


def _filters(survivors: DataFrame, range_bits: int, filter_bytes: int):
    """(first range, end, bits a cell is shifted, bitmaps) of each scan."""
    n = {r["range"]: r["n"] for r in survivors.groupBy("range").agg(F.max("n").alias("n")).collect()}  # a row a range
    shift = 0
    while shift < CELL_BITS - 10 and sum(n.values()) * 8 <= (1 << range_bits + CELL_BITS) >> (shift + 1):
        shift += 1
    each = ROWS << (CELL_BITS - shift) >> 3  # bytes of a range's bitmaps
    together = max(1, filter_bytes // each)
    for a in range(0, 1 << range_bits, together):
        b = min(1 << range_bits, a + together)
        if not sum(n.get(r, 0) for r in range(a, b)):
            continue
        bits = np.zeros((ROWS, (b - a) << (CELL_BITS - shift)), bool)
        for r in survivors.where((F.col("range") >= a) & (F.col("range") < b)).toLocalIterator():
            bits[r["row"], ((r["range"] - a) << (CELL_BITS - shift)) + (unpack_sorted(r["cells"]).astype(np.int64) >> shift)] = True
        yield a, b, shift, np.packbits(bits, axis=1, bitorder="little")


class _Tally:
    """Counts of phrases, added up whenever they have doubled."""

    KEYS = ("h", "lang", "phrase", "k")

    def __init__(self):
        self.parts, self.rows, self.settled = [], 0, 0

    def add(self, t: pa.Table) -> None:
        self.parts.append(t)
        self.rows += t.num_rows
        if self.rows > max(1 << 17, 2 * self.settled):
            self.settle()

    def settle(self) -> pa.Table:
        if self.parts:
            t = pa.concat_tables(self.parts).group_by(self.KEYS, use_threads=False).aggregate([("n", "sum")]).rename_columns([*self.KEYS, "n"])
            self.parts, self.rows, self.settled = [t], t.num_rows, t.num_rows
            return t
        return pa.table([pa.array([], k) for k in (pa.uint64(), pa.string(), pa.string(), pa.int32(), pa.int64())], [*self.KEYS, "n"])


def _lists(t: pa.Table, names) -> list[pa.Array]:
    """One list of each column."""
    return [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks()) for c in names]


def _survivors(texts: DataFrame, longest: int, least: int, range_bits: int, found, batch_bytes: int, parts: int, most: int = 1 << 20) -> DataFrame:
    """lang, phrase, k, n of the n-grams that the bitmaps let through and that occur ``least`` times. A null phrase has the words of a language; only the first scan counts those.

    A task adds up its counts and sends each of ``parts`` hash ranges one row with all that it has there (more rows if it has over ``most`` phrases)."""
    a, b, shift, bitmaps = found
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)

    def passing(h: np.ndarray) -> np.ndarray:
        """Which n-grams have both bits."""
        use = np.arange(len(h))
        for row in range(ROWS):
            c = cells(h[use], row, range_bits)
            if row == 0 and (a or b < 1 << range_bits):
                own = (c >> np.uint64(CELL_BITS) >= np.uint64(a)) & (c >> np.uint64(CELL_BITS) < np.uint64(b))
                use, c = use[own], c[own]
            c = ((c - np.uint64(a << CELL_BITS)) >> np.uint64(shift)).astype(np.int64)
            use = use[(shared.value[row, c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1]
        return use

    def packed(t: pa.Table):
        part = (np.asarray(t.column("h")) % np.uint64(parts)).astype(np.int64)
        t = t.take(pa.array(np.argsort(part, kind="stable")))
        cuts = np.searchsorted(np.sort(part), np.arange(parts + 1)).tolist()
        for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
            if y > x:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *_lists(t.slice(x, y - x), ("lang", "phrase", "k", "n"))], ["part", "lang", "phrase", "k", "n"])

    def run(batches):
        tally = _Tally()
        for t, lang in _batched(batches, batch_bytes):
            words = Words(t, lang)
            names = pa.array(words.langs, pa.string())

            def counted(h, lang, phrases, k, n):
                tally.add(pa.table([pa.array(h), lang, phrases, pa.array(np.full(len(n), k, np.int32)), pa.array(n.astype(np.int64))], [*_Tally.KEYS, "n"]))

            if a == 0 and len(words.h):
                n = np.bincount(words.lang[words.text], minlength=len(words.langs))
                counted(np.zeros(len(n), np.uint64), names, pa.nulls(len(n), pa.string()), 0, n)
            for k, at, h, h2 in words.grams(longest, second=True):
                use = passing(h)
                if not len(use):
                    continue
                order = use[np.argsort(h[use], kind="stable")]
                x, y = h[order], h2[order]
                new = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                first = at[order[new]]
                counted(x[new], names.take(pa.array(words.lang[words.text[first]])), words.phrases(first, k), k, np.diff(np.r_[new, len(order)]))
            if tally.settled > most:
                yield from packed(tally.settle())
                tally = _Tally()
        yield from packed(tally.settle())

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            columns = [batch.column(c).flatten() for c in ("lang", "phrase", "k", "n")]
            tally.add(pa.table([pa.array(np.zeros(len(columns[0]), np.uint64)), *columns], [*_Tally.KEYS, "n"]))
        t = tally.settle()
        t = t.filter((np.asarray(t.column("n")) >= least) | np.asarray(t.column("phrase").is_null())).drop_columns(["h"])
        yield from t.to_batches()

    rows = texts.mapInArrow(lean(run), "part int, lang array<string>, phrase array<string>, k array<int>, n array<long>")
    return rows.groupBy("part").applyInArrow(merge, "lang string, phrase string, k int, n long")


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, range_bits: int | None = None, batch_bytes: int = 5 << 20, filter_bytes: int = 64 << 20, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, k (words) and n (all occurrences) of every phrase of up to ``longest`` words with ``least`` occurrences or more in its language; and for each
    language a row with a null phrase, k = 0 and the number of its words. Written to the shared folder."""
    if least < 1 or longest < 1:
        raise ValueError("least and longest must be 1 or more")
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    if range_bits is None:  # a cell for about eight bytes of files, so ten to twenty n-grams a cell
        range_bits = max(0, min(14, int(rough_bytes(docs, text) / 8).bit_length() - CELL_BITS))
    parts = min(4096, parts_for(rough_bytes(docs, text), 32 << 20))
    survivors = stage(_sketch(texts, longest, least, range_bits, batch_bytes), "sketch")
    counts = None
    for found in _filters(survivors, range_bits, filter_bytes):
        own = stage(_survivors(texts, longest, least, range_bits, found, batch_bytes, parts), "phrases")
        counts = own if counts is None else counts.unionByName(own)
    if counts is None:
        return docs.sparkSession.createDataFrame([], "lang string, phrase string, k int, n long")
    return counts


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, **how) -> DataFrame:
    """The ``top`` phrases of two to ``longest`` words of each language: lang, rank, phrase, a (occurrences), l, r (of the parts of the lowest-scoring cut), n (words of the
    language) and score, floor(1000 a n / (l r)); without those that a longer phrase with ``share`` per cent of their occurrences contains."""
    counts = phrase_counts(docs, least, longest, **how)
    words = counts.where("phrase IS NULL").groupBy("lang").agg(F.sum("n").alias("words"))
    counts = counts.where("phrase IS NOT NULL")
    long = counts.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - k)")})
    heads, rests = (counts.select("lang", F.col("phrase").alias(c), F.col("n").alias(f)) for c, f in (("head", "l"), ("rest", "r")))
    cuts = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(words, "lang")
    # decimals of 38 digits: products of three counts may pass 64 bits
    cuts = cuts.withColumn("score", F.expr("(cast(1000 * cast(a as decimal(19, 0)) * cast(words as decimal(19, 0)) as decimal(38, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    least_cut = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"), F.first("a").alias("a"), F.first("words").alias("n"))
    inner = long.where("k >= 3").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = least_cut.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
    flat = kept.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return flat.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


#: The same from all n-grams, without sketches.
OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, range(1, 6) AS t(k) WHERE len(w) >= k),
words AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
counts AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, cut, h.f AS l, t.f AS r, words.n, (1000::HUGEINT * c.f * words.n) // (h.f::HUGEINT * t.f) AS score
  FROM counts c, range(1, 5) AS s(cut), counts h, counts t, words
  WHERE c.k >= 2 AND cut < c.k AND h.lang = c.lang AND t.lang = c.lang AND words.lang = c.lang
    AND h.phrase = array_to_string(c.w[1:cut], ' ') AND t.phrase = array_to_string(c.w[cut + 1:c.k], ' ')
),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, sub, max(f) AS f
  FROM (SELECT c.lang, c.f, array_to_string(c.w[i:i + m - 1], ' ') AS sub FROM counts c, range(2, 5) AS x(m), range(1, 5) AS y(i) WHERE m < c.k AND i + m - 1 <= c.k)
  GROUP BY lang, sub
),
kept AS (SELECT low.* FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.sub = low.phrase WHERE longer.f IS NULL OR 100 * longer.f < 100 * low.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
WHERE rank <= 2000
"""
