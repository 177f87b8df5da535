"""Toxicity by compression distance: windows of a text are compressed with two zstandard dictionaries, one of toxic text and one of ordinary text.

Training takes a bounded sample of labelled rows (``rows`` distinct texts, ``nbytes`` bytes, chosen by a hash of the text). From
three quarters of it come the dictionaries: both begin with a dictionary that zstandard trains on ordinary text; then the toxic one has the parts of words that
stand out in toxic texts (byte runs whose share of toxic documents is far above that of ordinary ones), the other one as much ordinary text. Both end
with the same short lead, which begins every window, so that a window's second match costs no header. The other quarter calibrates: the difference of
the two lengths of a window has a log-likelihood ratio for each number of bytes, and a logistic curve over a document's sum gives its score.

Defined results: null text counts as empty; a text without words has the score of no windows. Where the training rows have only one of the two
labels, or there are none, all scores are the share of toxic rows (0 if none). Rows of ``labels`` that repeat a doc_id count as toxic if
one of them is; null labels, null doc_ids and labels other than 0 and 1 teach nothing. Repeated rows have equal scores; other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.common import documents, lean, ship, text_bytes

GRAM = 6  # bytes of a run whose document frequencies are compared
_TABLE = 22  # bits of the table of runs
LONGEST = 64  # bytes; longer words are cut
MOST = 8  # differences beyond this many bytes count as this many
BINS = 2 * MOST + 1
DICTIONARY = 8 << 10
LEVELS = (3, 19)  # greedy matches find short parts, optimal parsing tells long ones from chains of syllables
CACHE = 1 << 19  # windows whose differences a worker remembers, also for its next tasks
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Model:
    """Dictionaries, the lead of every window, the ratio of each difference and the logistic curve (constant; for each level the sum; the same over the root of the windows; the log of their number)."""

    toxic: bytes
    ordinary: bytes
    lead: bytes
    ratios: tuple
    curve: tuple
    words: int
    share: float

    @property
    def known(self) -> bool:
        return bool(self.curve)


def windows(data: np.ndarray, offs: np.ndarray, words: int):
    """(text, hash, pieces) of every window: ``words`` consecutive words in lower case, the last of a text maybe fewer. ``pieces``: starts and ends of the words
    (no more than LONGEST bytes each) and the first word of each window."""
    h, starts, ends, text = hashing.words(data, offs, hashing.plain_table())
    if len(h) and (ends - starts).max() > LONGEST:
        n = -(-(ends - starts) // LONGEST)
        at = np.repeat(np.arange(len(h)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        starts, last, text = starts[at] + k * LONGEST, ends[at], text[at]
        ends = np.minimum(starts + LONGEST, last)
        one = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(hashing.VALUES[data] * hashing.powers(len(data)), out=one[1:])  # a cut word's parts differ by place and content
        h = np.where(n[at] > 1, hashing.mix(one[ends] - one[starts]), h[at])
    first_of = np.searchsorted(text, np.arange(len(offs)))
    place = np.arange(len(h)) - first_of[text]
    first = np.flatnonzero(place % words == 0)
    if words > 1 and len(first):
        left = hashing.mix(h + place.astype(np.uint64) % np.uint64(words))
        h = hashing.mix(np.add.reduceat(left, first))
    return text[first], h, starts, ends, first


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=3)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


_held: dict = {}


def differences(model: Model) -> Differences:
    """Those of the model, kept by the worker."""
    key = model.toxic, model.ordinary, model.lead, model.words
    if key not in _held:
        _held.clear()
        _held[key] = Differences(*key)
    return _held[key]


class Differences:
    """How many bytes shorter a window becomes with the toxic dictionary than with the ordinary one, at each of the levels."""

    def __init__(self, toxic: bytes, ordinary: bytes, lead: bytes, words: int):
        self.pairs = [(_compressor(toxic, x), _compressor(ordinary, x)) for x in LEVELS]
        self.lead, self.words, self.cache = lead, words, {}

    def of(self, window: bytes) -> tuple[int, ...]:
        found = self.cache.get(window)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            both = self.lead + window + self.lead  # zstandard begins no match in the last eight bytes
            found = self.cache[window] = tuple(max(-MOST, min(MOST, len(o.compress(both)) - len(t.compress(both)))) for t, o in self.pairs)
        return found

    def all_of(self, windows: list[bytes]) -> list[tuple[int, ...]]:
        """``of`` each; those remembered are looked up together."""
        found = list(map(self.cache.get, windows))
        return [self.of(w) if x is None else x for w, x in zip(windows, found)]

    def histograms(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(texts, levels * BINS) windows by difference."""
        data = _LOWER[data]
        text, h, starts, ends, first = windows(data, offs, self.words)
        if not len(first):
            return np.zeros((len(offs) - 1, len(LEVELS) * BINS), np.int64)
        order = np.argsort(h, kind="stable")
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        raw, last = data.tobytes(), np.r_[first[1:], len(starts)]
        begin, stop = first[order[new]], last[order[new]]
        if self.words == 1:
            distinct = [b" " + raw[x:y] + b" " for x, y in zip(starts[begin].tolist(), ends[begin].tolist())]
        else:
            distinct = [b"".join(b" " + raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())) + b" " for a, b in zip(begin.tolist(), stop.tolist())]
        found = np.array(self.all_of(distinct), np.int64).reshape(-1, len(LEVELS))
        each = np.empty((len(h), len(LEVELS)), np.int64)
        each[order] = found[np.cumsum(new) - 1]
        place = (text[:, None] * len(LEVELS) + np.arange(len(LEVELS))) * BINS + each + MOST
        return np.bincount(place.reshape(-1), minlength=(len(offs) - 1) * len(LEVELS) * BINS).reshape(-1, len(LEVELS) * BINS)


def _folded(texts: list[bytes]) -> list[bytes]:
    """Lower case, one blank before each word."""
    return [b" " + b" ".join(t.lower().split()) + b" " for t in texts]


def _runs(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(a) < GRAM:
        return np.zeros(0, np.int64)
    h = np.zeros(len(a) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C55) + a[i: len(a) - GRAM + 1 + i]
    return (hashing.mix(h) >> np.uint64(64 - _TABLE)).astype(np.int64)


def standing_out(texts: list[bytes], toxic: np.ndarray, least_z: float = 5.0, least_ratio: float = 2.5) -> np.ndarray:
    """Marks of the byte runs that far more toxic texts have, by place in the table."""
    have = np.zeros((2, 1 << _TABLE), np.float32)
    for t, y in zip(texts, toxic.tolist()):
        g = np.sort(_runs(t))
        have[y][g[np.r_[True, g[1:] != g[:-1]]] if len(g) else g] += 1
    n = np.bincount(toxic, minlength=2)
    p, q, both = (have[1] + 0.5) / (n[1] + 1), (have[0] + 0.5) / (n[0] + 1), (have.sum(0) + 1) / (n.sum() + 2)
    z = (p - q) / np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    return (z > least_z) & (p > least_ratio * q)


def parts(text: bytes, marks: np.ndarray) -> list[bytes]:
    """The parts of words that marked runs cover, with the blank before a word's beginning."""
    hit = np.flatnonzero(marks[_runs(text)])
    if not len(hit):
        return []
    covered = np.zeros(len(text) + 2, np.int8)
    for i in range(GRAM):
        covered[hit + i + 1] = 1
    edge = np.flatnonzero(np.diff(covered))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        run = text[a:b]
        for i, word in enumerate(run.strip(b" ").split(b" ")):
            if len(word) >= 4:
                out.append((b" " if i or run[:1] == b" " else b"") + word)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Ridge-regularised logistic regression by Newton's method; the first column is the constant."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def features(histogram: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    n = histogram[:, :BINS].sum(1)
    sums = [histogram[:, a: a + BINS] @ ratios[a: a + BINS] for a in range(0, len(ratios), BINS)]
    return np.stack([np.ones(len(n)), *sums, *(s / np.sqrt(n + 1) for s in sums), np.log1p(n)], 1)


def fit(texts: list[str], toxic: list[int], words: int = 1) -> Model:
    """A model of a sample. Of each label three of four texts make the dictionaries, the fourth the calibration."""
    y = np.array(toxic, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    plain = _folded([t.encode("utf-8", "surrogatepass") for t in texts])
    most = np.ones(len(y), bool)
    for v in (0, 1):
        most[np.flatnonzero(y == v)[3::4]] = False
    if len(np.unique(y[most])) < 2 or len(np.unique(y[~most])) < 2:
        return Model(b"", b"", b"", (), (), words, share)
    own = [t for t, m in zip(plain, most) if m]
    marks = standing_out(own, y[most])
    ordinary = [t for t, v in zip(own, y[most]) if not v]
    found = Counter(p for t, v in zip(own, y[most]) if v for p in parts(t, marks))
    kept = [p for p, n in found.most_common() if n >= 4]
    size = np.cumsum([len(p) for p in kept])
    tail = b"".join(reversed(kept[: int(np.searchsorted(size, DICTIONARY // 2, side="right"))]))  # the last is the nearest
    pieces = [t[i: i + LONGEST] for t in ordinary for i in range(0, len(t), LONGEST)]
    try:
        shared = zstandard.train_dictionary(DICTIONARY // 2, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text
        shared = b"".join(pieces)
    shared = shared[-(DICTIONARY // 2):]
    common = Counter(w for t in ordinary[:2000] for w in t.split())
    lead = (b" " + b" ".join(w for w, _ in common.most_common(4)))[:16]
    filler = b"".join(ordinary)[: len(tail)]
    both = filler + shared
    model = both + tail + lead, both + filler + lead
    differ = Differences(*model, lead, words)
    check = [t for t, m in zip(plain, most) if not m]
    data, offs = text_bytes(pa.array(check, pa.binary()))
    hist, v = differ.histograms(data, offs), y[~most]
    one, zero = hist[v == 1].sum(0), hist[v == 0].sum(0)
    n = max(1, one[:BINS].sum()), max(1, zero[:BINS].sum())
    ratios = np.log((one + 0.5) / (n[0] + 0.5 * BINS)) - np.log((zero + 0.5) / (n[1] + 0.5 * BINS))
    curve = _logistic(features(hist, ratios), v)
    return Model(*model, lead, tuple(ratios.tolist()), tuple(curve.tolist()), words, share)


def sample(docs: DataFrame, labels: DataFrame, rows: int, nbytes: int) -> tuple[list[str], list[int]]:
    """Distinct texts and labels: those of the smallest hashes, ``rows`` and ``nbytes`` at most. A text with both labels counts as toxic.

    Only hashes are joined with the labels; the chosen texts are found by a broadcast of no more than ``rows`` hashes."""
    t = F.xxhash64(F.col("text").cast("string"))
    keyed = docs.where("text IS NOT NULL").select("doc_id", t.alias("t"), F.octet_length("text").alias("n"))
    marked = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    keys = keyed.join(marked, "doc_id").groupBy("t").agg(F.max("n").alias("n"), F.max("y").alias("y")).orderBy("t").limit(rows).collect()
    total, chosen = 0, {}
    for k in keys:
        total += k["n"]
        if total > nbytes:
            break
        chosen[k["t"]] = k["y"]
    if not chosen:
        return [], []
    own = docs.sparkSession.createDataFrame([(x,) for x in chosen], "t long")
    found = docs.where("text IS NOT NULL").select(t.alias("t"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "t")
    found = found.groupBy("t").agg(F.min("text").alias("text")).toArrow()
    texts = dict(zip(found.column("t").to_pylist(), found.column("text").to_pylist()))
    return [texts[x] for x in chosen], list(chosen.values())


def train(docs: DataFrame, labels: DataFrame, rows: int = 20_000, nbytes: int = 24 << 20, words: int = 1) -> Model:
    """A model of the rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic 0 or 1) names; at most ``rows`` texts of ``nbytes`` together reach the driver."""
    return fit(*sample(docs, labels, rows, nbytes), words=words)


def score(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the column ``to``, from 0 to 1: how likely the label 1 is. Whole texts; no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(*[c for c in docs.columns if c != to]).schema
    names = list(kind.names)
    if not model.known:
        return docs.select(*names, F.lit(model.share).alias(to))
    shared = spark.sparkContext.broadcast(model)
    place = names.index(text)

    def run(batches):
        m = shared.value
        differ = differences(m)
        ratios, curve = np.array(m.ratios), np.array(m.curve)
        for batch in batches:
            data, offs = text_bytes(batch.column(place).cast(pa.string()))
            got = np.zeros(batch.num_rows)
            for a, b in _slices(offs):
                hist = differ.histograms(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
                got[a:b] = 1 / (1 + np.exp(-np.clip(features(hist, ratios) @ curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], [*names, to])

    return docs.select(*names).mapInArrow(lean(run), kind.add(to, "double"))


def _slices(offs: np.ndarray, size: int = 1 << 21):
    """Row ranges (a, b) of about ``size`` bytes, one row at least."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
        yield a, b
        a = b


def held_out(doc_id: str | Column) -> Column:
    """Rows that don't teach: crc32 of the doc_id as text, modulo 5, is 0 (null: held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op11_zstd_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs.where(~held_out("doc_id")), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    got = score(docs, model)
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
