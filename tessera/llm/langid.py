"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words and at a text's ends) has a fixed random vector of +1/-1. A three-letter gram is the product of
its letters' vectors, rotated by their places; a text is the sum of its grams' vectors. A language's
prototype is the sum over its training texts. A text gets the language whose prototype has the greatest cosine
with it, less the part that all languages have in common.

Only sums go to the driver: one vector of ``dim`` numbers for each language, at most ``max_langs`` of them.

Defined results: null text or text without a letter gives ``und`` with score 0, as does an empty training set.
Any text with a letter has a gram, as the gaps at its ends count. Equal cosines go to the first language in order. Null doc_ids are kept (and are training rows); repeated rows are judged
each; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents, lean, ship

UND = "und"
DOCS = 64  # texts looked at together
TABLE = 24_000  # gram vectors kept by a worker

_alpha: list = []
_letters: dict[int, dict] = {}


def _is_alpha() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def letter_vector(code: int, dim: int) -> np.ndarray:
    """The fixed vector of a letter, 0 being the gap."""
    have = _letters.setdefault(dim, {})
    if code not in have:
        have[code] = (np.random.Generator(np.random.Philox(key=code)).integers(0, 2, dim, dtype=np.int8) * 2 - 1).astype(np.int8)
    return have[code]


def gram_counts(texts: list[str]):
    """(text index, gram, count) arrays; a gram packs three code points (0: gap) in 63 bits, as unsigned."""
    texts = ["\0" + t.lower() + "\0" for t in texts]  # a gap at either end; runs of gaps are one
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), lens)
    cps = np.where(_is_alpha()[cps], cps, 0)
    first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    keep = (cps > 0) | ~np.r_[False, cps[:-1] == 0][: len(cps)] | first
    cps, doc = cps[keep], doc[keep]
    letters, dense = np.unique(cps, return_inverse=True)
    if len(cps) < 3:
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
    a = len(letters)
    same = doc[2:] == doc[:-2]
    code = ((doc[:-2] * a + dense[:-2]) * a + dense[1:-1]) * a + dense[2:]
    code, count = np.unique(code[same], return_counts=True)
    grams = np.stack([letters[code // (a * a) % a], letters[code // a % a], letters[code % a]], 1)
    return code // a**3, grams, count


class GramTable:
    """Vectors of grams, made once while the table has room."""

    def __init__(self, dim: int, size: int = TABLE):
        self.dim, self.size = dim, size
        self.at: dict[int, int] = {}
        self.rows = np.zeros((size, dim), np.float32)

    def index(self, grams: np.ndarray) -> np.ndarray:
        keys = (grams[:, 0] << 42) | (grams[:, 1] << 21) | grams[:, 2]
        uniq, inverse = np.unique(keys, return_inverse=True)
        new = [k for k in uniq.tolist() if k not in self.at]
        if len(self.at) + len(new) > self.size:
            self.at.clear()
            new = uniq.tolist()
            if len(new) > self.size:
                self.size = len(new)
                self.rows = np.zeros((self.size, self.dim), np.float32)
        mask = (1 << 21) - 1
        for k in new:
            i = len(self.at)
            self.at[k] = i
            self.rows[i] = np.roll(letter_vector(k >> 42, self.dim), 2) * np.roll(letter_vector(k >> 21 & mask, self.dim), 1) * letter_vector(k & mask, self.dim)
        return np.fromiter(map(self.at.__getitem__, uniq.tolist()), np.int64, len(uniq))[inverse]


_tables: dict[int, GramTable] = {}


def _table(dim: int) -> GramTable:
    return _tables.setdefault(dim, GramTable(dim))


def prototypes(train: DataFrame, text: str = "text", lang: str = "lang", dim: int = 1024, max_langs: int = 1000) -> dict[str, np.ndarray]:
    """Sums of gram vectors by language; tasks send a vector of sums for each language they met."""
    ship(train.sparkSession)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        table = _table(dim)
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at in range(0, len(langs), DOCS):
                part = langs[at: at + DOCS]
                which, grams, count = gram_counts(batch.column(0).slice(at, DOCS).to_pylist())
                if not len(which):
                    continue
                idx = table.index(grams)
                names = sorted(set(part))
                lang_of = np.array([names.index(x) for x in part])[which]
                for i, name in enumerate(names):
                    own = lang_of == i
                    weight = np.bincount(idx[own], count[own], table.size).astype(np.float32)
                    used = np.flatnonzero(weight)
                    sums[name] = sums.get(name, 0) + (weight[used] @ table.rows[used]).astype(np.float64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "pos", "value"])

    rows = (
        train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string"), F.col(lang).cast("string"))
        .mapInArrow(lean(run), "lang string, pos int, value double").groupBy("lang", "pos").agg(F.sum("value").alias("value"))
        .limit(max_langs * dim + 1).collect()
    )
    if len(rows) > max_langs * dim:
        raise ValueError(f"more than {max_langs} languages")
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(dim))[r["pos"]] = r["value"]
    return dict(sorted(out.items()))


def classify(docs: DataFrame, protos: dict[str, np.ndarray], text: str = "text", dim: int = 1024, passed: str = "doc_id long") -> DataFrame:
    """``passed`` column, lang_pred and score (cosine, cut to 0..1) for every row."""
    ship(docs.sparkSession)
    names = list(protos)
    key, kind = passed.split()
    if names:
        p = np.stack([protos[n] for n in names])
        p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        if len(names) > 1:
            p = p - p.mean(0)
        p = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)).T
        common = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        table = _table(dim)
        for batch in batches:
            preds, scores = [], []
            for at in range(0, batch.num_rows, DOCS):
                texts = [t or "" for t in batch.column(1).slice(at, DOCS).to_pylist()]
                which, grams, count = gram_counts(texts)
                idx = table.index(grams) if len(which) else which
                ends = np.searchsorted(which, np.arange(len(texts) + 1))
                sums = np.zeros((len(texts), dim), np.float32)
                for i in range(len(texts)):
                    a, b = ends[i], ends[i + 1]
                    if b > a:
                        np.dot(count[a:b].astype(np.float32), table.rows[idx[a:b]], out=sums[i])
                cos = np.zeros((len(texts), len(names)))
                if names:
                    cos = sums.astype(np.float64) @ common.value / np.maximum(np.linalg.norm(sums.astype(np.float64), axis=1, keepdims=True), 1e-12)
                for i, t in enumerate(texts):
                    if not names or not any(map(str.isalpha, t)):
                        preds.append(UND)
                        scores.append(0.0)
                    else:
                        k = int(np.argmax(np.round(cos[i], 12)))
                        preds.append(names[k])
                        scores.append(float(min(1.0, max(0.0, cos[i, k]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    return docs.select(F.col(key).cast(kind), F.col(text).cast("string")).mapInArrow(lean(run), f"{key} {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def op1_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    protos = prototypes(docs.where(~held_out()))
    return classify(docs, protos).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
