"""Ranked lexical search over blocks of documents with per-term maxima.

The index has a row for each block of consecutive documents as they are read: its terms, each with the greatest contribution that it makes to any document of the
block and the number of documents that hold it, and the forward index, every document's terms and how often it holds them. It is written as Parquet with the
corpus' counts, and any number of queries is then asked of it.

A query's bound on a block is the weighted sum of the maxima, so no document of the block scores more. First the blocks of the greatest bounds of all are
scored, and the k-th best score there is a threshold. Then each task sorts its blocks by bound for each query and scores them until the bound is below the
threshold, which rises with what the task finds. Blocks of an equal bound are scored too, so ties are complete. Only k rows a query and task are shuffled.

All arithmetic after the weights is in 64-bit integers. Terms are compared as strings; within a batch they are told apart by 128-bit hashes.

Defined results: null text has no terms, and documents without terms are never found; a null doc_id is last among equal scores; repeated documents are found each;
each row of the queries is asked by itself, one without terms finds nothing; empty tables give no rows; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import hashing
from tessera.llm.common import documents, lean, ship, text_bytes, work_path
from tessera.llm.repeats import squeeze, unsqueeze

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SECOND = np.random.Generator(np.random.Philox(key=131)).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_INDEX = "block long, docs array<long>, sizes binary, terms array<string>, tops binary, dfs binary, held binary, which binary, tfs binary"


@dataclass(frozen=True)
class Index:
    """Where the blocks are, and the corpus' counts: documents with terms and all their terms."""

    path: str
    n_docs: int
    n_terms: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_INDEX).parquet(self.path)


def contribution(tf, m):
    """What a term held tf times adds, before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def norm(n, n_docs: int, n_terms: int):
    """The length part of a document of n terms."""
    return 100 - 25 + (25 * n * n_docs) // n_terms


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def terms_of(text: str | None) -> list[str]:
    return [t.decode("utf-8", "surrogatepass") for t in TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())]


def _counts(docs: DataFrame, text: str) -> tuple[int, int]:
    table = hashing.folded_table() != 0

    def run(batches):
        n = total = 0
        for batch in batches:
            data, offs = text_bytes(batch.column(0))
            inside = table[data]
            start = inside.copy()
            start[1:] &= ~inside[:-1]
            start[offs[:-1][offs[:-1] < len(data)]] = inside[offs[:-1][offs[:-1] < len(data)]]
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(start)])[offs]
            each = np.diff(ends)
            n, total = n + int((each > 0).sum()), total + int(each.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    found = docs.select(F.col(text).cast("string")).mapInArrow(lean(run), "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return int(found[0] or 0), int(found[1] or 0)


def _blocks(ids: pa.Array, data: np.ndarray, offs: np.ndarray, n_docs: int, n_terms: int, block_docs: int, block_terms: int):
    """The rows of the index of a batch, without block numbers."""
    data = _LOWER[data]
    h, starts, ends, text = hashing.words(data, offs, hashing.folded_table())
    if not len(h):
        return
    h2 = hashing.rehash(data, starts, ends, _SECOND)
    order = np.argsort(h, kind="stable")
    if ((h[order][1:] == h[order][:-1]) & (h2[order][1:] != h2[order][:-1])).any():
        order = np.lexsort((h2, h))
    x, y = h[order], h2[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    term = np.empty(len(h), np.int64)
    term[order] = np.cumsum(new) - 1
    example = order[new]
    bounds = np.searchsorted(text, np.arange(len(offs)))  # first words of the documents
    used = np.flatnonzero(np.diff(bounds))
    at = 0
    while at < len(used):
        first = bounds[used[at]]
        end = min(at + block_docs, max(at + 1, int(np.searchsorted(bounds[used + 1], first + block_terms, side="right"))))
        rows = used[at:end]
        last = bounds[rows[-1] + 1]
        own, local = np.unique(term[first:last], return_inverse=True)
        n = np.diff(bounds)[rows]
        doc = np.repeat(np.arange(len(rows)), n)
        pair, tf = np.unique(doc * len(own) + local, return_counts=True)
        doc, which = pair // len(own), pair % len(own)
        m = norm(n, n_docs, n_terms)
        tops = np.zeros(len(own), np.int64)
        np.maximum.at(tops, which, contribution(tf, m[doc]))
        word = example[own]
        lens = ends[word] - starts[word]
        raw = data[hashing.spans(starts[word], lens)].tobytes()
        strings = pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])), pa.py_buffer(raw))
        yield ids.take(pa.array(rows)), squeeze(m), strings, squeeze(tops.astype("<i4")), squeeze(np.bincount(which, minlength=len(own)).astype("<i4")), squeeze(np.bincount(doc, minlength=len(rows)).astype("<i4")), squeeze(which.astype("<i4")), squeeze(tf.astype("<i4"))
        at = end


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, block_docs: int = 128, block_terms: int = 1 << 17) -> Index:
    """Index every row of ``docs`` at ``path`` (a new one in the shared folder by default); two scans, no shuffle. A block has at most ``block_docs`` documents and, but for a
    single longer document, ``block_terms`` terms."""
    spark = docs.sparkSession
    ship(spark)
    n_docs, n_terms = _counts(docs, text)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 2048):
                data, offs = text_bytes(column.slice(a, 2048))
                for row in _blocks(ids.slice(a, 2048), data, offs, n_docs, n_terms, block_docs, block_terms):
                    d, m, terms, *rest = row
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (d, terms.cast(pa.string()))]
                    yield pa.RecordBatch.from_arrays([pa.array([number]), lists[0], pa.array([m], pa.binary()), lists[1], *(pa.array([v], pa.binary()) for v in rest)], ["block", "docs", "sizes", "terms", "tops", "dfs", "held", "which", "tfs"])
                    number += 1

    path = path or work_path(spark, "lexical")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(lean(run), _INDEX).write.mode("overwrite").parquet(path)
    return Index(path, n_docs, n_terms)


class Queries:
    """A bounded number of queries: their distinct terms and, term by term, who asks for it how often."""

    def __init__(self, texts: list[str | None]):
        asked = [Counter(terms_of(t)) for t in texts]
        self.terms = sorted({t for c in asked for t in c})
        place = {t: i for i, t in enumerate(self.terms)}
        self.own = [(np.array([place[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in asked]
        self.weights = np.zeros(len(self.terms), np.int64)
        self.floor = np.zeros(len(texts), np.int64)  # scores below this are of no use
        self._names = None

    def __getstate__(self):
        return self.__dict__ | {"_names": None}

    def found(self, terms: pa.Array) -> np.ndarray:
        """The place in the block's terms of each asked term, -1 where the block hasn't it."""
        if self._names is None:
            self._names = pa.array(self.terms, pa.string())
        return np.asarray(pc.fill_null(pc.index_in(self._names, value_set=terms), -1), np.int64)

    def matrix(self):
        """(term, query, weight of the term in the query), sorted by query."""
        if not self.own:
            z = np.zeros(0, np.int64)
            return z, z, z
        term = np.concatenate([t for t, _ in self.own])
        query = np.repeat(np.arange(len(self.own)), [len(t) for t, _ in self.own])
        return term, query, self.weights[term] * np.concatenate([n for _, n in self.own])


def _bounds(queries: Queries, matrix, at: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """Every query's bound on a block."""
    term, query, w = matrix
    top = np.where(at >= 0, tops[np.maximum(at, 0)], 0) if len(tops) else np.zeros(len(at), np.int64)
    out = np.zeros(len(queries.own), np.int64)
    np.add.at(out, query, w * top[term])
    return out


class Block:
    """The forward index of a block, cut down to the asked terms: their documents and contributions, term by term."""

    def __init__(self, row: dict, at: np.ndarray):
        self.docs, m = row["docs"], unsqueeze(row["sizes"])
        held, which, tf = unsqueeze(row["held"]), unsqueeze(row["which"]).astype(np.int64), unsqueeze(row["tfs"]).astype(np.int64)
        asked = np.full(int(which.max()) + 1 if len(which) else 0, -1, np.int64)
        have = np.flatnonzero((at >= 0) & (at < len(asked)))
        asked[at[have]] = have
        doc = np.repeat(np.arange(len(self.docs)), held)
        term = asked[which]
        use = np.flatnonzero(term >= 0)
        use = use[np.argsort(term[use], kind="stable")]
        self.term, self.doc = term[use], doc[use]
        self.part = contribution(tf[use], m[self.doc])
        self.starts = np.searchsorted(self.term, np.arange(len(at) + 1))

    def scores(self, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        a, n = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = hashing.spans(a, n)
        out = np.zeros(len(self.docs), np.int64)
        np.add.at(out, self.doc[at], np.repeat(w, n) * self.part[at])
        return out


class Best:
    """The k best documents of each query so far."""

    def __init__(self, queries: Queries, k: int):
        self.k, self.rows = k, [[] for _ in queries.own]
        self.floor = queries.floor.copy()

    def add(self, q: int, docs: list, scores: np.ndarray) -> None:
        use = np.flatnonzero((scores > 0) & (scores >= self.floor[q]))
        if not len(use):
            return
        rows = self.rows[q] + [(-int(scores[i]), docs[i] is None, docs[i] or 0) for i in use.tolist()]
        self.rows[q] = sorted(rows)[: self.k]
        if len(self.rows[q]) == self.k:
            self.floor[q] = max(self.floor[q], -self.rows[q][-1][0])

    def batch(self) -> pa.RecordBatch:
        got = [(q, None if none else d, -s) for q, rows in enumerate(self.rows) for s, none, d in rows]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*got)) or [()] * 3, (pa.int32(), pa.int64(), pa.int64()))], ["q", "doc_id", "score"])


def _ask(index: DataFrame, queries: Queries, k: int, only: dict[int, list[int]] | None = None) -> DataFrame:
    """q, doc_id, score: each task's k best of every query. ``only``: the queries asked of each block, else all."""
    shared = index.sparkSession.sparkContext.broadcast((queries, only))

    def run(batches):
        queries, only = shared.value
        best, matrix = Best(queries, k), queries.matrix()
        weights = [queries.weights[t] * n for t, n in queries.own]
        for batch in batches:
            rows, places, bounds = [], [], []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                at = queries.found(row["terms"].values)
                row = {c: row[c].as_py() for c in ("block", "docs", "sizes", "tops", "held", "which", "tfs")}
                b = _bounds(queries, matrix, at, unsqueeze(row["tops"]).astype(np.int64))
                if only is not None:
                    asked = np.zeros(len(b), bool)
                    asked[only[row["block"]]] = True
                    b = np.where(asked, b, 0)
                rows.append(row)
                places.append(at)
                bounds.append(b)
            if not rows:
                continue
            bounds, opened = np.stack(bounds), {}
            order = np.argsort(-bounds, axis=0, kind="stable")
            for q in np.flatnonzero(bounds.max(0)).tolist():
                for i in order[:, q].tolist():  # until the bound is below what is found already
                    if bounds[i, q] <= 0 or bounds[i, q] < best.floor[q]:
                        break
                    if i not in opened:
                        opened[i] = Block(rows[i], places[i])
                    best.add(q, rows[i]["docs"], opened[i].scores(queries.own[q][0], weights[q]))
        yield best.batch()

    return index.mapInArrow(lean(run), "q int, doc_id long, score long")


def _greatest(index: DataFrame, queries: Queries, each: int) -> DataFrame:
    """q, block, bound: the blocks of each query's greatest bounds, ``each`` a task."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        queries = shared.value
        matrix, best = queries.matrix(), [[] for _ in queries.own]
        for batch in batches:
            for i in range(batch.num_rows):
                b = _bounds(queries, matrix, queries.found(batch.column(1)[i].values), unsqueeze(batch.column(2)[i].as_py()).astype(np.int64))
                block = batch.column(0)[i].as_py()
                for q in np.flatnonzero(b).tolist():
                    best[q] = sorted([*best[q], (-int(b[q]), block)])[:each]
        got = [(q, block, -b) for q, rows in enumerate(best) for b, block in rows]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*got)) or [()] * 3, (pa.int32(), pa.int64(), pa.int64()))], ["q", "block", "bound"])

    return index.select("block", "terms", "tops").mapInArrow(lean(run), "q int, block long, bound long")


def _document_frequencies(index: DataFrame, queries: Queries) -> dict[int, int]:
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        queries = shared.value
        total = np.zeros(len(queries.terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at = queries.found(batch.column(0)[i].values)
                have = np.flatnonzero(at >= 0)
                total[have] += unsqueeze(batch.column(1)[i].as_py())[at[have]]
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], ["t", "n"])

    return {r["t"]: r["n"] for r in index.select("terms", "dfs").mapInArrow(lean(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # a row an asked term


def _search(spark: SparkSession, index: Index, texts: list[str | None], k: int, seeds: int) -> DataFrame | None:
    queries, blocks = Queries(texts), index.read(spark)
    if not queries.terms or not index.n_docs:
        return None
    df = _document_frequencies(blocks, queries)
    queries.weights[:] = [weight(df[t], index.n_docs) if t in df else 0 for t in range(len(queries.terms))]
    first = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
    chosen = _greatest(blocks, queries, seeds).withColumn("n", F.row_number().over(first)).where(F.col("n") <= seeds).select("q", "block").collect()  # ``seeds`` a query
    only: dict[int, list[int]] = {}
    for r in chosen:
        only.setdefault(r["block"], []).append(r["q"])
    if only:
        best = Window.partitionBy("q").orderBy(F.desc("score"))
        kth = _ask(blocks.where(F.col("block").isin(list(only))), queries, k, only).withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("q", "score")
        for r in kth.collect():  # a row a query
            queries.floor[r["q"]] = r["score"]
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return _ask(blocks, queries, k).withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text", together: int = 1024, seeds: int = 4) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents above 0 of every row of ``items``, which are asked ``together`` at a time."""
    spark = items.sparkSession
    ship(spark)
    kind = items.select(F.col(item_id).alias("item_id")).schema["item_id"].dataType.simpleString()
    held, parts = [], []

    def flush():
        found = _search(spark, index, [t for _, t in held], k, seeds)
        if found is not None:
            names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(held)], f"q int, item_id {kind}")
            parts.append(found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))  # a row a query of this turn
        held.clear()

    for r in items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        held.append((r["i"], r["t"]))
        if len(held) >= together:
            flush()
    if held:
        flush()
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op13_block_max(spark, sf_dir):
    return search(build_index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same by scoring every document.
OP13_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
held AS (SELECT doc_id, len(t) AS n, t FROM docs WHERE len(t) > 0),
corpus AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM held),
tfs AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM held) GROUP BY doc_id, n, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
) GROUP BY item_id, term),
scored AS (
  SELECT a.item_id, f.doc_id, sum(a.times * floor(1000 * ln((2 * c.N + 2) / (2 * d.df + 1)))::BIGINT
    * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (100 - 25 + (25 * f.n * c.N) // c.L))))::BIGINT AS score
  FROM asked a JOIN tfs f ON f.term = a.term JOIN dfs d ON d.term = a.term, corpus c
  GROUP BY a.item_id, f.doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
