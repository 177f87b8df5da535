"""Ranked keyword search by BM25 over a persisted index that grows by segments.

An index is a folder of segments, each written by one ``append``; appending again under a segment's name replaces it, so a failed append is simply run again. A row of
a segment is a shard of consecutive documents: its words in order, each with its postings (documents and counts), and, for every word and every run of ``RUN`` documents that
has it, the greatest count and the shortest document there. The corpus' counts are sums over the shards, so nothing has to be rewritten when documents
arrive; the bounds hold for any corpus, since a score rises with the count and falls with the length.

A search goes over the shards once for a bounded number of questions. In a shard the runs of documents are scored by descending bound
until the bound is below the k-th best score so far. Documents are never shuffled; k rows a task and question are.

Defined results: null and empty texts are documents without words and are never found, but for the mean length they count as documents; a null id is last among
ties; a question without words finds nothing; scores that agree to ``DIGITS`` places are ties, which go by id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.workers import ship

RUN = 64  # documents that share a bound
DIGITS = 9
_SHARD = "n_docs long, n_words long, ids array<long>, lens binary, words array<string>, starts binary, docs binary, counts binary, run_starts binary, runs binary, run_counts binary, run_lens binary"
_NAMES = [c.split()[0] for c in _SHARD.split(", ")]


@dataclass(frozen=True)
class Bm25:
    """The formula: what a word held ``count`` times in a document of ``length`` words adds, and a word's weight."""

    k1: float = 1.2
    b: float = 0.75

    def part(self, count, length, mean: float):
        return count * (self.k1 + 1) / (count + self.k1 * (1 - self.b + self.b * length / mean))

    @staticmethod
    def weight(df, n_docs: int):
        return np.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def _packed(*arrays) -> list[bytes]:
    return [np.ascontiguousarray(a, "<i4").tobytes() for a in arrays]


def _int(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<i4")


def shard(ids: pa.Array, words: pa.Array) -> tuple:
    """A row of the index: of documents with ``ids`` and lists of ``words``."""
    lens = np.asarray(words.value_lengths().fill_null(0), np.int64)
    coded = words.flatten().dictionary_encode()
    rank = np.argsort(np.argsort(np.asarray(coded.dictionary.to_pylist(), object))) if len(coded.dictionary) else np.zeros(0, np.int64)
    names = coded.dictionary.take(pa.array(np.argsort(rank)))
    word = rank[np.asarray(coded.indices, np.int64)]
    doc = np.repeat(np.arange(len(lens)), lens)
    post, count = np.unique(word * len(lens) + doc, return_counts=True)
    word, doc = (post // len(lens), post % len(lens)) if len(lens) else (post, post)
    starts = np.searchsorted(word, np.arange(len(names) + 1))
    n_runs = -(-len(lens) // RUN)
    key = word * n_runs + doc // RUN
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    run_counts = np.maximum.reduceat(count, at) if len(at) else at
    run_lens = np.minimum.reduceat(lens[doc], at) if len(at) else at
    run_starts = np.searchsorted(word[at], np.arange(len(names) + 1))
    return len(lens), int(lens.sum()), ids, *_packed(lens), names, *_packed(starts, doc, count, run_starts, doc[at] // RUN, run_counts, run_lens)


def append(path: str, segment: str, docs: DataFrame, key: str = "doc_id", text: str = "text", shard_docs: int = 4096, shard_words: int = 1 << 20) -> None:
    """Index ``docs`` as a segment of the index at ``path``. One scan, no shuffle. A shard has at most ``shard_docs`` documents and, but for one longer document, ``shard_words`` words."""
    ship(docs.sparkSession)

    def run(batches):
        ids, words, n, size = [], [], 0, 0

        def row():
            got = shard(pa.concat_arrays(ids), pa.concat_arrays(words))
            lists = (2, 4)
            columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if i in lists else pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(got)]
            return pa.RecordBatch.from_arrays(columns, _NAMES)

        for batch in batches:
            lens = np.asarray(batch.column(1).value_lengths().fill_null(0), np.int64)
            for i in range(0, batch.num_rows, 64):
                part, more = batch.slice(i, 64), int(lens[i: i + 64].sum())
                if n and (n + part.num_rows > shard_docs or size + more > shard_words):
                    yield row()
                    ids, words, n, size = [], [], 0, 0
                ids.append(part.column(0))
                words.append(part.column(1))
                n, size = n + part.num_rows, size + more
        if n:
            yield row()

    rows = docs.select(F.col(key).cast("long").alias("id"), T.words(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("words"))
    rows.mapInArrow(run, _SHARD).write.mode("overwrite").parquet(f"{path.rstrip('/')}/segment={segment}")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SHARD).parquet(path)


class Questions:
    """A bounded number of questions as words, weights and who asks."""

    def __init__(self, words: list[list[str]]):
        self.words = sorted({w for q in words for w in q})
        place = {w: i for i, w in enumerate(self.words)}
        self.own = []
        for q in words:
            w, n = np.unique(np.array([place[x] for x in q], np.int64), return_counts=True)
            self.own.append((w, n))
        self.weights = np.zeros(len(self.words))

    def places(self, names: pa.Array) -> np.ndarray:
        """Of each asked word its place among ``names``, or -1."""
        return np.asarray(pc.fill_null(pc.index_in(pa.array(self.words, pa.string()), value_set=names), -1), np.int64)


def _frequencies(index: DataFrame, questions: Questions) -> np.ndarray:
    shared = index.sparkSession.sparkContext.broadcast(questions)

    def run(batches):
        questions = shared.value
        total = np.zeros(len(questions.words), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, starts = questions.places(batch.column(0)[i].values), _int(batch.column(1)[i].as_py())
                have = np.flatnonzero(at >= 0)
                total[have] += starts[at[have] + 1] - starts[at[have]]
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(total[have])], ["word", "n"])

    out = np.zeros(len(questions.words), np.int64)
    for r in index.select("words", "starts").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row an asked word
        out[r["word"]] = r["n"]
    return out


class _Shard:
    def __init__(self, batch: pa.RecordBatch, i: int, questions: Questions, formula: Bm25, mean: float):
        row = {c: batch.column(c)[i] for c in _NAMES}
        self.ids, self.lens = row["ids"].values, _int(row["lens"].as_py()).astype(np.int64)
        self.at = questions.places(row["words"].values)
        self.starts, self.docs, self.counts, self.run_starts, self.runs, self.run_counts, self.run_lens = (_int(row[c].as_py()) for c in _NAMES[5:])
        self.n_runs, self.formula, self.mean = -(-len(self.lens) // RUN), formula, mean

    def bounds(self, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document of a run scores more than its bound."""
        out = np.zeros(self.n_runs)
        for w, weight in zip(self.at[words].tolist(), weights.tolist()):
            if w >= 0:
                a, b = self.run_starts[w], self.run_starts[w + 1]
                out[self.runs[a:b]] += weight * self.formula.part(self.run_counts[a:b], self.run_lens[a:b], self.mean)
        return out * (1 + 1e-12) + 1e-12  # sums differ in their last places

    def scores(self, words: np.ndarray, weights: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores above 0) of the runs."""
        use = np.zeros(self.n_runs, bool)
        use[runs] = True
        out = np.zeros(len(self.lens))
        for w, weight in zip(self.at[words].tolist(), weights.tolist()):
            if w >= 0:
                a, b = self.starts[w], self.starts[w + 1]
                d, n = self.docs[a:b], self.counts[a:b]
                if len(runs) < self.n_runs:
                    own = use[d // RUN]
                    d, n = d[own], n[own]
                out[d] += weight * self.formula.part(n, self.lens[d], self.mean)
        found = np.flatnonzero(out > 0)
        return found, np.round(out[found], DIGITS)


def _ask(index: DataFrame, questions: Questions, formula: Bm25, mean: float, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(questions)

    def run(batches):
        questions = shared.value
        best: list[list] = [[] for _ in questions.own]
        weights = [questions.weights[w] * n for w, n in questions.own]
        for batch in batches:
            for i in range(batch.num_rows):
                s = _Shard(batch, i, questions, formula, mean)
                for q, (words, _) in enumerate(questions.own):
                    bounds = s.bounds(words, weights[q])
                    order = np.argsort(-bounds, kind="stable")
                    a, step = 0, 4
                    while a < len(order):
                        floor = -best[q][-1][0] if len(best[q]) == k else 0.0
                        runs = order[a: a + step]
                        runs = runs[bounds[runs] >= floor - 10.0**-DIGITS]
                        if not len(runs):
                            break
                        docs, scores = s.scores(words, weights[q], runs)
                        fit = scores >= floor
                        ids = s.ids.take(pa.array(docs[fit])).to_pylist()
                        best[q] = sorted(best[q] + [(-x, d is None, d or 0) for x, d in zip(scores[fit].tolist(), ids)])[:k]
                        a, step = a + step, step * 4
        got = [(q, None if none else d, -x) for q, rows in enumerate(best) for x, none, d in rows]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*got)) or [()] * 3, (pa.int32(), pa.int64(), pa.float64()))], ["q", "id", "score"])

    return index.mapInArrow(run, "q int, id long, score double")


def search(spark: SparkSession, path: str, questions: DataFrame, k: int = 20, formula: Bm25 = Bm25(), key: str = "query_id", text: str = "query", together: int = 1024) -> DataFrame:
    """query_id, rank, id, score: the k best documents of every question, which are asked ``together`` at a time."""
    ship(spark)
    kind = questions.schema[key].dataType.simpleString()
    index, parts = read(spark, path), []
    n_docs, n_words = (int(x or 0) for x in index.agg(F.sum("n_docs"), F.sum("n_words")).first())
    held: list = []

    def flush():
        asked = Questions([w for _, w in held])
        if asked.words and n_words:
            asked.weights[:] = formula.weight(_frequencies(index, asked), n_docs)
            rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))
            best = _ask(index, asked, formula, n_words / n_docs, k).withColumn("rank", rank).where(F.col("rank") <= k)
            names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(held)], f"q int, {key} {kind}")
            parts.append(best.join(F.broadcast(names), "q").select(key, "rank", "id", "score"))  # a row a question of this turn
        held.clear()

    for r in questions.select(F.col(key).alias("k"), T.words(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("w")).toLocalIterator():
        held.append((r["k"], r["w"]))
        if len(held) >= together:
            flush()
    if held:
        flush()
    out = parts[0] if parts else spark.createDataFrame([], f"{key} {kind}, rank int, id long, score double")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
