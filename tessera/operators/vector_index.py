"""An approximate index of vectors: inverted cells with product-quantised residuals, probe search, exact re-ranking.

``fit`` learns cell centres and the codebooks of the residuals from a bounded sample; ``build`` writes every vector to its cell as Parquet (a folder a cell, so that
a search reads only the cells it probes) with its code, how far its code is from it, and the vector itself. A search scores codes by table lookups, keeps
those that may be among the best, and fetches only their vectors. The similarity is the inner product, which is the cosine of unit vectors.

Two ways to keep candidates: ``refine`` times k codes a query (the usual, approximate one), or, with ``refine=None``, every code whose greatest possible score
reaches the k-th best least possible one, which gives the exact best of the probed cells: exact altogether if all cells are probed. The exact way scans twice, for the
least scores and for the vectors, ``SLICE`` of them at a time; a task passes on no more than k rows a query, however many candidates there are.

Defined results: a null vector is one of zeros; a null id is last among ties; repeated rows are found each; an empty table gives an empty index, and a search in
it no rows; vectors of another length than the fitted ones raise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import products_in_order
from tessera.operators.workers import ship

SAMPLE = 1 << 16  # vectors that a fit takes at most
ROWS_A_FILE = 1 << 20
DIGITS = 10  # scores that agree so far are tied
SLICE = 2048  # vectors that are scored together in an exact search
PAIRS = 1 << 16  # pairs of query and candidate that are scored together
_INDEX = "id long, code binary, off float, embedding array<float>, cell int"


@dataclass(frozen=True)
class Quantiser:
    """Centres (cells, dim) and codebooks (parts, words, dim / parts), padded with zeros to a whole number of parts."""

    centres: np.ndarray
    books: np.ndarray
    dim: int

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        """The nearest centre of each vector, the lowest-numbered of equal ones."""
        far = (self.centres**2).sum(1)
        return np.concatenate([np.argmin(far - 2 * x[a: a + 4096] @ self.centres.T, 1) for a in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, code, distance between the vector and what its code says)."""
        x = self.widened(x)
        cell = self.cells_of(x)
        rest = (x - self.centres[cell]).reshape(len(x), len(self.books), -1)
        code = np.stack([nearest(rest[:, m], self.books[m]) for m in range(len(self.books))], 1).astype(np.uint8)
        return cell, code, np.sqrt(((rest - self.decoded(code)) ** 2).sum((1, 2)))

    def decoded(self, code: np.ndarray) -> np.ndarray:
        return self.books[np.arange(len(self.books)), code]

    def said(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        return self.centres[cell] + self.decoded(code).reshape(len(code), -1)

    def widened(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != self.dim:
            raise ValueError(f"the index is of vectors of {self.dim} numbers")
        return np.pad(x, ((0, 0), (0, self.centres.shape[1] - self.dim)))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    far = (centres**2).sum(1)
    return np.concatenate([np.argmin(far - 2 * x[a: a + 8192] @ centres.T, 1) for a in range(0, len(x), 8192)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """``k`` centres (fewer if there are fewer distinct vectors): Lloyd's rounds from distinct rows; an emptied centre takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        lost = np.flatnonzero(n == 0)
        if len(lost):
            far = ((x - centres[own]) ** 2).sum(1)
            centres[lost] = x[np.argsort(-far, kind="stable")[: len(lost)]]
    return centres


def fit(vectors: DataFrame, cells: int = 256, parts: int = 8, words: int = 256, sample: int = SAMPLE, seed: int = 1, vector: str = "embedding", key: str = "id") -> Quantiser | None:
    """Centres and codebooks from ``sample`` vectors at most, those of the smallest hashes of key and vector; None of an empty table."""
    if not 1 <= words <= 256:
        raise ValueError("a code has one byte a part")
    taken = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key, vector)).limit(sample).select(F.col(vector).cast("array<double>")).toArrow()
    if not taken.num_rows:
        return None
    x = _matrix(taken.column(0).combine_chunks())
    dim = x.shape[1]
    parts = min(parts, dim)
    x = np.pad(x, ((0, 0), (0, -dim % parts)))
    centres = k_means(x, cells, seed)
    rest = (x - centres[nearest(x, centres)]).reshape(len(x), parts, -1)
    books = [k_means(rest[:, m], words, seed + 1 + m) for m in range(parts)]
    books = np.stack([np.concatenate([b, np.repeat(b[:1], words - len(b), 0)]) for b in books])
    return Quantiser(centres, books, dim)


def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, dim) doubles of a list column; null lists are zeros."""
    lens = np.asarray(column.value_lengths().fill_null(0), np.int64)
    dim = int(lens.max()) if len(lens) else 0
    if ((lens != dim) & np.asarray(column.is_valid())).any():
        raise ValueError("vectors differ in length")
    out = np.zeros((len(column), dim))
    out[np.asarray(column.is_valid())] = np.asarray(column.flatten().cast(pa.float64()).fill_null(0.0)).reshape(-1, dim) if dim else 0
    return out


def _padded(column: pa.Array, dim: int) -> np.ndarray:
    x = _matrix(column)
    return x if x.shape[1] else np.zeros((len(column), dim))


@dataclass(frozen=True)
class VectorIndex:
    path: str
    quantiser: Quantiser | None

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_INDEX).parquet(self.path)


def build(vectors: DataFrame, quantiser: Quantiser | None, path: str, key: str = "id", vector: str = "embedding", rows_a_file: int = ROWS_A_FILE) -> VectorIndex:
    """Write every row of ``vectors`` to its cell. A cell of very many vectors is dealt out to several tasks and files by the vectors' ids."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("embedding"))
    if quantiser is None:
        if not rows.isEmpty():
            raise ValueError("only an empty table has no quantiser")
        spark.createDataFrame([], _INDEX).write.mode("overwrite").parquet(path)
        return VectorIndex(path, None)
    shared = spark.sparkContext.broadcast(quantiser)

    def run(batches):
        q = shared.value
        for batch in batches:
            cell, code, off = q.encode(_padded(batch.column(1), q.dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(off.astype(np.float32) * np.float32(1 + 1e-5)), batch.column(1), pa.array(cell.astype(np.int32))],
                ["id", "code", "off", "embedding", "cell"],
            )

    coded = rows.mapInArrow(run, _INDEX)
    sizes = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / rows_a_file).cast("int").alias("files"))
    dealt = coded.join(F.broadcast(sizes), "cell")  # a row a cell
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", "code"), F.col("files"))).repartition("cell", "part")
    dealt.select("id", "code", "off", "embedding", "cell").write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy("cell").parquet(path)
    return VectorIndex(path, quantiser)


def _blocks(queries: DataFrame, key: str, vector: str, size: int) -> Iterator[tuple[list, np.ndarray]]:
    keys, rows = [], []
    for r in queries.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).toLocalIterator():
        keys.append(r["k"])
        rows.append(r["v"])
        if len(keys) >= size:
            yield keys, rows
            keys, rows = [], []
    if keys:
        yield keys, rows


def _greatest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[-k]) if len(values) >= k else -np.inf


def _code(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts)


def _candidates(index: DataFrame, quantiser: Quantiser, x: np.ndarray, probed: np.ndarray, keep: int) -> DataFrame:
    """q, cell, id, low: of each task the codes that may be among the ``keep`` best of a query by what the task has seen; low is the code's score."""
    asked: dict[int, list[int]] = {}
    for q, cells in enumerate(probed.tolist()):
        for c in cells:
            asked.setdefault(c, []).append(q)
    shared = index.sparkSession.sparkContext.broadcast((quantiser, x, asked))

    def run(batches):
        quantiser, x, asked = shared.value
        parts = np.arange(len(quantiser.books))
        tables = np.einsum("qmd,mwd->qmw", x.reshape(len(x), len(parts), -1), quantiser.books)
        base = x @ quantiser.centres.T
        best = [np.zeros(0)] * len(x)  # the greatest scores of each query so far
        for batch in batches:
            cell, ids = np.asarray(batch.column(3)), np.asarray(batch.column(0).fill_null(np.iinfo(np.int64).max))
            code = _code(batch.column(1), len(parts))
            for c in np.unique(cell).tolist():
                rows, out = np.flatnonzero(cell == c), []
                for q in asked.get(c, ()):
                    score = base[q, c] + tables[q][parts, code[rows]].sum(1)
                    seen = np.concatenate([best[q], score])
                    floor = _greatest(seen, keep)
                    best[q] = np.sort(seen)[-keep:]
                    use = np.flatnonzero(score >= floor)
                    use = use[np.lexsort((ids[rows[use]], -score[use]))[:keep]]  # of equal scores the least ids, so that no number of copies is passed on
                    if len(use):
                        out.append((np.full(len(use), q, np.int32), np.full(len(use), c, np.int32), rows[use], score[use]))
                if out:
                    q, c, rows, low = (np.concatenate(z) for z in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), batch.column(0).take(pa.array(rows)), pa.array(low)], ["q", "cell", "id", "low"])

    cells = [int(c) for c in asked]
    scanned = index.where(F.col("cell").isin(cells)).select("id", "code", "off", "cell")  # reads these folders only
    return scanned.mapInArrow(run, "q int, cell int, id long, low double")


class _Bounds:
    """Which cells a query probes, and the interval in which a vector's score lies by its code."""

    def __init__(self, quantiser: Quantiser, x: np.ndarray, probed: np.ndarray):
        self.quantiser, self.x = quantiser, x
        self.asks = np.zeros((len(x), len(quantiser.centres)), bool)
        np.put_along_axis(self.asks, probed, True, 1)
        self.size = np.sqrt((x**2).sum(1))[:, None] * (1 + 1e-9) + 1e-12

    def of(self, batch: pa.RecordBatch):
        """(low, high), each (queries, vectors), of a slice with the columns code, off and cell from the second on; -inf where a query doesn't probe the cell."""
        cell = np.asarray(batch.column(3))
        middle = self.x @ self.quantiser.said(cell, _code(batch.column(1), len(self.quantiser.books))).T
        middle[~self.asks[:, cell]] = -np.inf
        margin = self.size * np.asarray(batch.column(2), np.float64)
        return middle - margin, middle + margin


def _slices(batches, size: int = SLICE):
    for batch in batches:
        for a in range(0, batch.num_rows, size):
            yield batch.slice(a, size)


def _floors(index: DataFrame, bounds, n: int, k: int) -> np.ndarray:
    """The k-th greatest low of each of the ``n`` queries; -inf where there are fewer."""

    def run(batches):
        best = np.full((n, k), -np.inf)
        for part in _slices(batches):
            low, _ = bounds.value.of(part)
            rows = np.flatnonzero((low > best.min(1)[:, None]).any(1))
            both = np.concatenate([best[rows], low[rows]], 1)
            best[rows] = np.partition(both, both.shape[1] - k, 1)[:, -k:]
        q, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, at])], ["q", "low"])

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("low")))
    out = np.full(n, -np.inf)
    for r in index.select("id", "code", "off", "cell").mapInArrow(run, "q int, low double").withColumn("n", place).where(F.col("n") == k).select("q", "low").collect():  # a row a query of this turn
        out[r["q"]] = r["low"]
    return out


def _exact(index: DataFrame, quantiser: Quantiser, x: np.ndarray, probed: np.ndarray, k: int) -> DataFrame:
    """q, id, score: of each task the k best of a query among the vectors whose greatest possible score reaches the query's floor."""
    context = index.sparkSession.sparkContext
    index = index.where(F.col("cell").isin([int(c) for c in np.unique(probed)]))  # reads these folders only
    bounds = context.broadcast(_Bounds(quantiser, x, probed))
    floors = context.broadcast(_floors(index, bounds, len(x), k) - 10.0**-DIGITS)  # scores are rounded
    dim = quantiser.dim

    def run(batches):
        own, least = bounds.value, floors.value[:, None]
        x = own.x[:, :dim]
        slack = 1e-9 * (1 + own.size)  # of a matrix product, times the greatest vector
        best = np.full((len(x), k), -np.inf)  # rounded scores, the greatest first
        ids, null = np.zeros((len(x), k), np.int64), np.ones((len(x), k), bool)
        for part in _slices(batches):
            _, high = own.of(part)
            able = (high >= least) & (high > -np.inf)
            rows = np.flatnonzero(able.any(0))
            if not len(rows):
                continue
            v = _padded(part.column(4), dim)[rows]
            rough = x @ v.T
            near = able[:, rows] & (rough >= best[:, -1:] - 10.0**-DIGITS - slack * np.sqrt((v**2).sum(1).max() + 1))
            if len(rows) > k:  # no more than these can be among the k best of the slice
                rough[~able[:, rows]] = -np.inf
                near &= rough >= np.partition(rough, len(rows) - k, 1)[:, [len(rows) - k]] - 10.0**-DIGITS - slack * np.sqrt((v**2).sum(1).max() + 1)
            q, at = np.nonzero(near)
            if not len(q):
                continue
            score = np.round(products_in_order(v, x, at, q, PAIRS), DIGITS) + 0.0
            id_ = part.column(0).take(pa.array(rows[at]))
            turn = np.unique(q)
            q = np.concatenate([q, np.repeat(turn, k)])
            score = np.concatenate([score, best[turn].reshape(-1)])
            none = np.concatenate([np.asarray(id_.is_null()), null[turn].reshape(-1)])
            key = np.concatenate([np.asarray(id_.fill_null(0)), ids[turn].reshape(-1)])
            order = np.lexsort((key, none, -score, q))
            order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]  # each of them has k rows of before at least
            best[turn], ids[turn], null[turn] = (y[order].reshape(-1, k) for y in (score, key, none))
        q, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids[q, at], mask=null[q, at]), pa.array(best[q, at])], ["q", "id", "score"])

    return index.select("id", "code", "off", "cell", "embedding").mapInArrow(run, "q int, id long, score double")


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = 16, refine: int | None = 20, key: str = "query_id", vector: str = "embedding", together: int = 512) -> DataFrame:
    """query_id, rank, id, score: the k best of the ``probes`` cells nearest to each query (None: of all cells), ties by id; queries are asked ``together`` at a time."""
    spark = queries.sparkSession
    ship(spark)
    kind = queries.schema[key].dataType.simpleString()
    empty = spark.createDataFrame([], f"{key} {kind}, rank int, id long, score double")
    if index.quantiser is None or k < 1:
        return empty
    stored, quantiser, parts = index.read(spark), index.quantiser, []
    for keys, rows in _blocks(queries, key, vector, together):
        x = quantiser.widened(_padded(pa.array(rows, pa.list_(pa.float64())), quantiser.dim))
        near = x @ quantiser.centres.T  # cells by inner product of their centres, as the vectors
        n = len(quantiser.centres) if probes is None else min(probes, len(quantiser.centres))
        probed = np.argsort(-near, axis=1, kind="stable")[:, :n]
        if refine is None:
            parts.append(_named(_exact(stored, quantiser, x, probed, k), keys, kind, key, k))
            continue
        found = _candidates(stored, quantiser, x, probed, k * refine)
        order = Window.partitionBy("q").orderBy(F.desc("low"), F.asc_nulls_last("id"))
        chosen = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k * refine).select("q", "cell", "id")
        chosen = chosen.groupBy("cell", "id").agg(F.collect_set("q").alias("qs"))  # no more than the queries of this turn
        cells = sorted({int(c) for c in probed.reshape(-1)})
        raw = stored.where(F.col("cell").isin(cells)).select("cell", "id", "embedding")
        same = (raw["cell"] == chosen["cell"]) & raw["id"].eqNullSafe(chosen["id"])
        both = raw.join(chosen, same).select(raw["id"], "embedding", "qs")
        parts.append(_named(_scored(both, x[:, : quantiser.dim]), keys, kind, key, k))
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scored(rows: DataFrame, x: np.ndarray) -> DataFrame:
    """q, id, score: the exact scores of the candidates (id, embedding, qs)."""
    shared = rows.sparkSession.sparkContext.broadcast(x)

    def run(batches):
        x = shared.value
        for batch in batches:
            v = _padded(batch.column(1), x.shape[1])
            qs = batch.column(2)
            n = np.asarray(qs.value_lengths(), np.int64)
            row, q = np.repeat(np.arange(len(n)), n), np.asarray(qs.flatten(), np.int64)
            for a in range(0, len(q), PAIRS):
                i, j = row[a: a + PAIRS], q[a: a + PAIRS]
                score = np.round(products_in_order(v, x, i, j), DIGITS) + 0.0
                yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), batch.column(0).take(pa.array(i)), pa.array(score)], ["q", "id", "score"])

    return rows.mapInArrow(run, "q int, id long, score double")


def _named(scored: DataFrame, keys: list, kind: str, key: str, k: int) -> DataFrame:
    """The k best of each query, under its own key."""
    names = scored.sparkSession.createDataFrame(list(enumerate(keys)), f"q int, {key} {kind}")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), "q").select(key, "rank", "id", "score")  # a row a query of this turn
