"""Second stage of retrieval: candidates are ranked again by late interaction of token vectors.

A question's score for a document is the sum, over the question's tokens, of the greatest inner product with any of the document's tokens. Only the candidates'
matrices are read from the table of matrices; a document that several questions name is sent once, and its pairs are scored in Arrow batches.

Defined results: a document without a matrix or tokens scores 0 with every question, as does a question without tokens; equal scores go by id, nulls last; scores
that agree to ``DIGITS`` places are ties; repeated candidates count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.workers import ship

DIGITS = 9


def _rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The matrices of a column of lists of vectors, one at a time."""
    for x in column:
        tokens = x.values if x.is_valid else None
        if tokens is None or not len(tokens):
            yield np.zeros((0, 0))
            continue
        flat = np.asarray(tokens.flatten().cast(pa.float64()))
        yield flat.reshape(len(tokens), -1)


def late_score(question: np.ndarray, document: np.ndarray, block: int = 4096) -> float:
    """Sum over the question's rows of their greatest inner product with the document's rows, which are taken ``block`` at a time."""
    if not len(question) or not len(document):
        return 0.0
    best = np.full(len(question), -np.inf)
    for a in range(0, len(document), block):
        best = np.maximum(best, (question @ document[a: a + block].T).max(1))
    return float(best.sum())


def rerank(candidates: DataFrame, matrices: DataFrame, questions: DataFrame, k: int = 3, query: str = "query_id", key: str = "id") -> DataFrame:
    """query_id, rank, id, score of the k best candidates (query_id, id) of each question. ``matrices``: id, tokens; ``questions``: query_id, tokens (both arrays of arrays)."""
    ship(candidates.sparkSession)
    pairs = candidates.select(query, key).distinct()
    asked = questions.select(F.col(query).alias("__q"), F.col("tokens").alias("__asked"))
    wanted = pairs.select(key).distinct().select(F.col(key).alias("__id"))
    held = matrices.select(F.col(key).alias("__key"), "tokens").join(wanted, F.col("__key").eqNullSafe(F.col("__id")), "left_semi")
    both = pairs.join(held, pairs[key].eqNullSafe(held["__key"]), "left").join(asked, pairs[query].eqNullSafe(asked["__q"]), "left").select(query, key, "__asked", "tokens")

    def run(batches):
        for batch in batches:
            score = [late_score(q, d) for q, d in zip(_rows(batch.column(2)), _rows(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(score, DIGITS) + 0.0, pa.float64())], [query, key, "score"])

    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in (query, key))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.asc_nulls_last(key)))
    scored = both.mapInArrow(run, f"{kinds}, score double")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(query, "rank", key, "score")
