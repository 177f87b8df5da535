"""Token matching of candidate and reference: every token with its nearest one on the other side, rarer tokens counting more.

Recall is the weighted mean, over the reference's tokens, of the greatest similarity with a token of the candidate; precision the same the other way round; f their
harmonic mean. Tokens come with vectors (of any encoder); similarities are inner products of the vectors scaled to length 1. Weights are the inverse
document frequencies of the references' tokens, log((n + 1) / (df + 1)), counted over all references by a plain aggregation; a token that no reference has
weighs log(n + 1). The products of two long texts are made in blocks, so memory doesn't follow the product of their lengths.

Defined results: without tokens on either side all measures are 0; null vectors are zeros, which match nothing; if all weights of a side are 0, its tokens weigh the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.workers import ship

BLOCK = 2048


def document_frequencies(references: DataFrame, key: str = "pair_id") -> DataFrame:
    """token, weight: of all tokens of ``references`` (key, tokens), each text counted once a token."""
    n = references.select(F.count(F.lit(1)).alias("n"))
    df = references.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(n).select("token", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("weight"))  # n is one row


def weighted(texts: DataFrame, weights: DataFrame, key: str = "pair_id") -> DataFrame:
    """key and ``weights``: the weight of each token of ``texts`` (key, tokens), in order; tokens without one get null."""
    each = texts.select(key, F.posexplode("tokens").alias("at", "token"))
    joined = each.join(weights, "token", "left")
    return joined.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "weight"))), lambda x: x["weight"]).alias("weights"))


def _unit(vectors: pa.Array | None) -> np.ndarray:
    """(tokens, dim) of a list of vectors, each scaled to length 1; nulls and missing places are zeros."""
    if vectors is None or not len(vectors):
        return np.zeros((0, 0))
    n = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    out = np.zeros((len(n), int(n.max())))
    out[np.arange(out.shape[1]) < n[:, None]] = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    size = np.sqrt((out**2).sum(1))
    return out / np.where(size > 0, size, 1)[:, None]


def best_matches(a: np.ndarray, b: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The greatest inner product of each row of a with any of b, and of each of b with any of a."""
    one, two = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
    for i in range(0, len(a), block):
        for j in range(0, len(b), block):
            s = a[i: i + block] @ b[j: j + block].T
            one[i: i + block] = np.maximum(one[i: i + block], s.max(1))
            two[j: j + block] = np.maximum(two[j: j + block], s.max(0))
    return one, two


def mean(values: np.ndarray, weights: np.ndarray) -> float:
    total = weights.sum()
    return float((values * weights).sum() / total) if total > 0 else float(values.mean())


def measures(reference: np.ndarray, candidate: np.ndarray, w_reference: np.ndarray, w_candidate: np.ndarray) -> tuple[float, float, float]:
    if not len(reference) or not len(candidate):
        return 0.0, 0.0, 0.0
    r, p = best_matches(reference, candidate)
    recall, precision = mean(r, w_reference), mean(p, w_candidate)
    both = precision + recall
    return precision, recall, 2 * precision * recall / both if both > 0 else 0.0


def token_scores(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """key, precision, recall and f of ``pairs``: key, reference and candidate (arrays of vectors), reference_weights and candidate_weights (arrays; null: all 1;
    a null within: the greatest weight there is on the row)."""
    ship(pairs.sparkSession)
    kind = pairs.schema[key].dataType.simpleString()

    def weights(given, n: int, top: float) -> np.ndarray:
        return np.ones(n) if given is None else np.where(np.isnan(given), top, given)

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):  # one pair of texts at a time
                r, c, wr, wc = (x.values if x.is_valid else None for x in (batch.column(j)[i] for j in range(1, 5)))
                wr, wc = (None if w is None else w.cast(pa.float64()).to_numpy(zero_copy_only=False) for w in (wr, wc))  # null: NaN
                known = np.concatenate([w[~np.isnan(w)] for w in (wr, wc) if w is not None] or [np.zeros(0)])
                top = known.max() if len(known) else 1.0
                r, c = _unit(r), _unit(c)
                rows.append(measures(r, c, weights(wr, len(r), top), weights(wc, len(c), top)))
            got = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in got)], [key, "precision", "recall", "f"])

    columns = pairs.select(key, "reference", "candidate", "reference_weights", "candidate_weights")
    return columns.mapInArrow(run, f"`{key}` {kind}, precision double, recall double, f double")
