"""Retrieval metrics against a gold set, with bootstrap intervals and paired comparisons.

Metrics are per question and come from joins and sums. Intervals are those of a Poisson bootstrap: in each replicate a question counts as often as a Poisson number of
mean 1 says, which a hash of seed, question and replicate gives, so every task makes its share of all replicates by itself, a run over other partitions
gives the same numbers, and only sums are exchanged: one row a metric and task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.workers import ship

#: P(Poisson(1) <= i)
CUMULATED = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)])
METRICS = ("precision", "recall", "reciprocal_rank", "ndcg", "abstained_right")


def retrieval_metrics(questions: DataFrame, hits: DataFrame, gold: DataFrame, k: int = 3, key: str = "query_id", item: str = "id") -> DataFrame:
    """A row a question: precision, recall, reciprocal_rank and ndcg at ``k``, and abstained_right.

    ``hits``: key, rank (from 1), item; ``gold``: key, item, grade (above 0: right; a pair that is given twice has its greatest grade). A question without right items is unanswerable: it has
    null ranking metrics, and abstained_right says whether it got no hit; for the others it says whether they got one. Precision is over the hits there are, at most k; without any it is 0.
    """
    right = gold.where("grade > 0").groupBy(key, item).agg(F.max("grade").cast("double").alias("grade"))
    place = F.row_number().over(_window(key, F.desc("grade"), item))
    ideal = right.withColumn("place", place).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_right"), F.sum(F.when(F.col("place") <= k, _gain(F.col("grade")) / F.log2(F.col("place") + 1.0)).otherwise(0.0)).alias("best"),
    )
    top = hits.where(F.col("rank") <= k).select(key, "rank", item).distinct()
    marked = top.join(right, [key, item], "left")
    found = marked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_hits"), F.count("grade").alias("n_found"), F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("grade").isNotNull(), _gain(F.col("grade")) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gained"),
    )
    rows = questions.select(key).distinct().join(ideal, key, "left").join(found, key, "left").fillna(0, ["n_right", "n_hits", "n_found"])
    asked = lambda c: F.when(F.col("n_right") > 0, c)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).otherwise(0.0)
    return rows.select(
        key, asked(share("n_found", "n_hits")).alias("precision"), asked(share("n_found", "n_right")).alias("recall"), asked(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        asked(F.coalesce(F.col("gained"), F.lit(0.0)) / F.col("best")).alias("ndcg"), ((F.col("n_right") > 0) == (F.col("n_hits") > 0)).cast("double").alias("abstained_right"),
    )


def _gain(grade):
    return F.pow(F.lit(2.0), grade) - 1.0


def _window(key, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def poisson_counts(keys: np.ndarray, replicates: int, seed: int, first: int = 0) -> np.ndarray:
    """(keys, replicates): how often each key (64-bit) counts in each replicate."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64)[:, None] + (np.arange(first, first + replicates, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C55) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        h ^= h >> np.uint64(31)
    return np.searchsorted(CUMULATED, (h >> np.uint64(11)) * 2.0**-53, side="right")


def bootstrap(rows: DataFrame, metrics: list[str], replicates: int = 1000, seed: int = 1, level: float = 0.95, key: str = "query_id") -> DataFrame:
    """metric, n, mean, low, high and above_zero (share of replicates with a mean above 0, equal ones half) of the columns ``metrics`` of ``rows``, a row a question. Nulls don't count."""
    spark = rows.sparkSession
    ship(spark)
    places = list(metrics)

    def run(batches):
        total, weight = np.zeros((len(places), replicates)), np.zeros((len(places), replicates))
        n, plain = np.zeros(len(places), np.int64), np.zeros(len(places))
        for batch in batches:
            keys = np.asarray(batch.column(0)).view(np.uint64)
            columns = [np.asarray(batch.column(i + 1).cast(pa.float64()).to_numpy(zero_copy_only=False)) for i in range(len(places))]
            for a in range(0, len(keys), 1024):
                w = poisson_counts(keys[a: a + 1024], replicates, seed)
                for i, c in enumerate(columns):
                    own = ~np.isnan(c[a: a + 1024])
                    v = c[a: a + 1024][own]
                    total[i] += v @ w[own]
                    weight[i] += w[own].sum(0)
                    n[i], plain[i] = n[i] + len(v), plain[i] + v.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(places))), pa.array(n), pa.array(plain), pa.array(list(total)), pa.array(list(weight))], ["m", "n", "plain", "total", "weight"])

    parts = rows.select(F.xxhash64(key).alias("h"), *[F.col(m).cast("double") for m in places]).mapInArrow(run, "m long, n long, plain double, total array<double>, weight array<double>")
    flat = parts.select("m", F.posexplode(F.arrays_zip("total", "weight")).alias("r", "x")).groupBy("m", "r").agg(F.sum("x.total").alias("t"), F.sum("x.weight").alias("w"))
    means = flat.where("w > 0").withColumn("mean", F.round(F.col("t") / F.col("w"), 12))  # sums in another order agree so far
    tail = (1 - level) / 2
    spread = means.groupBy("m").agg(
        F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"),
        F.avg(F.when(F.col("mean") > 0, 1.0).when(F.col("mean") == 0, 0.5).otherwise(0.0)).alias("above_zero"),
    )
    whole = parts.groupBy("m").agg(F.sum("n").alias("n"), F.sum("plain").alias("plain"))
    names = F.create_map(*[x for i, m in enumerate(places) for x in (F.lit(i).cast("long"), F.lit(m))])
    mean = F.when(F.col("n") > 0, F.col("plain") / F.when(F.col("n") > 0, F.col("n")))
    return whole.join(spread, "m", "left").select(names[F.col("m")].alias("metric"), "n", mean.alias("mean"), "low", "high", "above_zero")


def paired(one: DataFrame, two: DataFrame, metrics: list[str], replicates: int = 1000, seed: int = 1, level: float = 0.95, key: str = "query_id") -> DataFrame:
    """``bootstrap`` of the differences one - two of questions that both have; p_value is twice the smaller share of replicates on either side of 0."""
    both = one.select(key, *metrics).join(two.select(key, *[F.col(m).alias(f"{m}__two") for m in metrics]), key)
    diff = both.select(key, *[(F.col(m) - F.col(f"{m}__two")).alias(m) for m in metrics])
    out = bootstrap(diff, metrics, replicates, seed, level, key)
    return out.withColumn("p_value", F.least(F.lit(1.0), 2 * F.least(F.col("above_zero"), 1 - F.col("above_zero"))))
