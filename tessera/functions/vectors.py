"""Vector functions over array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    v = v.cast("array<double>")
    return F.transform(v, lambda x: x / F.greatest(F.sqrt(dot(v, v)), F.lit(eps)))


def masked_mean(tokens: Column, mask: Column, dim: int) -> Column:
    """Mean of the token vectors whose mask is 1; array<array<double>> and array<int> in."""
    kept = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    summed = F.aggregate(
        F.arrays_zip(tokens.alias("t"), mask.alias("m")), F.array_repeat(F.lit(0.0), dim),
        lambda s, x: F.zip_with(s, x["t"], lambda a, b: a + b.cast("double") * x["m"]),
    )
    return F.transform(summed, lambda x: x / F.greatest(kept, F.lit(1e-9)))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, mask: Column | None = None, into: str = "pooled") -> DataFrame:
    """The masked mean of each group's vectors (all of one length), summed by position before the shuffle, so no group meets in one row."""
    weight = F.lit(1.0) if mask is None else mask.cast("double")
    each = df.select(*keys, weight.alias("__m"), F.posexplode(vector).alias("__i", "__x"))
    sums = each.groupBy(*keys, "__i").agg(F.sum(F.col("__x").cast("double") * F.col("__m")).alias("s"), F.sum("__m").alias("m"))
    mean = F.struct("__i", (F.col("s") / F.greatest("m", F.lit(1e-9))).alias("v"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(mean)), lambda x: x["v"]).alias(into))


def products_in_order(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, size: int = 1 << 16) -> np.ndarray:
    """The inner product of row i of a and row j of b for each pair, summed from the first place to the last: the same number in any batch, as a loop gives it. Rows of zeros cost nothing."""
    out = np.zeros(len(i))
    pairs = np.flatnonzero(a.any(1)[i] & b.any(1)[j])
    for s in range(0, len(pairs), size):
        p = pairs[s: s + size]
        left, right = i[p], j[p]
        total = np.zeros(len(p))
        for d in range(a.shape[1]):
            total += a[left, d] * b[right, d]
        out[p] = total
    return out
