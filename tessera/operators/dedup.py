"""Exact deduplication that keeps the first row in a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.chunk import unused


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key. A min over a struct is combined before the shuffle, so a key that
    very many rows share doesn't gather in one task (a ranking window would)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    own = unused(df.columns, "first")
    least = F.min(F.struct(*[F.col(f"`{c}`") for c in order + rest])).alias(own)
    named = {c: F.col(f"{own}.`{c}`") for c in order + rest}
    return df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(least).select(*[named.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``todo`` not done yet, by a stable key; a null is a key like any other."""
    before = done.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"t.`{k}`").eqNullSafe(F.col(f"d.`{k}`")) for k in keys])
    return todo.alias("t").join(before.alias("d"), same, "left_anti")
