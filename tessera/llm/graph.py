"""Connected components by alternating large and small stars, written to the shared folder after each round.

Before each round a task makes stars of the edges it has read, some at a time, which shortens the chains that rounds would halve one by one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lean, remove, ship, work_path

TOGETHER = 1 << 18  # edges that a task joins at a time


def stars(edges):
    """(node, root) rows that connect what the edges (a, b) connect; the root is the smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := find(x)) != x]


def _contract(batches):
    held, n = [], 0

    def flush():
        found = list(zip(*stars(x for a, b in held for x in zip(a, b)))) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        n += batch.num_rows
        if n >= TOGETHER:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component. ``edges``: long columns a, b."""
    spark = edges.sparkSession
    ship(spark)
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    last, before = None, None
    for _ in range(rounds):
        path = work_path(spark, "edges")
        e.write.parquet(path)
        e = spark.read.schema("a long, b long").parquet(path)
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before:
            remove(spark, before)
        before = path
        if tuple(state) == last:
            break
        last = tuple(state)
        e = e.mapInArrow(lean(_contract), "a long, b long")
        both = e.union(e.select("b", "a").toDF("a", "b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
    else:
        raise RuntimeError("the components didn't settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
