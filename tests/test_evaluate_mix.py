"""Metrics against plain loops, bootstrap against a plain one, and exact, weighted, partition-independent draws."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators import mix


def plain_metrics(hits, gold, k):
    right = {i: g for i, g in gold.items() if g > 0}
    if not right:
        return (None,) * 4 + (float(not hits),)
    top = hits[:k]
    found = [i in right for i in top]
    dcg = sum((2 ** right[i] - 1) / math.log2(r + 2) for r, i in enumerate(top) if i in right)
    best = sum((2**g - 1) / math.log2(r + 2) for r, g in enumerate(sorted(right.values(), reverse=True)[:k]))
    return (sum(found) / len(top) if top else 0.0, sum(found) / len(right), next((1 / (r + 1) for r, f in enumerate(found) if f), 0.0), dcg / best, float(bool(hits)))


def test_metrics_equal_plain_loops(spark):
    rng = np.random.default_rng(1)
    hits = {q: rng.permutation(12)[: rng.integers(0, 6)].tolist() for q in range(40)}
    gold = {q: {int(i): int(rng.integers(0, 4)) for i in rng.permutation(12)[: rng.integers(0, 5)]} for q in range(40)}
    h = spark.createDataFrame([(q, r + 1, i) for q, v in hits.items() for r, i in enumerate(v)] + [(99, 1, 1)], "query_id long, rank int, id long")
    g = spark.createDataFrame([(q, i, x) for q, v in gold.items() for i, x in v.items()] * 2, "query_id long, id long, grade int")
    got = {r[0]: tuple(r)[1:] for r in E.retrieval_metrics(spark.range(40).withColumnRenamed("id", "query_id"), h, g, k=3).collect()}
    assert got.keys() == hits.keys()
    for q in hits:
        want = plain_metrics(hits[q], gold[q], 3)
        assert all((a is None and b is None) or a == pytest.approx(b) for a, b in zip(got[q], want))


def test_bootstrap(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.random() < 0.3), None if i % 4 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "query_id long, hit double, rare double")
    one = E.bootstrap(df, ["hit", "rare"], replicates=300, seed=7).orderBy("metric").collect()
    assert one == E.bootstrap(df.repartition(7), ["hit", "rare"], replicates=300, seed=7).orderBy("metric").collect()
    assert one != E.bootstrap(df, ["hit", "rare"], replicates=300, seed=8).orderBy("metric").collect()
    hit = one[0]
    p = np.mean([r[1] for r in rows])
    half = 1.96 * math.sqrt(p * (1 - p) / 400)
    assert hit["mean"] == pytest.approx(p) and hit["low"] == pytest.approx(p - half, abs=0.02) and hit["high"] == pytest.approx(p + half, abs=0.02)
    assert one[1]["n"] == 100 and one[1]["low"] < one[1]["mean"] < one[1]["high"]
    keys = np.array([r[0] for r in df.select(F.xxhash64("query_id")).collect()], np.int64).view(np.uint64)
    w = E.poisson_counts(keys, 300, 7)
    means = (np.array([r[1] for r in rows]) @ w) / w.sum(0)
    assert (hit["low"], hit["high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05


def test_paired(spark):
    base = spark.createDataFrame([(i, i % 2 / 1.0) for i in range(200)], "query_id long, f double")
    better = base.select("query_id", (F.col("f") + (F.col("query_id") % 5 == 0).cast("double")).alias("f"))
    r = E.paired(better, base, ["f"], 400).first()
    assert r["mean"] == pytest.approx(0.2) and r["low"] > 0 and r["p_value"] < 0.01
    same = E.paired(base, base, ["f"], 100).first()
    assert same["mean"] == same["low"] == same["high"] == 0 and same["p_value"] == 1.0
    none = E.bootstrap(base.limit(0), ["f"], 10).collect()
    assert [(x["n"], x["mean"], x["low"]) for x in none] in ([], [(0, None, None)])


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 60), max_size=6), st.integers(0, 150), st.sampled_from([0.5, 1.0, 3.0]))
def test_allocations_add_up(sizes, total, temperature):
    got = mix.allocate(sizes, total, temperature)
    assert sum(got.values()) == min(total, sum(sizes.values())) and all(0 <= got[s] <= sizes[s] for s in sizes)


def test_allocation_shares():
    assert mix.allocate({"a": 900, "b": 100}, 100) == {"a": 90, "b": 10}
    assert mix.allocate({"a": 900, "b": 100}, 100, temperature=2.0) == {"a": 75, "b": 25}
    assert mix.allocate({"a": 900, "b": 100, "c": 5}, 200, weights={"a": 1, "b": 9, "c": 0}) == {"a": 100, "b": 100, "c": 0}
    with pytest.raises(ValueError):
        mix.allocate({"a": 1}, 1, temperature=0)


def test_draws_are_exact_and_independent_of_partitions(spark):
    rows = [(i, ["a", "b", None][min(2, i % 7)], i % 3) for i in range(7000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, step int")
    wanted = {"a": 700, "b": 1, None: 2500, "absent": 9}
    got = mix.draw(df, wanted, ["doc_id"])
    assert got.columns == df.columns
    ids = sorted(r["doc_id"] for r in got.collect())
    assert Counter(rows[i][1] for i in ids) == {"a": 700, "b": 1, None: 2500} and len(set(ids)) == len(ids)
    assert ids == sorted(r["doc_id"] for r in mix.draw(df.repartition(9), wanted, ["doc_id"]).collect())
    assert ids != sorted(r["doc_id"] for r in mix.draw(df, wanted, ["doc_id"], seed=2).collect())
    assert mix.draw(df, {"a": 10**6}, ["doc_id"]).count() == 1000 and mix.draw(df, {}, ["doc_id"]).count() == 0
    copies = spark.createDataFrame([(1, "a")] * 500, "doc_id long, source string")
    assert mix.draw(copies, {"a": 123}, ["doc_id"]).count() == 123


def test_weights_are_met(spark):
    """Rows of a tier of weight 4 come about four times as often while few are drawn; weight 0 last of all."""
    df = spark.createDataFrame([(i, "s", i % 3) for i in range(30_000)], "doc_id long, source string, tier int")
    weight = F.when(F.col("tier") == 0, 4.0).when(F.col("tier") == 1, 1.0)
    n = Counter(r["tier"] for r in mix.draw(df, {"s": 1000}, ["doc_id"], weight=weight).collect())
    assert sum(n.values()) == 1000 and n[2] == 0 and 3.2 < n[0] / n[1] < 5
    n = Counter(r["tier"] for r in mix.draw(df, {"s": 20_001}, ["doc_id"], weight=weight).collect())
    assert n == {0: 10_000, 1: 10_000, 2: 1}
    assert sum(mix.shares(df, 77).values()) == 77
