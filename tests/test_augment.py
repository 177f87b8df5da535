"""Hard negatives against planted positives, threads, and streams that keep the first row of a key."""

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import augment as A
from tessera.streaming.incremental import follow_first


def test_no_planted_positive_among_negatives(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = lambda s: " ".join(f"{s}{i}" for i in range(40))
    texts = [(1, base), (2, base.replace("w59", "x")), (3, base.upper()), (4, other("a")), (5, other("b") + " the answer is 42 or so"), (6, other("a")), (7, ""), (8, None), (9, other("c")), (10, "answer is 421")]
    hits = [(1, r + 1, i) for r, i in enumerate([1, 2, 3, 6, 4, 5, 7, 8, 9, 10, 77])] + [(1, 20, 9), (2, 1, 1), (2, 2, 4)]
    t = spark.createDataFrame(texts, "id long, text string")
    h = spark.createDataFrame(hits, "query_id long, rank int, id long")
    p = spark.createDataFrame([(1, 1), (1, 1), (3, 4)], "query_id long, id long")
    a = spark.createDataFrame([(1, "Answer is 42"), (1, None), (2, "")], "query_id long, answer string")
    got = [tuple(r) for r in A.hard_negatives(h, p, t, a, k=5).orderBy("query_id", "place").collect()]
    assert got == [(1, 1, 6, 4), (1, 2, 9, 9), (1, 3, 10, 10), (2, 1, 1, 1), (2, 2, 4, 2)]
    assert [r["id"] for r in A.hard_negatives(h, p, t, a, k=1).orderBy("query_id").collect()] == [6, 1]
    assert [r["id"] for r in A.hard_negatives(h.where("query_id = 1"), p, t, k=9).orderBy("place").collect()] == [6, 5, 9, 10]
    assert A.hard_negatives(h.limit(0), p, t, a).count() == 0


def test_likeness_is_exact(spark):
    df = spark.createDataFrame([(1, list("abcdef"), list("abcdeg")), (2, list("ab"), list("ab")), (3, [], ["a"]), (4, None, None)], "k long, x array<string>, y array<string>")
    assert [r["likeness"] for r in A.likeness(df, ["k"], "x", "y", 5).orderBy("k").collect()] == [1 / 3, 1.0, 0.0, 0.0]


def test_threads(spark):
    pairs = [("s", i, f"q{i}", f"a{i}") for i in range(5)] + [("t", 0, "q", " "), ("t", 1, "Q", "A"), (None, 0, "q", "a"), ("u", None, "q", "a")]
    got = [tuple(r) for r in A.threads(spark.createDataFrame(pairs, "source string, pos long, question string, answer string"), 2).orderBy("conv_id", "turn").collect()]
    want = [(f"s-{i // 2}", 2 * (i % 2) + j, ("user", "assistant")[j], f"{'qa'[j]}{i}") for i in range(5) for j in range(2)] + [("t-0", 2, "user", "Q"), ("t-0", 3, "assistant", "A")]
    assert got == want
    with pytest.raises(ValueError):
        A.threads(spark.createDataFrame(pairs, "source string, pos long, question string, answer string"), 0)


def test_stream_keeps_the_first_of_a_key_over_restarts(spark, tmp_path):
    def deliver(name, rows):
        Path(f"{tmp_path}/in").mkdir(exist_ok=True)
        Path(f"{tmp_path}/in/{name}").write_text("".join(json.dumps(r) + "\n" for r in rows))

    def go():
        q = follow_first(spark, f"{tmp_path}/in", "k long, v string", lambda d: d.withColumn("v", F.upper("v")), f"{tmp_path}/out", ["k"], f"{tmp_path}/state", files=1)
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(((r["k"], r["v"]) for r in spark.read.schema("k long, v string").json(f"{tmp_path}/out").collect()), key=repr)

    deliver("1.json", [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}, {"k": None, "v": "n"}])
    assert go() == [(1, "A"), (2, "B"), (None, "N")]
    deliver("2.json", [{"k": 2, "v": "z"}, {"k": 3, "v": "c"}, {"k": None, "v": "again"}])
    deliver("3.json", [{"k": 3, "v": "z"}, {"k": 4, "v": None}])
    got = go()  # a new query on the old checkpoint
    assert {k: v for k, v in got if k in (1, 2, None)} == {1: "A", 2: "B", None: "N"} and Counter(k for k, _ in got) == Counter([1, 2, 3, 4, None])
    assert go() == got  # nothing new
