"""BM25 over segments against every document scored plainly, and late interaction against plain loops."""

import math
import re

import numpy as np
import pytest

from tessera.operators import bm25
from tessera.operators.rerank import late_score, rerank

WORD = re.compile(r"\w+")


def plain(docs, asked, k, k1=1.2, b=0.75):
    toks = [(i, WORD.findall((t or "").lower())) for i, t in docs]
    n, mean = len(docs), sum(len(t) for _, t in toks) / max(1, len(docs))
    df = {}
    for _, t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = {}
    for q, text in asked:
        rows = []
        for i, t in toks:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / mean)) for w in WORD.findall((text or "").lower()) if w in t)
            if s > 0:
                rows.append((-round(s, bm25.DIGITS), i is None, i or 0))
        out[q] = [(None if none else i, -s) for s, none, i in sorted(rows)[:k]]
    return {q: v for q, v in out.items() if v}


def found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return got


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [i for i, _ in a[q]] == [i for i, _ in b[q]]
        assert np.allclose([s for _, s in a[q]], [s for _, s in b[q]], atol=1e-8)


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    weights = 1 / np.arange(1, 61)
    return [(i, " ".join(rng.choice(words, size=rng.integers(1, 40), p=weights / weights.sum()))) for i in range(n)]


def test_segments_equal_plain_scores(spark, tmp_path):
    docs = corpus(500, 3)
    asked = [(1, "w0 w5 w59 w59"), (2, "w1"), (3, "w40 w41 w42"), (4, "nothing"), (5, None)]
    path = f"{tmp_path}/index"
    frames = [spark.createDataFrame(docs[a:b], "doc_id long, text string") for a, b in ((0, 200), (200, 350), (350, 500))]
    q = spark.createDataFrame(asked, "query_id long, query string")
    for i, f in enumerate(frames):
        bm25.append(path, f"s{i}", f, shard_docs=100)
        have = docs[: (200, 350, 500)[i]]
        same(found(bm25.search(spark, path, q, k=7, together=2)), plain(have, asked, 7))
    bm25.append(path, "s1", frames[1], shard_docs=64)  # again: replaced, not doubled
    same(found(bm25.search(spark, path, q, k=7)), plain(docs, asked, 7))


def test_runs_are_skipped(spark, monkeypatch):
    """With one document far ahead of all others, few runs are scored."""
    import pyarrow as pa

    lists = [["common"] for _ in range(64 * 50)]
    lists[77] = ["rare", "common"]
    row = bm25.shard(pa.array(range(len(lists))), pa.array(lists))
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if i in (2, 4) else pa.array([v]) for i, v in enumerate(row)], bm25._NAMES)
    q = bm25.Questions([["rare"]])
    q.weights[:] = 1.0
    s = bm25._Shard(batch, 0, q, bm25.Bm25(), 1.0)
    bounds = s.bounds(*[q.own[0][0], q.weights])
    assert (bounds > 1e-9).sum() == 1 and bounds.argmax() == 77 // bm25.RUN
    docs, scores = s.scores(q.own[0][0], q.weights, np.array([77 // bm25.RUN]))
    assert docs.tolist() == [77] and bounds.max() >= scores[0]


def test_odd_documents(spark, tmp_path):
    docs = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None), (3, ""), (4, "a " * 9000), (5, "Ä ä_1 B")]
    asked = [(1, "a"), (None, "B"), (3, "ä")]
    path = f"{tmp_path}/odd"
    bm25.append(path, "x", spark.createDataFrame(docs, "doc_id long, text string"), shard_docs=3, shard_words=100)
    got = bm25.search(spark, path, spark.createDataFrame(asked, "query_id long, query string"), k=20)
    same({q: v for q, v in found(got).items()}, plain(docs, asked, 20))
    none = f"{tmp_path}/none"
    bm25.append(none, "x", spark.createDataFrame([], "doc_id long, text string"))
    assert bm25.search(spark, none, spark.createDataFrame(asked, "query_id long, query string")).count() == 0


def test_late_interaction(spark):
    rng = np.random.default_rng(4)
    docs = {i: rng.integers(-4, 5, size=(rng.integers(1, 30), 6)).astype(float) for i in range(40)}
    asked = {q: rng.integers(-4, 5, size=(rng.integers(1, 9), 6)).astype(float) for q in range(5)}
    pairs = [(q, i) for q in asked for i in range(q, 40, 2)] + [(0, 0), (1, 99), (7, 1)]
    m = spark.createDataFrame([(i, x.tolist()) for i, x in docs.items()] + [(500, [[9.0] * 6])], "id long, tokens array<array<double>>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in asked.items()] + [(8, None)], "query_id long, tokens array<array<double>>")
    got = found(rerank(spark.createDataFrame(pairs + [(8, 3), (8, 2)], "query_id long, id long"), m, q, k=4))
    want = {}
    for a, i in sorted(set(pairs + [(8, 3), (8, 2)])):
        x, d = asked.get(a), docs.get(i)
        s = 0.0 if x is None or d is None else sum(max(float(u @ v) for v in d) for u in x)
        want.setdefault(a, []).append((-s, i))
    assert got == {a: [(i, -s + 0.0) for s, i in sorted(v)[:4]] for a, v in want.items()}
    assert late_score(asked[0], np.concatenate([docs[1]] * 50), block=7) == late_score(asked[0], docs[1])


@pytest.mark.parametrize("kind", ["long", "string"])
def test_candidate_keys_keep_their_type(spark, kind):
    one = "1" if kind == "string" else 1
    m = spark.createDataFrame([(one, [[1.0]])], f"id {kind}, tokens array<array<double>>")
    q = spark.createDataFrame([(one, [[2.0]])], f"query_id {kind}, tokens array<array<double>>")
    assert rerank(spark.createDataFrame([(one, one)], f"query_id {kind}, id {kind}"), m, q).collect() == [(one, 1, one, 2.0)]
