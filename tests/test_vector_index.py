"""The vector index against all inner products."""

import numpy as np
import pytest

from tessera.operators import vector_index as VI


def brute(rows, asked, k):
    out = {}
    for q, v in asked:
        scored = [(-round(float(np.dot(x, v)), VI.DIGITS) + 0.0, i is None, i) for i, x in rows]
        out[q] = [(i, -s) for s, _, i in sorted(scored, key=lambda t: (t[0], t[1], t[2] or 0))[:k]]
    return out


def found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return got


def table(spark, rows):
    return spark.createDataFrame([(i, [float(y) for y in x]) for i, x in rows], "id long, embedding array<float>")


def asked_of(spark, asked):
    return spark.createDataFrame([(q, [float(y) for y in v]) for q, v in asked], "query_id long, embedding array<double>")


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(40, size=3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32).astype(float)
    x /= np.sqrt((x**2).sum(1))[:, None]
    x = x.astype(np.float32).astype(float)
    rows = list(enumerate(x))
    return rows, [(i, x[i]) for i in range(0, 3000, 50)]


def test_recall_and_exactness(spark, clustered, tmp_path):
    rows, asked = clustered
    df = table(spark, rows)
    q = VI.fit(df, cells=32, parts=8, words=64, sample=1500)
    index = VI.build(df, q, f"{tmp_path}/index")
    assert index.read(spark).count() == len(rows)  # every vector is indexed
    want = brute(rows, asked, 10)
    got = found(VI.search(index, asked_of(spark, asked), k=10, probes=8))
    recall = np.mean([len({i for i, _ in got[a]} & {i for i, _ in want[a]}) / 10 for a, _ in asked])
    assert recall >= 0.9
    exact = found(VI.search(index, asked_of(spark, asked), k=10, probes=None, refine=None, together=25))
    assert {a: [i for i, _ in v] for a, v in exact.items()} == {a: [i for i, _ in v] for a, v in want.items()}
    assert all(abs(s - t) < 1e-9 for a in want for (_, s), (_, t) in zip(exact[a], want[a]))


def test_bounds_hold(clustered, spark):
    """No score leaves the interval that the code and its distance give."""
    rows, asked = clustered
    q = VI.fit(table(spark, rows), cells=16, parts=4, words=16, sample=500)
    x = np.array([v for _, v in rows])
    cell, code, off = q.encode(x)
    wide = q.widened(x)
    said = q.centres[cell] + q.decoded(code).reshape(len(x), -1)
    for _, v in asked[:10]:
        w = q.widened(np.array([v]))[0]
        assert (np.abs(wide @ w - said @ w) <= np.linalg.norm(w) * off + 1e-9).all()


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (5, None), (6, [-1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = VI.build(df, VI.fit(df, cells=4, parts=2), f"{tmp_path}/odd", rows_a_file=2)
    asked = spark.createDataFrame([(9, [1.0, 0.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    got = found(VI.search(index, asked, k=20, probes=None, refine=None))
    assert got[9] == [(1, 1.0), (2, 1.0), (2, 1.0), (None, 1.0), (5, 0.0), (7, 0.0), (6, -1.0)]
    assert [s for _, s in got[8]] == [0.0] * 7
    with pytest.raises(Exception, match="differ in length|of 3 numbers"):
        VI.build(spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>"), index.quantiser, f"{tmp_path}/bad")
    none = df.limit(0)
    assert VI.fit(none) is None
    assert VI.search(VI.build(none, None, f"{tmp_path}/none"), asked).count() == 0


def test_one_hot_cell(spark, tmp_path):
    """A third of all vectors are equal: the cell is dealt out to several files, ties go by id."""
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(300 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 2)) * 0.1)]
    df = table(spark, rows)
    index = VI.build(df, VI.fit(df, cells=3, parts=1, words=8), f"{tmp_path}/hot", rows_a_file=50)
    files = [f for f in index.read(spark).inputFiles()]
    assert len(files) >= 4
    got = found(VI.search(index, asked_of(spark, [(1, [1.0, 0.0])]), k=7, probes=1))
    assert got[1] == [(i, 1.0) for i in range(7)]


def test_exact_search_passes_on_k_rows_a_query(spark, tmp_path):
    """Loose codes make every vector a candidate of every query; a task still passes on k rows a query, and the best are exact."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 12)).astype(np.float32).astype(float)
    x[100:400] = x[0]
    rows = list(enumerate(x))
    df = table(spark, rows)
    index = VI.build(df, VI.fit(df, cells=2, parts=1, words=2), f"{tmp_path}/loose")
    asked = [(i, x[i]) for i in range(0, 3000, 100)]
    q = np.array([v for _, v in asked])
    probed = np.tile(np.arange(2), (len(q), 1))
    stored = index.read(spark).coalesce(2)
    got = VI._exact(stored, index.quantiser, index.quantiser.widened(q), probed, 10)
    assert got.count() <= 2 * 10 * len(asked)
    want, found_ = brute(rows, asked, 10), found(VI.search(index, asked_of(spark, asked), k=10, probes=None, refine=None, together=7))
    assert {a: [i for i, _ in v] for a, v in found_.items()} == {a: [i for i, _ in v] for a, v in want.items()}
