"""Every registered query of the engine's own operators against its SQL."""

import pytest

from tessera.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_documents_without_a_vector_are_searched(spark, tmp_path):
    docs = [(1, "alpha beta", "s"), (2, "alpha beta gamma delta", "s"), (3, "nothing", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta"), (9, "gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, [0.1, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_id"], r["chunk_id"]): r["kw"] for r in catalogue.QUERIES["keyword_score"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1): 0.5, (1, 2): 1.0, (9, 2): 1.0}
    best = {r["query_id"]: r["chunk_id"] for r in catalogue.QUERIES["hybrid_topk"](spark, str(tmp_path)).collect() if r["rank"] == 1}
    assert best == {1: 2, 9: 2}


def test_every_embedding_is_in_a_mean(spark, tmp_path):
    rows = [(i, i % 2, [float(i)] * 64) for i in (2, 3, 4, 6, 9)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["label"]: r["pooled"] for r in catalogue.QUERIES["mean_pool"](spark, str(tmp_path)).collect()}
    assert got == {0: [4.0] * 64, 1: [6.0] * 64}


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "rank", "chunk_id", "vec_score", "kw_score", "score"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
