"""Toxicity, collocations and lexical search."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations as C
from tessera.llm import lexical as L
from tessera.llm import registry
from tessera.llm import toxicity as X


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, pa.Table.from_pylist([r.asDict() for r in df.collect()], schema=pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()]) for f in df.schema])))
    return sorted(con.execute(sql).fetchall(), key=repr)


# --- toxicity ---
ORDINARY = "the council met on monday to plan the new road and the bridge over the river near the old mill".split()
MARKED = "blasted rotten wretched".split()


def talk(seed, toxic, n=40):
    rng = np.random.default_rng(seed)
    words = rng.choice(ORDINARY, size=n).tolist()
    if toxic:
        for _ in range(4):
            words[rng.integers(n)] = MARKED[rng.integers(3)]
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    y = [i % 4 == 0 for i in range(1200)]
    return X.fit([talk(i, t) for i, t in enumerate(y)], [int(t) for t in y])


def test_toxic_words_are_told_apart(spark, model):
    rows = [(i, talk(10_000 + i, i % 3 == 0), int(i % 3 == 0)) for i in range(300)]
    got = X.score(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), model).collect()
    assert all((r["score"] >= 0.5) == bool(r["toxic"]) for r in got)


def test_held_out_rows_of_the_tables(spark, sf):
    """Trained on the training rows of a table, few clean held-out documents are called toxic, and most that hold a listed word are."""
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    m = X.train(docs.where(~X.held_out("doc_id")), labels)
    got = X.score(docs.where(X.held_out("doc_id")).join(labels, "doc_id"), m).select("text", "toxic", (F.col("score") >= 0.5).alias("said")).collect()
    clean = [r for r in got if r["toxic"] == 0]
    assert sum(r["said"] for r in clean) <= 0.02 * len(clean)
    assert sum(r["said"] == bool(r["toxic"]) for r in got) >= 0.94 * len(got)
    sworn = [r for r in got if r["toxic"] == 1 and len(re.findall("trash|idiot|scum|loser|moron|clown|stupid|worthless|disgusting|pathetic", r["text"].lower())) >= 3]
    assert sum(r["said"] for r in sworn) >= 0.85 * len(sworn) > 0


def test_query_digests(spark, tmp_path):
    docs = [(i, talk(i, i % 4 == 0), f"n{i}") for i in range(600)] + [(None, "a", "x"), (601, None, "x"), (602, "", "x"), (5, talk(5, False), "again")]
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), i) for i in range(500)] + [(None, 1, 0), (3, None, 0), (3, 7, 0)], "doc_id long, toxic int, text long").write.parquet(f"{tmp_path}/labels.parquet")
    got = registry.QUERIES["op11_zstd_toxicity"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    one = [r["score"] for r in rows if r["doc_id"] == 5]
    assert len(one) == 2 and one[0] == one[1]  # repeated rows
    assert len({r["score"] for r in rows if r["doc_id"] in (601, 602)}) == 1  # empty texts


def test_labels_of_held_out_rows_do_not_matter(spark, tmp_path):
    docs = spark.createDataFrame([(i, talk(i, i % 4 == 0)) for i in range(400)], "doc_id long, text string")
    scores = []
    for flip in (False, True):
        d = f"{tmp_path}/{flip}"
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, int((i % 4 == 0) != (flip and zlib.crc32(str(i).encode()) % 5 == 0))) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
        scores.append(rows_of(registry.QUERIES["op11_zstd_toxicity"](spark, d)))
    assert scores[0] == scores[1]


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for labels, share in (([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)):
        m = X.train(spark.createDataFrame([(i, f"t{i}") for i in range(3)], "doc_id long, text string"), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
        assert {r["score"] for r in X.score(docs, m).collect()} == {share}
    assert X.score(docs.limit(0), m).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100 + str(i)) for i in range(200)] + [(200 + i, "x" * 1000) for i in range(50)] + [(999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, toxic int")
    assert len(X.sample(docs, labels, 20, 1 << 20)[0]) == 20 and len(set(X.sample(docs, labels, 500, 1 << 20)[0])) == 201
    texts, toxic = X.sample(docs, labels, 500, 2000)
    assert sum(map(len, texts)) <= 2000 and len(texts) == len(toxic) > 0
    assert dict(zip(*X.sample(docs, labels, 500, 1 << 20)))["x" * 1000] == 1  # copies with both labels


def test_windows(model):
    long = ("x" * 1000 + " short " + "é" * 200).encode()
    for words in (1, 3):
        text, h, starts, ends, first = X.windows(np.frombuffer(long, np.uint8), np.array([0, 0, len(long)]), words)
        assert set(text.tolist()) == {1} and (ends - starts).max() <= X.LONGEST and len(first) == -(-len(starts) // words)
        assert b"".join(long[a:b] for a, b in zip(starts.tolist(), ends.tolist())) == b"".join(long.split())
    d = X.Differences(model.toxic, model.ordinary, model.lead, 1)
    data = np.frombuffer(b"the blasted mill blasted", np.uint8)
    hist = d.histograms(data, np.array([0, 16, 16, 24]))
    assert hist[:, : X.BINS].sum(1).tolist() == [3, 0, 1] and hist[2, X.MOST + 1: X.BINS].sum() == 1  # the marked word is shorter by the toxic dictionary


# --- collocations ---
def plain_collocations(docs, least, longest=5, top=2000, share=100):
    count, n = Counter(), Counter()
    for lang, t in docs:
        lang = "und" if lang is None else lang
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i: i + k])] += 1
    kept = {}
    frequent = {k: v for k, v in count.items() if v >= least and len(k[1]) > 1}
    for (lang, p), a in frequent.items():
        if any(o == lang and len(q) > len(p) and share * a <= 100 * b and any(q[i: i + len(p)] == p for i in range(len(q))) for (o, q), b in frequent.items()):
            continue
        cuts = [(1000 * a * n[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p))]
        s, _, left, right = min(cuts)
        kept.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in kept.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def some_docs(n, seed):
    rng = np.random.default_rng(seed)
    words = ["a", "B", "c", "ö", "of the", "New York", "x-y", "e.", "f\n", "g\t", "#", "h,i"]
    weights = 1 / np.arange(1, len(words) + 1)
    out = []
    for i in range(n):
        t = rng.choice([" ", "  "]).join(rng.choice(words, size=rng.integers(0, 60), p=weights / weights.sum()))
        out.append(([None, "en", "de"][i % 3], t if i % 17 else None))
    return out


@pytest.mark.parametrize("how", [{}, {"range_bits": 3, "batch_bytes": 500}, {"range_bits": 2, "filter_bytes": 1}])
def test_collocations_equal_plain_counts(spark, how):
    docs = some_docs(240, 1) + [("en", "q r s t u v")] * 9 + [("en", "Q R S T U z")] * 2 + [(None, "")] * 3
    df = spark.createDataFrame(docs, "lang string, text string").repartition(5)
    got = rows_of(C.collocations(df, least=8, top=40, **how))
    assert got == sorted(plain_collocations(docs, 8, top=40), key=repr) and len(got) > 30


def test_share_of_longer_phrases(spark):
    docs = [("en", "a b c")] * 8 + [("en", "a b")] * 2 + [("en", "b c d")] * 3
    df = spark.createDataFrame(docs, "lang string, text string")
    for share in (100, 80, 50):
        assert rows_of(C.collocations(df, least=2, share=share)) == sorted(plain_collocations(docs, 2, share=share), key=repr)


def test_counts_past_255_and_one_hot_phrase(spark):
    docs = [("en", "hot phrase " * 150)] * 20 + [("en", "x y")] * 299 + [("en", "y z")] * 300
    df = spark.createDataFrame(docs, "lang string, text string").repartition(7)
    for least in (255, 300, 400):
        assert rows_of(C.collocations(df, least=least, longest=3, batch_bytes=300)) == sorted(plain_collocations(docs, least, longest=3), key=repr)


def test_collocations_edges(spark):
    none = spark.createDataFrame([], "lang string, text string, n int")
    assert C.collocations(none).count() == 0
    blank = spark.createDataFrame([("en", None, 1), (None, " .,\n", 2), ("", "one", 3)], "lang string, text string, n int")
    assert C.collocations(blank, least=1).count() == 0
    long = spark.createDataFrame([("en", "w" * 200_000 + " v", 1), ("en", "W" * 200_000 + " v", 1)], "lang string, text string, n int")
    assert [(r["a"], r["l"], r["r"], r["n"], r["score"]) for r in C.collocations(long, least=2).collect()] == [(2, 2, 2, 4, 2000)]
    with pytest.raises(ValueError):
        C.phrase_counts(none, least=0)


def test_cells_never_undercount(spark):
    """Every frequent phrase passes the bitmaps, also with far too few cells."""
    docs = [("en", f"w{i % 50} w{i % 7} w{i}") for i in range(3000)]
    df = spark.createDataFrame(docs, "lang string, text string")
    got = {(r["phrase"], r["n"]) for r in C.phrase_counts(df, least=20, longest=2, range_bits=0).collect()}
    count = Counter(w for _, t in docs for w in t.split())
    count.update(" ".join(p) for _, t in docs for p in zip(t.split(), t.split()[1:]))
    assert got == {(p, n) for p, n in count.items() if n >= 20} | {(None, 9000)}


# --- lexical search ---
def linked(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return d, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("how", [{}, {"block_docs": 3}, {"block_docs": 1}, {"block_terms": 20}])
def test_search_equals_sql(spark, how):
    rng = np.random.default_rng(6)
    words = ["the", "Über", "x1", "rare", "a_b", "naïve", "mid", "of", "9", "z"]
    weights = np.array([40, 5, 8, 1, 6, 3, 9, 30, 2, 1]) / 105
    docs = [(i, " ".join(rng.choice(words, size=rng.integers(0, 50), p=weights))) for i in range(160)]
    items = [(i, " ".join(rng.choice(words, size=rng.integers(1, 6), p=np.full(10, 0.1)))) for i in range(12)] + [(50, "absent"), (51, ""), (52, None), (53, "x1 X1 x1")]
    d, q = linked(spark, docs, items)
    got = L.search(L.build_index(d.repartition(4), **how), q, together=7, seeds=2)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(got) == sql_rows(L.OP13_SQL, documents=d, benchmark=q)


def test_search_prunes_blocks(spark):
    """Blocks whose bound is below the threshold aren't scored."""
    docs = [(i, "common words here " * (1 + i % 3)) for i in range(64)] + [(100 + i, "rare rare rare") for i in range(4)]
    d, _ = linked(spark, docs, [(1, "x")])
    index = L.build_index(d.coalesce(1).orderBy("doc_id"), block_docs=4)
    queries = L.Queries(["rare common"])
    queries.weights[:] = [L.weight(64, 68), L.weight(4, 68)]
    batch = pa.Table.from_pylist([{**r.asDict(), "terms": r["terms"]} for r in index.read(spark).orderBy("block").collect()]).combine_chunks().to_batches()[0]
    best, opened = L.Best(queries, 4), 0
    bounds = np.array([L._bounds(queries, queries.matrix(), queries.found(batch.column("terms")[i].values), L.unsqueeze(batch.column("tops")[i].as_py()).astype(np.int64))[0] for i in range(batch.num_rows)])
    for i in np.argsort(-bounds, kind="stable").tolist():
        if bounds[i] < best.floor[0]:
            break
        row = {c: batch.column(c)[i].as_py() for c in ("docs", "sizes", "held", "which", "tfs")}
        scores = L.Block(row, queries.found(batch.column("terms")[i].values)).scores(queries.own[0][0], queries.weights[queries.own[0][0]])
        assert scores.max() <= bounds[i]
        best.add(0, row["docs"], scores)
        opened += 1
    assert opened == 1 and batch.num_rows == 17 and [d for _, _, d in best.rows[0]] == [100, 101, 102, 103]


def test_search_ties_repeats_and_odd_rows(spark):
    docs = [(5, "a b"), (3, "b A"), (3, "a b"), (None, "a b"), (9, None), (8, "!!"), (7, ""), (1, "c " * 70_000 + "é")]
    d, q = linked(spark, docs, [(1, "a"), (1, "a"), (None, "é"), (2, "É")])
    more = d.select("*", F.lit("x").alias("rank"), F.lit(1).alias("q"))
    got = sorted((tuple(r) for r in L.search(L.build_index(more, block_docs=2), q, k=3).collect()), key=repr)
    one = L.weight(4, 5) * L.contribution(1, L.norm(2, 5, 8 + 70_001))
    assert [r[:3] for r in got if r[0] == 1] == [(1, 1, 3), (1, 1, 3), (1, 2, 3), (1, 2, 3), (1, 3, 5), (1, 3, 5)]
    assert {r[3] for r in got if r[0] == 1} == {one} and [r[:3] for r in got if r[0] is None] == [(None, 1, 1)] and not [r for r in got if r[0] == 2]
    none, q = linked(spark, [], [(1, "a")])
    assert L.search(L.build_index(none), q).count() == 0 and L.search(L.build_index(d), q.limit(0)).count() == 0


def test_weights_and_counts(spark):
    d, _ = linked(spark, [(1, "a b c"), (2, "..."), (3, None), (4, "d")], [(1, "a")])
    index = L.build_index(d)
    assert (index.n_docs, index.n_terms) == (2, 4)
    assert L.weight(1, 2) == math.floor(1000 * math.log(2)) and L.terms_of("Ab_c-1é") == ["ab", "c", "1é"]


@pytest.mark.parametrize("name", ["op12_collocations", "op13_block_max"])
def test_queries_equal_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])
