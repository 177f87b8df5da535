import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors
from tessera.functions import vocabulary as V
from tessera.operators import chunk as C
from tessera.operators import models as M
from tessera.operators import prompt as P
from tessera.operators import report
from tessera.operators import retrieve as R
from tessera.operators.dedup import keep_first, resume
from tessera.operators.tokenise import byte_level_tokenizer, library_tokenizer, tokenised
from tessera.operators.workers import Lazy
from tessera.plans import corpus

#: question, rank, paragraph, score, keywords hit, keywords, vector score: published results of the manuals.
GOLDEN = [
    (1, 1, "19012", 0.4713, 8, 15, 0.4093), (1, 2, "18001", 0.4599, 7, 15, 0.4531), (1, 3, "30000", 0.4372, 5, 15, 0.5411),
    (2, 1, "81005", 0.5972, 6, 10, 0.5944), (2, 2, "56002", 0.5092, 5, 10, 0.5184), (2, 3, "77005", 0.4832, 5, 10, 0.4664),
    (3, 1, "18052", 0.6195, 6, 10, 0.6390), (3, 2, "22010", 0.6171, 7, 10, 0.5342), (3, 3, "18026", 0.6035, 6, 10, 0.6070),
]
QUESTIONS = {
    1: "Explain how the 25% income variance rule applies to a paying parent's gross weekly income.",
    2: "Under the Child Maintenance (Enforcement) Act 2023, what powers does the department have regarding administrative Liability Orders?",
    3: "How are pension contributions treated when calculating a paying parent's child maintenance liability?",
}
KEYWORDS = {
    1: "25 change changed differ difference differs gross income nrp parent paying rule s variance weekly".split(),
    2: "2023 act administrative child department enforcement liability maintenance orders powers".split(),
    3: "calculating child contributions liability maintenance nrp parent paying pension s".split(),
}


def test_keywords(spark):
    df = spark.createDataFrame(list(QUESTIONS.items()), "q int, t string")
    assert {r[0]: sorted(r[1]) for r in df.select("q", R.keywords(F.col("t"))).collect()} == KEYWORDS


def test_golden_ranking(spark):
    """Texts that have as many keywords as published, vectors with the published scores: the same order and scores."""
    for q, text in QUESTIONS.items():
        own = [g for g in GOLDEN if g[0] == q]
        dim = len(own) + 1
        rows = []
        for i, (_, rank, pid, _, hits, _, v) in enumerate(own):
            e = [0.0] * (dim + 1)
            e[0], e[i + 1] = v, (1 - v * v) ** 0.5
            rows.append((100 - i, pid, "manual", " ".join(KEYWORDS[q][:hits]), e))
        index = spark.createDataFrame(rows, "chunk_id long, paragraph_id string, source_doc string, text string, embedding array<double>")
        asked = spark.createDataFrame([(q, text, [1.0] + [0.0] * dim)], "query_id long, query string, embedding array<double>")
        hits = R.contexts(R.retrieve(asked, index), index).orderBy("rank").collect()
        assert [h["paragraph_id"] for h in hits] == [g[2] for g in own]
        assert np.allclose([h["score"] for h in hits], [g[3] for g in own], atol=1.01e-4)


def test_ties_fewer_rows_and_empty_keywords(spark):
    index = spark.createDataFrame([(i, "same text", [1.0, 0.0]) for i in (5, 3, 9, 1)] + [(7, None, None)], "chunk_id long, text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "what does the", [1.0, 0.0]), (2, "same thing", [0.0, 1.0])], "query_id long, query string, embedding array<double>")
    got = [tuple(r) for r in R.retrieve(asked, index, k=3).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got] == [1, 3, 5, 1, 3, 5]
    assert [g[4] for g in got] == [0.0] * 3 + [0.5] * 3
    assert R.retrieve(asked, index, k=50, block=1).count() == 10
    assert R.retrieve(asked, index.limit(0)).count() == R.retrieve(asked.limit(0), index).count() == 0


def test_keyword_scores(spark):
    index = spark.createDataFrame([(1, "gross income"), (2, "none"), (3, None), (4, "income income")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "the gross income"), (2, "what does")], "query_id long, query string")
    assert sorted(map(tuple, R.keyword_scores(asked, index).collect())) == [(1, 1, 1.0), (1, 4, 0.5)]
    pairs = asked.crossJoin(index).select(R.keyword_score(R.keywords(F.col("query")), F.coalesce("text", F.lit(""))))
    assert sorted(r[0] for r in pairs.collect()) == [0.0] * 6 + [0.5, 1.0]


def test_retrieval_equals_all_pairs(spark):
    """Random texts and vectors, with ties, nulls and repeated texts, over several slices and blocks."""
    rng = np.random.default_rng(4)
    n = 1300
    words = [f"w{i}" for i in range(12)]
    texts = [None if i % 97 == 0 else " ".join(rng.choice(words, rng.integers(0, 5))) for i in range(n)]
    vecs = [None if i % 3 else [float(x) for x in rng.integers(-1, 2, 3)] for i in range(n)]
    ids = rng.permutation(n).tolist()
    index = spark.createDataFrame(list(zip(ids, texts, vecs)), "chunk_id long, text string, embedding array<double>").repartition(3)
    asked = [(q, " ".join(rng.choice(words, 3)), [float(x) for x in rng.integers(-1, 2, 3)]) for q in range(7)] + [(7, "", None), (8, None, None)]
    questions = spark.createDataFrame(asked, "query_id long, query string, embedding array<double>")
    want = {}
    for q, text, v in asked:
        k = set((text or "").split())
        rows = []
        for i, t, e in zip(ids, texts, vecs):
            vec = float(np.dot(v, e)) if v and e else 0.0
            kw = len(k & set((t or "").split())) / len(k) if k else 0.0
            rows.append((-round(0.5 * vec + 0.5 * kw, 10), i))
        want[q] = sorted(rows)
    for k, block in ((3, 2048), (20, 4)):
        got = R.retrieve(questions, index, k, block=block).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["rank"], r["chunk_id"]) for r in got] == [(q, j + 1, want[q][j][1]) for q in sorted(want) for j in range(k)]
    pairs = {(r["query_id"], r["chunk_id"]) for r in R.keyword_scores(questions, index, block=2).collect()}
    assert pairs == {(q, i) for q, text, _ in asked for i, t in zip(ids, texts) if set((text or "").split()) & set((t or "").split())}


def test_ties_go_to_the_earlier_chunk(spark, manuals):
    chunks = corpus.paragraph_chunks(manuals.unionByName(manuals.withColumn("source_doc", F.concat(F.lit("a"), "source_doc"))))
    index = corpus.build_index(chunks, M.HashingEmbedder(8)).collect()
    order = sorted(index, key=lambda r: r["chunk_id"])
    assert [(r["source_doc"], r["pos"]) for r in order] == sorted((r["source_doc"], r["pos"]) for r in index) and len({r["chunk_id"] for r in index}) == len(index)


def test_models_are_loaded_once_by_each_worker(spark, tmp_path):
    def load():
        import os

        with open(f"{tmp_path}/{os.getpid()}", "a") as f:
            f.write("x")
        return M.EchoGenerator("lazy")

    df = spark.createDataFrame([(str(i),) for i in range(40)], "prompt string").repartition(4)
    lazy = Lazy(f"echo {tmp_path}", load)
    plain = sorted(r["response"] for r in M.generate(df, "prompt", M.EchoGenerator("lazy")).collect())
    for _ in range(2):
        assert sorted(r["response"] for r in M.generate(df, "prompt", lazy).collect()) == plain
    assert {p.read_text() for p in tmp_path.iterdir()} == {"x"}


def test_tokenised(spark):
    """Ids, mask and labels; ids decode to the text, or to its start where cut."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = ["", "one two", "long " * 300, None, "café ½ 日本"]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "i int, text string, labels string")
    lazy = library_tokenizer(path)
    tok = lazy.load()
    rows = {r["i"]: r for r in tokenised(df, "text", lazy, special=False).collect()}
    assert tokenised(df, "text", lazy).columns == ["i", "text", "input_ids", "attention_mask", "labels"]
    for i, t in enumerate(texts):
        r = rows[i]
        if t is None:
            assert r["input_ids"] is r["attention_mask"] is r["labels"] is None
            continue
        whole = tok.encode(t, add_special_tokens=False).ids
        assert r["input_ids"] == r["labels"] == whole[:128] and r["attention_mask"] == [1] * len(r["input_ids"])
        assert t.startswith(tok.decode(r["input_ids"])) and (len(whole) > 128 or tok.decode(r["input_ids"]) == t)
    assert len(tokenised(df, "text", lazy, max_length=None, special=False).where("i = 2").first()["input_ids"]) > 128


def test_byte_level_ids_are_the_library_ones(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = ["", None, "<|endoftext|>", "a <|endoftext|> b", "it's 3,000.50!", "tab\tand\n\n line ", "x" * 900, "café ½ 日本 \u3000 \xa0z", " two  blanks ", "one two " * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 60)], "i int, text string")
    want, got = ({r["i"]: tuple(r) for r in tokenised(df, "text", lazy(path), max_length=n).collect()} for lazy, n in ((library_tokenizer, 128), (byte_level_tokenizer, 128)))
    assert got == want and len(got) == 600 and got[2][2] == [50256]


def test_tuning_report(spark):
    asked = spark.createDataFrame([(1, "Why?"), (2, "How?")], "query_id long, query string")
    base, tuned = (spark.createDataFrame(r, "query_id long, response string") for r in ([(1, "b1"), (2, "b2")], [(1, "t1")]))
    got = dict(map(tuple, report.tuning_report(asked, base, tuned, V.Names(authority="CMG")).collect()))
    assert got[1] == "[QUESTION 1]\nQuestion: Why?\n\n--- BASE MODEL OUTPUT (UNTRAINED) ---\nb1\n" + "-" * 50 + "\n--- CMG TUNED MODEL OUTPUT (LORA) ---\nt1\n" + "=" * 80
    assert got[2].endswith("\nN/A\n" + "=" * 80)


def test_means(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [100.0, 100.0], 0), ("b", [5.0, 6.0], 0)]
    df = spark.createDataFrame(rows, "k string, v array<double>, m int")
    got = dict(map(tuple, vectors.mean_vectors(df, ["k"], "v", F.col("m")).collect()))
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}
    whole = df.groupBy("k").agg(F.collect_list("v").alias("v"), F.collect_list(F.col("m").cast("double")).alias("m"))
    assert dict(map(tuple, whole.select("k", vectors.masked_mean(F.col("v"), F.col("m"), 2)).collect())) == got


def test_word_windows_with_clashing_columns(spark):
    df = spark.createDataFrame([("a b c", 1, 2, 3, 4)], "text string, words int, chunk_idx int, window int, `x.y` int")
    assert [tuple(r) for r in C.word_windows(df, size=2).collect()] == [("a b c", 1, 3, 4, 0, 2, "a b"), ("a b c", 1, 3, 4, 1, 1, "c")]


def test_word_windows(spark):
    texts = {0: "w " * 10, 1: "w " * 49, 2: "w " * 50, 3: "w " * 175, 4: "w " * 176, 5: "w " * 225, 6: "", 7: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    cut = C.word_windows(df)
    assert [tuple(r) for r in cut.select("doc_id", "chunk_idx", "n_words").orderBy("doc_id", "chunk_idx").collect()] == [
        (0, 0, 10), (1, 0, 49), (2, 0, 50), (3, 0, 175), (4, 0, 175), (4, 1, 1), (5, 0, 175), (5, 1, 50)]
    kept = C.keep_long(cut, ["doc_id", "chunk_idx"]).select("doc_id", "chunk_idx").orderBy("doc_id", "chunk_idx").collect()
    assert [tuple(r) for r in kept] == [(0, 0), (2, 0), (3, 0), (4, 0), (5, 0), (5, 1)]
    late = df.where("doc_id > 5").union(spark.createDataFrame([(8, " \x85 "), (9, "\u3000few words "), (10, "x")], df.schema))
    cut = C.word_windows(late)
    assert [tuple(r) for r in C.keep_long(cut, ["doc_id", "chunk_idx"], first=C.first_window(late, ["doc_id"])).select("doc_id", "chunk").collect()] == [(9, "few words")]


def test_sections(spark):
    long = "word " * 30
    text = f"preamble x17003 96001 18,000\n17001 {long}£café 30000 {long} 17002 short\n95999 {long}"
    df = spark.createDataFrame([("a", text), ("b", "no code"), ("c", None), ("d", f"17001 {long}")], "source string, text string")
    got = C.sections(df, C.WIDE).orderBy("source", "pos").collect()
    assert [(r["source"], r["paragraph_id"]) for r in got] == [("a", "17001"), ("a", "30000"), ("a", "95999"), ("d", "17001")]
    assert got[0]["body"].startswith("word") and got[0]["section"].endswith("caf")
    narrow = C.sections(df, C.SectionProfile(V.SECTION_NARROW, keywords=("caf",)))
    assert [r["section"][:5] for r in narrow.collect()] == ["17001"]


def test_keep_first_and_resume(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", 1), (2, None, 2), (4, None, 3)], "i int, k string, v int")
    assert sorted((tuple(r) for r in keep_first(df, ["k"], ["i"]).collect()), key=repr) == [(1, "a", 1), (2, None, 2)]
    assert sorted(r[0] for r in resume(df, df.where("i < 3"), ["i"]).collect()) == [3, 4]


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 1, "user", "b"), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    got = dict(map(tuple, P.conversations(turns, generation=True).collect()))
    assert got[1] == f"<|im_start|>system\n{V.DEFAULT_SYSTEM}<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>assistant\n"
    assert got[2] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nb<|im_end|>\n<|im_start|>assistant\n"


@pytest.fixture()
def manuals(spark):
    words = "income variance pension liability gross weekly calculation rules for a paying parent in the manual"
    rows = [("v1", f"cover 17001 {words} one {words} 17002 {words} two {words} 17001 {words} one {words}"), ("v2", f"49001 {words} three {words}")]
    return spark.createDataFrame(rows, "source_doc string, text string")


def test_plans_end_to_end(spark, manuals):
    sections = corpus.policy_sections(manuals, ["source_doc"]).collect()
    assert [r["paragraph_id"] for r in sections] == ["17001", "17002", "49001"]
    chunks = corpus.paragraph_chunks(manuals)
    assert chunks.count() == 3
    embedder = M.HashingEmbedder(64)
    index = corpus.build_index(chunks, embedder).cache()
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in index.collect())
    asked = spark.createDataFrame([(1, "gross weekly income two"), (2, "rule three")], "query_id long, query string")
    hits, got = corpus.compare(asked, index, embedder, M.EchoGenerator(), None)
    assert hits.where("rank = 1 AND query_id = 2").first()["paragraph_id"] == "49001"
    wide = report.matrix(got).orderBy("query_id").collect()
    assert [r["config_a"] for r in wide] == [V.NOT_AVAILABLE] * 2 and all(r["config_b"].startswith("base:") for r in wide)
    text = report.full_report(report.question_reports(asked, hits, got))
    assert text.count("### [QUESTION ") == 2 and "##### Configuration C: Tuned Model + RAG\n```text\nN/A\n```\n" in text
    data = corpus.instruction_dataset(manuals, ["source_doc"], least=5, cap=1).collect()
    assert len(data) == 1 and data[0]["input"] == "" and data[0]["output"].startswith("cover 17001")


def test_answer_query(spark, manuals):
    embedder = M.HashingEmbedder(64)
    index = corpus.build_index(corpus.paragraph_chunks(manuals), embedder)
    with pytest.raises(ValueError):
        corpus.answer_query(spark, "  ", index, embedder, M.EchoGenerator())
    got = json.loads(corpus.answer_query(spark, " rule three ", index, embedder, M.EchoGenerator()))
    assert got["query"] == "rule three" and got["retrieved_contexts"][0]["paragraph_id"] == "49001"
    assert set(got["retrieved_contexts"][0]) == {"paragraph_id", "source_doc", "text", "score"}
    assert got["config_a"]["response"].endswith(V.NO_ADAPTER) and not got["config_b"]["response"].endswith(V.NO_ADAPTER)
    tuned = json.loads(corpus.answer_query(spark, "rule three", index, embedder, M.EchoGenerator(), M.EchoGenerator("tuned")))
    assert tuned["config_c"]["response"].startswith("tuned:")


def test_qa_records(spark):
    rows = [("17001 " + "text " * 300, "Question: What is the 17001 rule about here?"), ("body", "no")]
    got = P.qa_records(spark.createDataFrame(rows, "section string, gen string"), "section", "gen").collect()
    assert got[0]["instruction"] == "What is the  rule about here?" and got[0]["output"] == rows[0][0][6:1000]
    assert got[1]["instruction"].endswith("body...")


def test_columns_of_the_same_names(spark):
    """Columns that the operators add or use inside replace their namesakes or stand beside them."""
    manual = "\n17001 " + "first section " * 10 + "\n18002 " + "second section " * 10
    df = spark.createDataFrame([(manual, 7, "x", "y", "z", "w", "v")], "text string, pos long, section string, body string, paragraph_id string, raw string, __raw string")
    got = C.sections(df).orderBy("pos").collect()
    assert [(r["pos"], r["paragraph_id"], r["raw"], r["__raw"]) for r in got] == [(0, "17001", "w", "v"), (1, "18002", "w", "v")] and got[0]["body"].startswith("first")
    rows = spark.createDataFrame([("k", 2, "b", None), ("k", 1, "a", 5), (None, 3, "c", 6)], "key string, n int, first string, __first int")
    assert sorted((tuple(r) for r in keep_first(rows, ["key"], ["n"]).collect()), key=repr) == sorted([("k", 1, "a", 5), (None, 3, "c", 6)], key=repr)
    long = spark.createDataFrame([(1, 0, 3, 9, 9), (1, 1, 60, 9, 9), (2, 0, 3, 9, 9)], "doc_id long, chunk_idx int, n_words int, first_doc_id int, __doc_id int")
    assert [(r["doc_id"], r["chunk_idx"], r["first_doc_id"]) for r in C.keep_long(long, ["doc_id", "chunk_idx"]).orderBy("doc_id", "chunk_idx").collect()] == [(1, 0, 9), (1, 1, 9)]
    texts = spark.createDataFrame([("a b", "old", 1.0)], "text string, embedding string, seconds double")
    v = M.embed(texts, "text", M.HashingEmbedder(8)).first()
    assert len(v["embedding"]) == 8 and v["seconds"] == 1.0
    g = M.generate(texts.withColumnRenamed("embedding", "response"), "text", M.EchoGenerator()).first()
    assert g["response"].startswith("base:") and len(g) == 3


def test_resume_with_null_keys(spark):
    todo = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "k long, v string")
    done = spark.createDataFrame([(None, "b"), (None, "b"), (1, "z")], "k long, v string")
    assert sorted((tuple(r) for r in resume(todo, done, ["k", "v"]).collect()), key=repr) == sorted([(1, "a"), (2, None)], key=repr)
    assert [tuple(r) for r in resume(todo, done, ["k"]).collect()] == [(2, None)]


def test_scores_are_compared_unrounded_and_summed_in_order(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[20:] = x[:20] * (1 - 1e-12 * rng.integers(0, 3, size=(20, 1)))
    loop = lambda a, b: float(np.cumsum(np.array(a) * np.array(b))[-1])
    index = [(i, "no", v.tolist()) for i, v in enumerate(x)] + [(99, "alpha", None)]
    asked = [(i, "alpha", x[i].tolist()) for i in range(20)]
    want = []
    for q, _, v in asked:
        rows = sorted((-(0.5 * (loop(w, v) if w else 0.0) + 0.5 * (t == "alpha")), i) for i, t, w in index)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(rows)]
    index = spark.createDataFrame(index, "chunk_id long, text string, embedding array<double>")
    asked = spark.createDataFrame(asked, "query_id long, query string, embedding array<double>")
    for parts in (1, 3):
        got = R.retrieve(asked, index.repartition(parts)).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in got] == want
    assert any(b[2] == 99 for b in want if b[1] == 1)
    assert R.retrieve(asked, index, k=0).count() == 0


def test_hashing_embedder_equals_plain_loop():
    """Word by word by a regular expression; few texts are hashed twice."""
    import hashlib
    import re

    texts = ["", "One two, two ONE", "K\u212a \u017fs \u0130i \xe91\xe92", "a", "b", "\n", "x9" * 500, "no1-no1_no2"]
    for most in (None, 2):
        want = np.zeros((len(texts), 16))
        for i, t in enumerate(texts):
            for w in re.findall("[0-9A-Za-z]+", t)[:most]:
                h = hashlib.md5(w.lower().encode()).hexdigest()
                want[i, int(h[:7], 16) % 16] += 1.0 if h[7] >= "8" else -1.0
        assert (M.HashingEmbedder(16, most_words=most).embed(texts) == want).all()
    assert M.HashingEmbedder(16).embed([]).shape == (0, 16) and not M.HashingEmbedder(16).embed(["", ""]).any()


def test_words_are_hashed_once(monkeypatch):
    calls, md5 = [], M.hashlib.md5
    monkeypatch.setattr(M.hashlib, "md5", lambda b: calls.append(b) or md5(b))
    M.HashingEmbedder(16).embed(["zebra ZEBRA zebra", "zebra quagga"] * 50)
    M.HashingEmbedder(16).embed(["quagga"])
    assert sorted(calls) == [b"quagga", b"zebra"]


def test_arrow_batches_are_bounded_by_bytes(spark):
    """Rows of 64 KB come to Python in batches of some MB, for every operator that ships its code."""
    from tessera.operators.workers import BATCH, ship

    own = spark.newSession()
    ship(own)
    assert int(own.conf.get(BATCH[0])) == BATCH[1]
    wide = own.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 1 << 16).alias("t"))
    rows = wide.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it), "n long").collect()
    assert sum(r["n"] for r in rows) == 200 and max(r["n"] for r in rows) <= 80


def test_scores_that_are_null_or_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [inf, 0.0]), (6, [0.5, 0.5])]
    index = spark.createDataFrame([(i, "alpha" if i == 6 else "no", v) for i, v in vectors], "chunk_id long, text string, embedding array<double>")
    asked = [(1, "alpha", [1.0, 0.0]), (2, None, [0.0, 1.0]), (3, "alpha", [nan, 1.0]), (None, "alpha", None)]
    asked = spark.createDataFrame(asked, "query_id long, query string, embedding array<double>")
    got = {}
    for r in R.retrieve(asked, index.repartition(2)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], repr(r["score"])))
    assert got == {
        1: [(2, "nan"), (5, "inf"), (6, "0.75")],
        2: [(1, "None"), (2, "None"), (3, "None")],
        3: [(1, "nan"), (2, "nan"), (3, "nan")],
        None: [(6, "0.5"), (1, "0.0"), (2, "0.0")],
    }


def test_words_are_lowered_letter_by_letter(spark):
    from tessera.functions import text as T

    df = spark.createDataFrame([("İzmir ΟΔΟΣ Ärger",)], "text string")
    assert df.select(T.words(F.col("text"))).first()[0] == ["izmir", "οδοσ", "ärger"]


def test_context_of_null_parts_is_null(spark):
    hits = [(1, 1, "7", None, "a"), (2, 1, "7", "s", "b"), (2, 2, "8", "s", None)]
    hits = spark.createDataFrame(hits, "query_id long, rank int, paragraph_id string, source_doc string, text string")
    assert {r["query_id"]: r["context"] for r in P.context_blocks(hits).collect()} == {1: None, 2: "Paragraph 7 (from s):\nb"}


def test_prompt_without_a_context_or_question_is_null(spark):
    df = spark.createDataFrame([(1, "c", "q"), (2, None, "q"), (3, "c", None)], "query_id long, context string, query string")
    got = {r[0]: r[1] is None for r in df.select("query_id", P.reader_prompt(F.col("context"), F.col("query"))).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_null_prompts_have_null_answers_in_every_configuration(spark):
    df = spark.createDataFrame([(1, "c", "q"), (2, None, "q"), (3, "c", None)], "query_id long, context string, query string")
    got = {(r["query_id"], r["config"]) for r in M.answers(df, M.EchoGenerator(), None).collect() if r["response"] is None}
    with_context = {p.config for p in M.PROFILES if p.with_context}
    assert got == {(2, c) for c in with_context} | {(3, p.config) for p in M.PROFILES}
