"""Queries of the second retrieval generation and its evaluation, with the SQL that gives the same rows.

Embeddings stand for vectors of chunks and, where vec_id is divisible by 50, of questions; documents for chunks, benchmark items for questions and references. Where a
query needs token vectors, each word has eight numbers from its MD5 digest: they mean nothing, but both sides can compute them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V
from tessera.operators import bm25, mix, rouge
from tessera.operators import chunk as C
from tessera.operators import evaluate as E
from tessera.operators import grounding as G
from tessera.operators import models as M
from tessera.operators import prompt as P
from tessera.operators import token_match as TM
from tessera.operators import vector_index as VI
from tessera.operators import webtext as W
from tessera.operators.recursive_chunk import recursive_chunks
from tessera.operators.rerank import rerank
from tessera.plans import corpus
from tessera.plans.catalogue import ORACLES, QUERIES, WS, docs, manual, query, sql_sections, sql_text, sql_words, table
from tessera.sources import records
from tessera.sources.shared import shared_path, stage


# --- vectors ---
def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_questions(spark, sf_dir):
    return vectors(spark, sf_dir).where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


def vector_index(spark, sf_dir, cells: int):
    v = vectors(spark, sf_dir)
    return VI.build(v, VI.fit(v, cells=cells), shared_path(spark, "vectors"))


@query("ivf_topk")
def ivf_topk(spark, sf_dir):
    """Ten neighbours of every 50th vector from the sixteen nearest of 64 cells; approximate, so it has no SQL."""
    return VI.search(vector_index(spark, sf_dir, 64), vector_questions(spark, sf_dir), k=10, probes=16, refine=30).withColumn("score", F.round("score", 6))


SQL_NEIGHBOURS = """
SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 10) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)
) WHERE rank <= 10
"""


@query("ivf_exact", SQL_NEIGHBOURS)
def ivf_exact(spark, sf_dir):
    """The same from all cells, with bounds on the codes: the exact neighbours."""
    return VI.search(vector_index(spark, sf_dir, 64), vector_questions(spark, sf_dir), k=10, probes=None, refine=None).withColumn("score", F.round("score", 6))


# --- words ---
def bm25_index(spark, sf_dir):
    """Two segments, as they would come from two deliveries."""
    path, d = shared_path(spark, "bm25"), docs(spark, sf_dir)
    first = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(False))
    bm25.append(path, "first", d.where(first))
    bm25.append(path, "second", d.where(~first))  # all others
    return path


def word_questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


SQL_BM25 = f"""
(WITH d AS (SELECT doc_id, {sql_words('text')} AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM d),
t AS (SELECT doc_id, len, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM d) GROUP BY ALL),
f AS (SELECT word, ln(1 + (any_value(c.n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM t, c GROUP BY word),
q AS (SELECT item_id AS query_id, word, count(*) AS times FROM (SELECT item_id, unnest({sql_words('text')}) AS word FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, doc_id AS id, round(sum(times * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 9) AS score FROM q JOIN t USING (word) JOIN f USING (word), c GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, score FROM s QUALIFY rank <= 20)
"""


@query("bm25_topk", f"SELECT query_id, rank::INT AS rank, id, round(score, 6) AS score FROM {SQL_BM25}")
def bm25_topk(spark, sf_dir):
    found = bm25.search(spark, bm25_index(spark, sf_dir), word_questions(spark, sf_dir), k=20)
    return found.withColumn("score", F.round("score", 6))


def word_vectors(words):
    """Eight numbers for each distinct word: the first digits of its MD5 digest, less 7.5."""
    digit = lambda w, i: F.conv(F.substring(F.md5(w), i, 1), 16, 10).cast("double") - 7.5
    return F.transform(words, lambda w: F.array(*[digit(w, i) for i in range(1, 9)]))


SQL_DIGITS = "list_transform(range(1, 9), lambda i: ('0x' || substr(md5(word), i, 1))::INT - 7.5::DOUBLE)"
SQL_RERANKED = f"""
WITH b AS (SELECT query_id, id FROM {SQL_BM25}),
d AS (SELECT doc_id AS id, {SQL_DIGITS} AS v FROM (SELECT DISTINCT doc_id, unnest({sql_words('text')}) AS word FROM documents WHERE doc_id IN (SELECT id FROM b))),
q AS (SELECT query_id, word, count(*) AS times, {SQL_DIGITS} AS v FROM (SELECT item_id AS query_id, unnest({sql_words('text')}) AS word FROM benchmark) GROUP BY ALL),
m AS (SELECT b.query_id, b.id, q.word, any_value(q.times) * max(list_inner_product(q.v, d.v)) AS best FROM b JOIN q USING (query_id) JOIN d USING (id) GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(best), 9) AS score FROM m GROUP BY ALL)
SELECT query_id, rank::INT AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3
"""


@query("two_stage_rerank", SQL_RERANKED)
def two_stage_rerank(spark, sf_dir):
    """Twenty candidates by BM25, three of them by late interaction."""
    asked = word_questions(spark, sf_dir)
    found = stage(bm25.search(spark, bm25_index(spark, sf_dir), asked, k=20).select("query_id", "id"), "candidates")
    matrices = docs(spark, sf_dir).join(F.broadcast(found.select(F.col("id").alias("doc_id")).distinct()), "doc_id", "left_semi")  # twenty a question
    matrices = matrices.select(F.col("doc_id").alias("id"), word_vectors(F.array_distinct(T.words(F.col("text")))).alias("tokens"))
    return rerank(found, matrices, asked.select("query_id", word_vectors(T.words(F.col("query"))).alias("tokens")), k=3)


# --- chunks ---
@query("recursive_chunks")
def recursive(spark, sf_dir):
    """Chunks of 500 words at most with 100 shared ones; the descent has no SQL (tests put the texts together again)."""
    return recursive_chunks(docs(spark, sf_dir).select("doc_id", "text"), size=500, overlap=100)


# --- answers ---
@query("rouge_l")
def rouge_of_answers(spark, sf_dir):
    """Every assistant turn against the turn before it; the longest common subsequence has no SQL (tests compare it with the plain table)."""
    t = table(spark, sf_dir, "conversations")
    asked = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    said = t.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("candidate"))
    got = rouge.rouge_l(said.join(asked, ["conv_id", "turn"]))
    return got.select("conv_id", "turn", "lcs", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query("token_match")
def token_match(spark, sf_dir):
    """Every assistant turn against the turn before it by matched token vectors, rarer words counting more (tests compare it with plain loops)."""
    t = table(spark, sf_dir, "conversations")
    key = F.concat_ws("-", "conv_id", "turn").alias("pair_id")
    asked = t.select("conv_id", (F.col("turn") + 1).alias("turn"), T.words(F.col("text")).alias("r"))
    said = t.where("role = 'assistant'").select("conv_id", "turn", T.words(F.col("text")).alias("c"))
    rows = stage(said.join(asked, ["conv_id", "turn"]).select(key, "r", "c"), "turns")
    sides = [rows.select("pair_id", F.col(c).alias("tokens")) for c in ("r", "c")]
    weights = TM.document_frequencies(sides[0])
    each = [TM.weighted(s, weights).withColumnRenamed("weights", f"{n}_weights") for s, n in zip(sides, ("reference", "candidate"))]
    pairs = rows.join(each[0], "pair_id", "left").join(each[1], "pair_id", "left")
    pairs = pairs.select("pair_id", word_vectors(F.col("r")).alias("reference"), word_vectors(F.col("c")).alias("candidate"), "reference_weights", "candidate_weights")
    return TM.token_scores(pairs).select("pair_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


#: Answers that cite four paragraphs, one section and a table; every known paragraph interval covers seven numbers of ten.
SQL_CITED = """
WITH a AS (SELECT doc_id, doc_id % 500 AS p FROM documents),
n AS (SELECT doc_id, unnest([p, p + 1, p + 2, p + 3]) AS number FROM a)
SELECT n.doc_id AS answer_id, 3::BIGINT AS n_cited, (CASE WHEN bool_and(number % 10 <= 6 AND number // 10 <= (SELECT max(doc_id) FROM documents)) THEN 1 ELSE 0 END + 1)::BIGINT AS n_real
FROM n GROUP BY n.doc_id
"""


@query("citation_accuracy", f"SELECT *, n_real / n_cited AS accuracy FROM ({SQL_CITED})")
def citation_accuracy(spark, sf_dir):
    """Citations of documents' texts under a made-up first sentence, resolved against intervals made of the documents' ids."""
    d = docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 500).alias("p"), "text")
    answers = d.select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("See paragraphs "), "p", F.lit(" to "), F.col("p") + 3, F.lit(", section 12 and Table 9999: "), "text").alias("answer"))
    first = (F.col("doc_id") * 10).alias("first")
    known = d.select(F.lit("paragraph").alias("kind"), first, (F.col("doc_id") * 10 + 6).alias("last"))
    known = known.unionByName(spark.range(1).select(F.lit("section").alias("kind"), F.lit(1).cast("long").alias("first"), F.lit(40).cast("long").alias("last")))
    return G.citation_accuracy(answers, known)


FIGURE = r"£?\d[\d,]*(?:\.\d+)?%?"
SQL_FIGURES = "list_distinct(list_transform(regexp_extract_all({c}, '" + FIGURE + r"'), lambda x: regexp_replace(regexp_replace(x, '[£,]', '', 'g'), '^0+([0-9])', '\1')))"


@query("number_grounding", f"""
WITH s AS (SELECT conv_id, turn, {SQL_FIGURES.format(c="text || ' ' || turn || ' of 1,0' || conv_id")} AS said FROM conversations WHERE role = 'assistant'),
r AS (SELECT conv_id, turn + 1 AS turn, {SQL_FIGURES.format(c="text || ' 10' || conv_id")} AS read FROM conversations)
SELECT s.conv_id || '-' || s.turn AS answer_id, len(said)::BIGINT AS n_numbers, len(list_intersect(said, coalesce(read, [])))::BIGINT AS n_grounded,
  list_sort(list_filter(said, lambda x: NOT list_contains(coalesce(read, []), x))) AS hallucinated, CASE WHEN len(said) > 0 THEN len(list_intersect(said, coalesce(read, []))) / len(said) END AS grounding
FROM s LEFT JOIN r USING (conv_id, turn)
""")
def number_grounding(spark, sf_dir):
    """Numbers of assistant turns (and two more made of their ids) looked for in the turn before."""
    t = table(spark, sf_dir, "conversations")
    answers = t.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.concat("text", F.lit(" "), "turn", F.lit(" of 1,0"), "conv_id").alias("answer"))
    contexts = t.select(F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("answer_id"), F.concat("text", F.lit(" 10"), "conv_id").alias("context"))
    return G.number_grounding(answers, contexts)


SQL_METRICS = f"""
WITH hits AS (SELECT query_id, rank, id FROM {SQL_BM25}),
gold AS (SELECT item_id AS query_id, doc_id AS id, doc_id % 3 AS grade FROM benchmark JOIN documents ON doc_id % 50 = item_id % 50 WHERE doc_id % 3 > 0),
ideal AS (SELECT query_id, count(*) AS n_right, sum(CASE WHEN p <= 20 THEN (pow(2, grade) - 1) / log2(p + 1) ELSE 0 END) AS best FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS p FROM gold) GROUP BY query_id),
found AS (SELECT query_id, count(*) AS n_hits, count(grade) AS n_found, min(CASE WHEN grade IS NOT NULL THEN rank END) AS first, sum(coalesce((pow(2, grade) - 1) / log2(rank + 1), 0)) AS gained FROM hits LEFT JOIN gold USING (query_id, id) GROUP BY query_id)
SELECT b.item_id AS query_id, round(CASE WHEN n_right > 0 THEN coalesce(n_found / n_hits, 0) END, 9) AS precision, round(CASE WHEN n_right > 0 THEN coalesce(n_found / n_right, 0) END, 9) AS recall,
  round(CASE WHEN n_right > 0 THEN coalesce(1 / first, 0) END, 9) AS reciprocal_rank, round(CASE WHEN n_right > 0 THEN coalesce(gained, 0) / best END, 9) AS ndcg, CASE WHEN (coalesce(n_right, 0) > 0) = (coalesce(n_hits, 0) > 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS abstained_right
FROM (SELECT DISTINCT item_id FROM benchmark) b LEFT JOIN ideal ON ideal.query_id = b.item_id LEFT JOIN found ON found.query_id = b.item_id
"""


def scored_questions(spark, sf_dir):
    """BM25's twenty documents against a gold set that the ids give: a third grade nothing, a third 1, a third 2."""
    asked = word_questions(spark, sf_dir)
    found = bm25.search(spark, bm25_index(spark, sf_dir), asked, k=20)
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("class"), (F.col("doc_id") % 3).alias("grade"))
    gold = asked.select("query_id", (F.col("query_id") % 50).alias("class")).join(d, "class").drop("class")
    return E.retrieval_metrics(asked, found, gold, k=20)


@query("retrieval_metrics", SQL_METRICS)
def retrieval_metrics(spark, sf_dir):
    return scored_questions(spark, sf_dir).withColumns({c: F.round(c, 9) for c in E.METRICS[:4]})


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf_dir):
    """Intervals of the metrics' means over 1,000 replicates (tests compare them with a plain bootstrap)."""
    return E.bootstrap(scored_questions(spark, sf_dir), list(E.METRICS), replicates=1000, seed=1)


# --- corpus ---
@query("page_text")
def page_text(spark, sf_dir):
    """Main text of every page; the choice of blocks has no SQL (tests compare with a parser and with all runs)."""
    return W.page_texts(table(spark, sf_dir, "pages"))


@query("source_mix", """
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS pull FROM documents GROUP BY source),
t AS (SELECT (SELECT count(*) FROM documents) // 10 AS total, (SELECT sum(pull) FROM s) AS whole),
x AS (SELECT source, pull * total / whole AS exact, total FROM s, t),
f AS (SELECT *, floor(exact)::BIGINT AS base, row_number() OVER (ORDER BY exact - floor(exact) DESC, source) AS place FROM x)
SELECT source, base + CASE WHEN place <= total - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS n_rows, base + CASE WHEN place <= total - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS n_distinct FROM f
""")
def source_mix(spark, sf_dir):
    """A tenth of all documents, drawn from the sources at temperature 2; longer documents weigh more. The sizes have SQL, the draw is tested."""
    d = docs(spark, sf_dir)
    total = d.count() // 10
    drawn = mix.draw(d, mix.shares(d, total, temperature=2.0), ["doc_id"], weight=F.log(F.length("text") + 2.0))
    return drawn.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id").alias("n_distinct"))


# --- files, end to end ---
@query("jsonl_round_trip", ORACLES["training_records"])
def jsonl_round_trip(spark, sf_dir):
    """Training records written as JSON lines and read back."""
    path = shared_path(spark, "records")
    records.write_jsonl(QUERIES["training_records"](spark, sf_dir), path)
    return records.read_jsonl(spark, path)


@query("jsonl_append_resume", "SELECT doc_id, text FROM documents")
def jsonl_append_resume(spark, sf_dir):
    """Labelled documents first, then all of them twice: each is there once."""
    path, kind = shared_path(spark, "appended"), "doc_id long, text string"
    d = docs(spark, sf_dir).select("doc_id", "text")
    records.append_jsonl(d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), path, ["doc_id"], kind)
    for _ in range(2):
        records.append_jsonl(d, path, ["doc_id"], kind)
    return records.read_jsonl(spark, path, kind)


SQL_CHUNKS = f"""
WITH s AS (SELECT 's' || lpad(doc_id::VARCHAR, 12, '0') AS source_doc, pos, paragraph_id, body AS text FROM ({sql_sections('17000 + length(text) % 100', V.SECTION_WIDE)})),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY paragraph_id, text ORDER BY source_doc, pos) = 1),
b AS (SELECT source_doc, coalesce(sum(max(pos) + 1) OVER (ORDER BY source_doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM c GROUP BY source_doc)
SELECT (base + pos)::BIGINT AS chunk_id, paragraph_id, text, 'Paragraph ' || paragraph_id || ': ' || text AS formatted_text, source_doc, 'hashing-64' AS model_name, 64 AS dim FROM c JOIN b USING (source_doc)
"""


@query("index_round_trip", SQL_CHUNKS)
def index_round_trip(spark, sf_dir):
    """Manuals to sections, distinct paragraphs, ids and vectors (of the stand-in), written as an index and read back."""
    path = shared_path(spark, "index")
    source = F.concat(F.lit("s"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("source_doc")
    chunks = corpus.paragraph_chunks(manual(spark, sf_dir, 17000 + F.length("text") % 100).select(source, "text"))
    records.write_index(corpus.build_index(stage(chunks, "chunks"), M.HashingEmbedder(64, "hashing-64")), path, "hashing-64")
    got = records.read_index(spark, path)
    return got.select("chunk_id", "paragraph_id", "text", "formatted_text", "source_doc", "model_name", F.size("embedding").alias("dim"))


SQL_BODY = f"regexp_replace(substr(section, 1, 1000), '^[0-9]{{5}}{WS}*', '')"


@query("question_synthesis", f"SELECT {sql_text(V.Names().fill(V.FALLBACK_QUESTION))} || substr({SQL_BODY}, 1, 80) || '...' AS instruction, '' AS input, {SQL_BODY} AS output FROM ({sql_sections('17000 + doc_id % 700', V.SECTION_WIDE)})")
def question_synthesis(spark, sf_dir):
    """A question for every section: prompt, generator (the stand-in, whose answers are no questions), cleaning, and the fallback."""
    s = C.sections(manual(spark, sf_dir, 17000 + F.col("doc_id") % 700))
    asked = s.withColumn("prompt", P.plain_prompt(T.question_prompt(T.strip_code(F.substring("section", 1, 1000)))))
    return P.qa_records(M.generate(asked, "prompt", M.EchoGenerator(), 0.0, 40, into="generated"), "section", "generated")
