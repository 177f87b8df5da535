"""Queries of the engine's own operators by name, and the SQL that gives the same rows.

The driver's tables stand in for the engine's inputs: documents for texts and for manuals (each line numbered by a rule, as the texts have
no codes), embeddings for vectors, benchmark items for questions, conversations for chats and pages for model answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors
from tessera.functions import vocabulary as V
from tessera.operators import chunk as C
from tessera.operators import models as M
from tessera.operators import prompt as P
from tessera.operators import report
from tessera.operators import retrieve as R
from tessera.operators.dedup import keep_first, resume
from tessera.operators.tokenise import byte_level_tokenizer, tokenised
from tessera.operators.workers import Lazy
from tessera.sources import pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Strings that the tables don't have, for functions that treat them specially.
ODD = ("“25% of” – it’s £3,000.50 or 12 percent…", "a\xa0b\tc", "30%x in Paragraph 17a, Para 3 and chapter 25", "Question: Q: What is 17001 this rule?", "\x1ca\x1fb\x0b\x0c", " ", "")
STEM = ("the", "ing", "tion", "ande")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir):
    """Documents, dealt out where the file has fewer splits than there are cores."""
    d = table(spark, sf_dir, "documents")
    n = spark.sparkContext.defaultParallelism
    return d.repartition(n) if len(d.inputFiles()) < n and spark.sparkContext.master.startswith("local") else d


# --- SQL pieces shared by the texts below ---
BLANK = T.BLANK
WS = T.ASCII_BLANK


def sql_squash(c: str, blank: str = BLANK) -> str:
    return f"trim(regexp_replace({c}, '{blank}+', ' ', 'g'), ' ')"


def sql_clean(c: str) -> str:
    folded = f"translate({c}, '’‘“”–—' || chr(160) || chr(9), '''''\"\"--  ')"
    return sql_squash(f"regexp_replace({folded}, '[^\\x00-\\x7F]', '', 'g')", WS)


def sql_words(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '{T.WORD}')"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL_ODD = "(VALUES " + ", ".join(f"({i}, {sql_text(s)})" for i, s in enumerate(ODD)) + ") AS odd(doc_id, text)"
TEXTS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM {SQL_ODD})"


def texts(spark, sf_dir):
    """Documents and the odd strings, under negative ids."""
    odd = spark.createDataFrame([(-1 - i, s) for i, s in enumerate(ODD)], "doc_id long, text string")
    return docs(spark, sf_dir).select("doc_id", "text").unionByName(odd)


# --- text functions ---
@query("clean_text", f"SELECT doc_id, {sql_clean('text')} AS clean FROM {TEXTS} AS t")
def clean_text(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("ascii_strip", f"SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS stripped FROM {TEXTS} AS t")
def ascii_strip(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.strip_non_ascii(F.col("text")).alias("stripped"))


@query("ws_normalize", f"SELECT doc_id, {sql_squash('text')} AS squashed FROM {TEXTS} AS t")
def ws_normalize(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.squash(F.col("text")).alias("squashed"))


@query("word_tokens", f"SELECT doc_id, len(w)::INT AS n_words, len(list_distinct(w))::INT AS n_distinct FROM (SELECT doc_id, {sql_words('text')} AS w FROM {TEXTS} AS t)")
def word_tokens(spark, sf_dir):
    w = T.words(F.col("text"))
    return texts(spark, sf_dir).select("doc_id", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"))


@query("text_lengths", f"SELECT doc_id, lower(substr(text, 1, 80)) AS head, substr(text, 1, 120) || '...' AS preview, CASE WHEN length(text) > 120 THEN substr(text, 1, 117) || '...' ELSE text END AS short, regexp_replace(text, '\\A{BLANK}+|{BLANK}+\\z', '', 'g') = '' AS blank FROM {TEXTS} AS t")
def text_lengths(spark, sf_dir):
    c = F.col("text")
    return texts(spark, sf_dir).select("doc_id", F.lower(F.substring(c, 1, 80)).alias("head"), T.preview(c, 120).alias("preview"), T.shorten(c).alias("short"), T.is_blank(c).alias("blank"))




def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '\\A{BLANK}+|{BLANK}+\\z', '', 'g')"


TURNS = f"(SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Question: ' ELSE '' END || text || CASE turn % 2 WHEN 0 THEN ' 17001 rule?' ELSE '' END AS text FROM conversations UNION ALL SELECT -1 - doc_id, 0, text FROM {SQL_ODD})"
SQL_QUESTION = sql_strip(f"regexp_replace(regexp_replace({sql_strip('text')}, '(?i)\\A(Question|Q):{BLANK}*', ''), '(^|[^\\p{{L}}\\p{{N}}_])[0-9]{{5}}([^\\p{{L}}\\p{{N}}_]|$)', '\\1\\2', 'g')")


def question_turns(spark, sf_dir):
    """Turns dressed as generated questions."""
    t = table(spark, sf_dir, "conversations")
    dressed = F.concat(F.when(F.col("turn") % 3 == 0, "Question: ").otherwise(""), "text", F.when(F.col("turn") % 2 == 0, " 17001 rule?").otherwise(""))
    odd = spark.createDataFrame([(-1 - i, 0, s) for i, s in enumerate(ODD)], "conv_id long, turn long, text string")
    return t.select("conv_id", "turn", dressed.alias("text")).unionByName(odd)


@query("question_clean", f"SELECT conv_id, turn, {SQL_QUESTION} AS question FROM {TURNS} AS t")
def question_clean(spark, sf_dir):
    return question_turns(spark, sf_dir).select("conv_id", "turn", T.clean_question(F.col("text")).alias("question"))


@query("qa_accept", f"SELECT conv_id, turn, CASE WHEN length(q) > 15 AND contains(q, '?') THEN q ELSE {sql_text(V.Names().fill(V.FALLBACK_QUESTION))} || substr(text, 1, 80) || '...' END AS instruction FROM (SELECT conv_id, turn, text, {SQL_QUESTION} AS q FROM {TURNS} AS t)")
def qa_accept(spark, sf_dir):
    t = question_turns(spark, sf_dir)
    return t.select("conv_id", "turn", T.accept_question(T.clean_question(F.col("text")), F.col("text")).alias("instruction"))


SQL_NO_CODE = f"regexp_replace(t, '\\A{BLANK}*[0-9]{{5}}{BLANK}*', '')"


@query("code_strip", f"SELECT doc_id, {sql_strip(SQL_NO_CODE)} AS body FROM (SELECT doc_id, ' 12' || (3456 + doc_id % 3)::VARCHAR || ' ' || text AS t FROM documents)")
def code_strip(spark, sf_dir):
    c = F.concat(F.lit(" 12"), (3456 + F.col("doc_id") % 3).cast("string"), F.lit(" "), "text")
    return docs(spark, sf_dir).select("doc_id", T.strip(T.strip_code(c)).alias("body"))


@query("question_prompt", f"SELECT doc_id, {sql_text(V.Names().fill(V.QUESTION_PROMPT[0]))} || substr(text, 1, 1000) || {sql_text(V.QUESTION_PROMPT[1])} AS prompt FROM documents")
def question_prompt(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.question_prompt(F.substring("text", 1, 1000)).alias("prompt"))


@query("citations", f"SELECT doc_id, regexp_extract_all(text, '{V.CITATION}') AS cited, regexp_replace(text, '{V.CITATION}', '<span class=\"citation\">\\1</span>', 'g') AS marked FROM (SELECT doc_id, 'See Paragraph ' || doc_id || 'b, chapter  ' || doc_id % 90 || ': ' || text AS text FROM documents UNION ALL SELECT -1 - doc_id, text FROM {SQL_ODD})")
def citations(spark, sf_dir):
    dressed = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("See Paragraph "), "doc_id", F.lit("b, chapter  "), F.col("doc_id") % 90, F.lit(": "), "text").alias("text"))
    odd = spark.createDataFrame([(-1 - i, s) for i, s in enumerate(ODD)], "doc_id long, text string")
    both = dressed.unionByName(odd)
    return both.select("doc_id", T.citations(F.col("text")).alias("cited"), F.regexp_replace("text", V.CITATION, '<span class="citation">$1</span>').alias("marked"))


@query("figures", f"SELECT doc_id, regexp_extract_all(text, '{V.FIGURE}') AS figures FROM (SELECT doc_id, doc_id || ' percent, 25% of, ' || doc_id % 100 || '.5%x and £' || doc_id || ',000.50 ' || text AS text FROM documents)")
def figures(spark, sf_dir):
    dressed = F.concat("doc_id", F.lit(" percent, 25% of, "), F.col("doc_id") % 100, F.lit(".5%x and £"), "doc_id", F.lit(",000.50 "), "text")
    return docs(spark, sf_dir).select("doc_id", T.figures(dressed).alias("figures"))


ESCAPE = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("html_escape", f"SELECT page_id, {ESCAPE.format(c='html')} AS escaped, replace(regexp_replace(regexp_replace({ESCAPE.format(c='html')}, '{V.CITATION}', '<span class=\"citation\">\\1</span>', 'g'), '{V.FIGURE}', '<span class=\"number-highlight\">\\1</span>', 'g'), chr(10), '<br>') AS rendered FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.escape_html(F.col("html")).alias("escaped"), T.render_html(F.col("html")).alias("rendered"))


# --- chunks and records ---
SQL_WORD_LIST = f"list_filter(string_split({sql_squash('text')}, ' '), lambda x: x <> '')"
SQL_CHUNKS = f"""
  SELECT doc_id, chunk_idx, list_slice(w, chunk_idx * 175 + 1, chunk_idx * 175 + 175) AS c
  FROM (SELECT doc_id, w, unnest(range((len(w) + 174) // 175)) AS chunk_idx FROM (SELECT doc_id, {SQL_WORD_LIST} AS w FROM documents))
"""
SQL_KEPT = f"""
  SELECT doc_id, chunk_idx::INT AS chunk_idx, len(c)::INT AS n_words, array_to_string(c, ' ') AS chunk
  FROM (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_idx) AS nth FROM ({SQL_CHUNKS})) WHERE len(c) >= 50 OR nth = 1
"""


def kept_chunks(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text")
    return C.keep_long(C.word_windows(d).drop("text"), ["doc_id", "chunk_idx"], first=C.first_window(d, ["doc_id"]))


@query("word_chunks_175", SQL_KEPT)
def word_chunks_175(spark, sf_dir):
    return kept_chunks(spark, sf_dir)


@query("chunk_cap", SQL_KEPT + " ORDER BY doc_id, chunk_idx LIMIT 300")
def chunk_cap(spark, sf_dir):
    return C.head(kept_chunks(spark, sf_dir), ["doc_id", "chunk_idx"], 300)


SQL_SENTENCES = f"list_filter(list_transform(string_split(chunk, '.'), lambda x: {sql_strip('x')}), lambda x: x <> '')"
SQL_TOPIC = f"coalesce(CASE WHEN length(s[1]) > 120 THEN substr(s[1], 1, 117) || '...' ELSE s[1] END, {sql_text(V.DEFAULT_TOPIC)})"
SQL_INSTRUCTION = f"CASE length(chunk) % 3 {' '.join(f'WHEN {i} THEN {sql_text(V.Names().fill(t))}' for i, t in enumerate(V.INSTRUCTIONS))} END || {SQL_TOPIC}"
SQL_TOPICS = f"(SELECT *, {SQL_SENTENCES} AS s FROM ({SQL_KEPT}))"


@query("first_sentence_topic", f"SELECT doc_id, chunk_idx, len(s)::INT AS n_sentences, {SQL_TOPIC} AS topic FROM {SQL_TOPICS}")
def first_sentence_topic(spark, sf_dir):
    c = F.col("chunk")
    return kept_chunks(spark, sf_dir).select("doc_id", "chunk_idx", F.size(T.sentences(c)).alias("n_sentences"), T.topic(c).alias("topic"))


@query("instruction_template", f"SELECT doc_id, chunk_idx, {SQL_INSTRUCTION} AS instruction FROM {SQL_TOPICS}")
def instruction_template(spark, sf_dir):
    return kept_chunks(spark, sf_dir).select("doc_id", "chunk_idx", T.instruction(F.col("chunk")).alias("instruction"))


@query("training_records", f"SELECT {SQL_INSTRUCTION} AS instruction, '' AS input, chunk AS output FROM {SQL_TOPICS}")
def training_records(spark, sf_dir):
    c = F.col("chunk")
    return P.training_records(kept_chunks(spark, sf_dir), T.instruction(c), c)


IM = "'<|im_start|>' || {r} || chr(10) || {c} || '<|im_end|>' || chr(10)"


@query("sft_format", f"SELECT doc_id, chunk_idx, '<|im_start|>system' || chr(10) || {sql_text(V.DEFAULT_SYSTEM)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {SQL_INSTRUCTION} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || chunk || '<|im_end|>' || chr(10) AS text FROM {SQL_TOPICS}")
def sft_format(spark, sf_dir):
    c = F.col("chunk")
    return kept_chunks(spark, sf_dir).select("doc_id", "chunk_idx", P.sft_text(T.instruction(c), c).alias("text"))


# --- manuals ---
def manual(spark, sf_dir, code):
    """A numbered text for each document: every line under the document's code, half of them after a preamble."""
    number = F.concat(code.cast("string"), F.lit(" "))
    lines = F.concat(number, F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), number)))
    return docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("preamble "), lines)).otherwise(lines).alias("text"))


def sql_manual(code: str) -> str:
    return f"(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'preamble ' ELSE '' END || n || replace(text, chr(10), chr(10) || n) AS text FROM (SELECT doc_id, text, ({code})::VARCHAR || ' ' AS n FROM documents))"


def sql_sections(code: str, pattern: str, where: str = "TRUE") -> str:
    mark = f"string_split(regexp_replace(text, '{pattern}', chr(1) || '\\1', 'g'), chr(1))"
    return f"""
      SELECT * FROM (SELECT doc_id, pos::INT AS pos, substr(raw, 1, 5) AS paragraph_id, {sql_clean('raw')} AS section,
        {sql_strip("regexp_replace(" + sql_clean('raw') + ", '^[0-9]{5}" + WS + "*', '')")} AS body
      FROM (SELECT doc_id, unnest(range(len(p) - 1)) AS pos, unnest(list_slice(p, 2, len(p))) AS raw FROM (SELECT doc_id, {mark} AS p FROM {sql_manual(code)})))
      WHERE length(section) > 80 AND {where}
    """


@query("section_split", sql_sections("17000 + doc_id % 700", V.SECTION_WIDE))
def section_split(spark, sf_dir):
    return C.sections(manual(spark, sf_dir, 17000 + F.col("doc_id") % 700)).select("doc_id", "pos", "paragraph_id", "section", "body")


KEYWORD_WHERE = "(" + " OR ".join(f"contains(lower(section), '{k}')" for k in STEM) + ")"
SQL_NARROW = sql_sections("17000 + length(text) % 100", V.SECTION_NARROW, KEYWORD_WHERE)


@query("section_narrow_keywords", f"SELECT doc_id, pos, section FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY doc_id, pos) AS nth FROM ({SQL_NARROW})) WHERE nth = 1 ORDER BY doc_id, pos LIMIT 80")
def section_narrow_keywords(spark, sf_dir):
    profile = C.SectionProfile(V.SECTION_NARROW, keywords=STEM)
    found = C.sections(manual(spark, sf_dir, 17000 + F.length("text") % 100), profile)
    return C.head(keep_first(found.select("doc_id", "pos", "section"), ["section"], ["doc_id", "pos"]), ["doc_id", "pos"], 80)


@query("formatted_chunk", f"SELECT doc_id, pos, 'Paragraph ' || paragraph_id || ': ' || body AS formatted_text FROM ({sql_sections('17000 + doc_id % 700', V.SECTION_WIDE)})")
def formatted_chunk(spark, sf_dir):
    s = C.sections(manual(spark, sf_dir, 17000 + F.col("doc_id") % 700))
    return s.select("doc_id", "pos", T.format_chunk(F.col("paragraph_id"), F.col("body")).alias("formatted_text"))


@query("dedup_text", "SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1")
def dedup_text(spark, sf_dir):
    return keep_first(docs(spark, sf_dir).select("doc_id", "text"), ["text"], ["doc_id"])


@query("dedup_composite", f"SELECT doc_id, pos, paragraph_id, body FROM (SELECT *, row_number() OVER (PARTITION BY paragraph_id, body ORDER BY doc_id, pos) AS nth FROM ({sql_sections('17000 + length(text) % 100', V.SECTION_WIDE)})) WHERE nth = 1")
def dedup_composite(spark, sf_dir):
    s = C.sections(manual(spark, sf_dir, 17000 + F.length("text") % 100))
    return keep_first(s.select("doc_id", "pos", "paragraph_id", "body"), ["paragraph_id", "body"], ["doc_id", "pos"])


@query("nonblank_lines", f"SELECT doc_id, pos::INT AS pos, line FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {TEXTS} AS t)) WHERE {sql_strip('line')} <> ''")
def nonblank_lines(spark, sf_dir):
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(~T.is_blank(F.col("line")))


@query("resume_antijoin", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_antijoin(spark, sf_dir):
    return resume(docs(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


# --- vectors and retrieval ---
@query("l2_normalize", "SELECT vec_id, list_transform(v, lambda x: round(x / greatest(sqrt(list_inner_product(v, v)), 1e-12), 9)) AS unit FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id + 1)) AS v FROM embeddings)")
def l2_normalize(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1))
    return table(spark, sf_dir, "embeddings").withColumn("v", v).select("vec_id", F.transform(vectors.l2_normalize(F.col("v")), lambda x: F.round(x, 9)).alias("unit"))


@query("mean_pool", "SELECT label, list(round(m, 9) ORDER BY i) AS pooled FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i) GROUP BY label")
def mean_pool(spark, sf_dir):
    """Every embedding is in its label's mean: the mask is 1 throughout."""
    pooled = vectors.mean_vectors(table(spark, sf_dir, "embeddings"), ["label"], "embedding", F.lit(1))
    return pooled.select("label", F.transform("pooled", lambda x: F.round(x, 9)).alias("pooled"))


@query("vector_topk", "SELECT query_id, rank::INT AS rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = R.vector_topk(asked, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), 5)
    return hits.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


SQL_STOP = "[" + ", ".join(f"'{w}'" for w in V.STOP_WORDS) + "]"


def sql_keywords(c: str) -> str:
    base = f"list_filter(list_distinct({sql_words(c)}), lambda w: NOT list_contains({SQL_STOP}, w))"
    more = " ".join(f"|| CASE WHEN list_has_any(k, {list(a)!r}) THEN {list(b)!r} ELSE [] END" for a, b in V.SYNONYMS)
    return f"(SELECT list_distinct(k {more}) FROM (SELECT {base} AS k))"


QUESTION = "'the paying parent and variance ' || text"


@query("query_expansion", f"SELECT item_id, list_sort({sql_keywords(QUESTION)}) AS keywords FROM benchmark")
def query_expansion(spark, sf_dir):
    q = F.concat(F.lit("the paying parent and variance "), "text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(R.keywords(q)).alias("keywords"))


SQL_QUERIES = f"(SELECT b.item_id AS query_id, b.text AS query, e.embedding::DOUBLE[] AS v, {sql_keywords('b.text')} AS k FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id)"
SQL_INDEX = f"(SELECT d.doc_id AS chunk_id, d.text, d.source AS source_doc, (17000 + d.doc_id % 700)::VARCHAR AS paragraph_id, e.embedding::DOUBLE[] AS v, list_distinct({sql_words('d.text')}) AS w FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"
SQL_SCORED = f"SELECT query_id, chunk_id, coalesce(list_inner_product(i.v, q.v), 0.0) AS vec, CASE WHEN len(k) = 0 THEN 0.0 ELSE len(list_intersect(k, w)) / len(k) END AS kw FROM {SQL_QUERIES} q, {SQL_INDEX} i"
SQL_HITS = f"SELECT query_id, rank::INT AS rank, chunk_id, score, vec, kw FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT *, 0.5 * vec + 0.5 * kw AS score FROM ({SQL_SCORED}))) WHERE rank <= 3"


def questions(spark, sf_dir):
    """Every benchmark item, with its vector where it has one (null = zero)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return table(spark, sf_dir, "benchmark").join(e, "item_id", "left").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "embedding")


def index(spark, sf_dir):
    """Every document, with its vector where it has one (null = zero): those without can win on their keywords."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    code = (17000 + F.col("doc_id") % 700).cast("string")
    return docs(spark, sf_dir).join(e, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), code.alias("paragraph_id"), F.col("source").alias("source_doc"), "text", "embedding")


@query("keyword_score", f"SELECT query_id, chunk_id, round(kw, 6) AS kw FROM ({SQL_SCORED}) WHERE kw > 0")
def keyword_score(spark, sf_dir):
    """All pairs of benchmark items and documents that share a keyword; no vector is asked for. A diagnostic: nearly all pairs do."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = R.keyword_scores(asked, docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text"))
    return hits.select("query_id", "chunk_id", F.round("kw_score", 6).alias("kw"))


@query("hybrid_topk", f"SELECT query_id, rank, chunk_id, round(vec, 4) AS vec_score, round(kw, 4) AS kw_score, round(score, 4) AS score FROM ({SQL_HITS})")
def hybrid_topk(spark, sf_dir):
    hits = R.retrieve(questions(spark, sf_dir), index(spark, sf_dir))
    return hits.select("query_id", "rank", "chunk_id", *[F.round(c, 4).alias(c) for c in ("vec_score", "kw_score", "score")])


SQL_CONTEXT = f"(SELECT query_id, string_agg('Paragraph ' || paragraph_id || ' (from ' || source_doc || '):' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM ({SQL_HITS}) h JOIN {SQL_INDEX} i USING (chunk_id) GROUP BY query_id)"


def hits_with_text(spark, sf_dir):
    i = index(spark, sf_dir)
    return R.contexts(R.retrieve(questions(spark, sf_dir), i), i)


@query("context_block", f"SELECT query_id, context FROM {SQL_CONTEXT}")
def context_block(spark, sf_dir):
    return P.context_blocks(hits_with_text(spark, sf_dir))


SQL_READER = "'<|im_start|>system' || chr(10) || " + sql_text(V.Names().fill(V.READER_SYSTEM)) + " || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Contexts:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || query || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


@query("rag_prompt", f"SELECT query_id, {SQL_READER} AS prompt FROM {SQL_CONTEXT} c JOIN {SQL_QUERIES} q USING (query_id)")
def rag_prompt(spark, sf_dir):
    blocks = P.context_blocks(hits_with_text(spark, sf_dir))
    return questions(spark, sf_dir).join(blocks, "query_id").select("query_id", P.reader_prompt(F.col("context"), F.col("query")).alias("prompt"))


@query("api_contexts", f"SELECT query_id, rank, paragraph_id, source_doc, text, round(score, 4) AS score FROM ({SQL_HITS}) h JOIN {SQL_INDEX} i USING (chunk_id)")
def api_contexts(spark, sf_dir):
    rows = R.api_rows(hits_with_text(spark, sf_dir)).select("query_id", F.posexplode("retrieved_contexts").alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).alias("rank"), "x.paragraph_id", "x.source_doc", "x.text", "x.score")


SQL_CHAT = "CASE WHEN min_by(role, turn) <> 'system' THEN '<|im_start|>system' || chr(10) || " + sql_text(V.DEFAULT_SYSTEM) + " || '<|im_end|>' || chr(10) ELSE '' END || string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)"


@query("chat_template", f"SELECT conv_id, {SQL_CHAT} AS prompt FROM conversations GROUP BY conv_id")
def chat_template(spark, sf_dir):
    return P.conversations(table(spark, sf_dir, "conversations"))


@query("chat_template_gen", f"SELECT conv_id, {SQL_CHAT} || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id")
def chat_template_gen(spark, sf_dir):
    return P.conversations(table(spark, sf_dir, "conversations"), generation=True)


# --- configurations and reports (answers by stand-ins) ---
def stub_answers(spark, sf_dir):
    q = questions(spark, sf_dir).select("query_id", "query")
    rows = [q.select("query_id", F.lit(p.config).alias("config"), (F.lit(None).cast("string") if p.config == "C" else F.concat(F.lit(p.config + ": "), "query")).alias("response")) for p in M.PROFILES]
    return rows[0].union(rows[1]).union(rows[2])


@query("config_matrix", f"SELECT query_id, 'A: ' || query AS config_a, 'B: ' || query AS config_b, 'N/A' AS config_c FROM {SQL_QUERIES}")
def config_matrix(spark, sf_dir):
    return report.matrix(stub_answers(spark, sf_dir))


SQL_LINES = f"(SELECT query_id, string_agg('- **Paragraph ' || paragraph_id || '** (Score: ' || printf('%.4f', score) || ', Source: `' || source_doc || '`):' || chr(10) || '  > ' || text || chr(10), chr(10) ORDER BY rank) AS found FROM ({SQL_HITS}) h JOIN {SQL_INDEX} i USING (chunk_id) GROUP BY query_id)"
SQL_FENCES = " || chr(10) || ".join(f"'##### Configuration {p.config}: {p.title}' || chr(10) || '```text' || chr(10) || {r} || chr(10) || '```' || chr(10)" for p, r in zip(M.PROFILES, ("'A: ' || query", "'B: ' || query", "'N/A'")))


@query("report", f"SELECT query_id, '### [QUESTION ' || query_id || '] ' || query || chr(10) || chr(10) || '#### Retrieved Contexts:' || chr(10) || found || chr(10) || '#### Comparative Outputs:' || chr(10) || {SQL_FENCES} || chr(10) || '---' || chr(10) AS report FROM {SQL_QUERIES} JOIN {SQL_LINES} USING (query_id)")
def question_report(spark, sf_dir):
    return report.question_reports(questions(spark, sf_dir), hits_with_text(spark, sf_dir), stub_answers(spark, sf_dir))


@query("console_report", f"SELECT query_id, rank, '  [' || rank || '] Score: ' || printf('%.4f', score) || ' | Paragraph: ' || paragraph_id || ' | Source: ' || source_doc || chr(10) || '      Text: ' || substr(text, 1, 120) || '...' AS line FROM ({SQL_HITS}) h JOIN {SQL_INDEX} i USING (chunk_id)")
def console_report(spark, sf_dir):
    return report.console_lines(hits_with_text(spark, sf_dir))


@query("train_steps", "SELECT role, count(*) AS n, floor(count(*) / 2 * 2)::BIGINT AS steps FROM conversations GROUP BY role")
def train_steps(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n")).withColumn("steps", T.train_steps(F.col("n")))


SQL_EMBED = """
WITH w AS (SELECT doc_id, md5(lower(unnest(regexp_extract_all(text, '[0-9A-Za-z]+')))) AS h FROM documents),
c AS (SELECT doc_id, ('0x' || substr(h, 1, 7))::BIGINT % 64 AS i, sum(CASE WHEN substr(h, 8, 1) >= '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM w GROUP BY ALL),
n AS (SELECT doc_id, greatest(sqrt(sum(x * x)), 1e-12) AS n FROM c GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(64)) AS i FROM documents)
SELECT p.doc_id, list(round((coalesce(c.x / n.n, 0.0))::FLOAT::DOUBLE, 5) ORDER BY p.i) AS embedding
FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i LEFT JOIN n ON p.doc_id = n.doc_id GROUP BY p.doc_id
"""


@query("embed_stand_in", SQL_EMBED)
def embed_stand_in(spark, sf_dir):
    """The plug-in point with the hashing stand-in, loaded once by each worker, over whole texts."""
    lazy = Lazy("hashing-64", lambda: M.HashingEmbedder(64))
    out = M.embed(docs(spark, sf_dir).select("doc_id", "text"), "text", lazy)
    return out.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 5)).alias("embedding"))


SQL_PLAIN = "'<|im_start|>system' || chr(10) || " + sql_text(V.DEFAULT_SYSTEM) + " || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || query || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


def sql_echo(tag: str, prompt: str, temperature: str, n: int) -> str:
    return f"'{tag}:' || substr(md5({prompt}), 1, 8) || ':{temperature}:{n}'"


SQL_GENERATED = " UNION ALL ".join(
    f"SELECT query_id, '{p.config}' AS config, {sql_echo('base', SQL_READER if p.with_context else SQL_PLAIN, f'{p.temperature:g}', 300)} || {sql_text(V.NO_ADAPTER if p.tuned else '')} AS response FROM {SQL_CONTEXT} c JOIN {SQL_QUERIES} q USING (query_id)"
    for p in M.PROFILES
)


@query("generate_stand_in", SQL_GENERATED)
def generate_stand_in(spark, sf_dir):
    """All three configurations answered by the stand-in generator, without a tuned model."""
    blocks = P.context_blocks(hits_with_text(spark, sf_dir))
    asked = questions(spark, sf_dir).select("query_id", "query").join(blocks, "query_id")
    return M.answers(asked, M.EchoGenerator(), None).select("query_id", "config", "response")


SQL_TUNING = f"""
SELECT query_id, '[QUESTION ' || query_id || ']' || chr(10) || 'Question: ' || query || chr(10) || chr(10) || {sql_text(V.BASE_OUTPUT)} || chr(10) || {sql_echo('base', SQL_PLAIN, '0.7', 150)} || chr(10)
  || repeat('-', 50) || chr(10) || {sql_text(V.Names().fill(V.TUNED_OUTPUT))} || chr(10) || {sql_echo('tuned', SQL_PLAIN, '0.7', 150)} || chr(10) || repeat('=', 80) AS report FROM {SQL_QUERIES}
"""


@query("tuning_report", SQL_TUNING)
def tuning_report(spark, sf_dir):
    """Base against tuned, by two stand-ins."""
    asked = questions(spark, sf_dir).select("query_id", "query")
    return report.tuning_report(asked, *M.tuning_answers(asked, M.EchoGenerator(), M.EchoGenerator("tuned")))


@query("nonempty_pages", f"SELECT page_id, n::INT AS page_no, part AS text FROM (SELECT page_id, unnest(range(len(p))) AS n, unnest(p) AS part FROM (SELECT page_id, string_split(html, '<p>') AS p FROM pages)) WHERE {sql_strip('part')} <> ''")
def nonempty_pages(spark, sf_dir):
    """Pages of a document (here the parts of a web page between paragraph marks) that aren't blank."""
    parts = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "<p>")).alias("page_no", "text"))
    return pages.nonempty(parts)


@query("tokenise_sft")
def tokenise_sft(spark, sf_dir):
    """Ids, mask and labels of the training chats, 128 at most; the tokenizer has no SQL."""
    import public_tokenizers

    return tokenised(sft_format(spark, sf_dir), "text", byte_level_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))).drop("text")


from tessera.plans import retrieval  # noqa: E402, F401  registers its queries here
