"""The engine's end-to-end plans: training data, index building, question answering."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V
from tessera.operators import chunk as C
from tessera.operators import models as M
from tessera.operators import prompt as P
from tessera.operators import retrieve as R
from tessera.operators.dedup import keep_first


def instruction_dataset(documents: DataFrame, order: list[str], text: str = "text", cap: int | None = 300, least: int = 50, names: V.Names = V.Names()) -> DataFrame:
    """Records from word windows: an instruction made of each chunk's topic. ``cap``: the first chunks in order, or None for all."""
    documents = documents.select(*order, text)
    chunks = C.keep_long(C.word_windows(documents, text), [*order, "chunk_idx"], least, C.first_window(documents, order, text))
    if cap is not None:
        chunks = C.head(chunks, [*order, "chunk_idx"], cap)
    return P.training_records(chunks, T.instruction(F.col("chunk"), names), F.col("chunk"))


def policy_sections(documents: DataFrame, order: list[str], profile: C.SectionProfile = C.NARROW, text: str = "text", cap: int | None = 80) -> DataFrame:
    """Distinct sections with a keyword, the first occurrence of each, capped in order."""
    found = keep_first(C.sections(documents, profile, text), ["section"], [*order, "pos"])
    return found if cap is None else C.head(found, [*order, "pos"], cap)


def paragraph_chunks(documents: DataFrame, source: str = "source_doc", text: str = "text") -> DataFrame:
    """The index's rows before embedding: (paragraph_id, text, formatted_text, source_doc, pos), duplicates of id and text gone."""
    found = C.sections(documents.select(F.col(source).alias("source_doc"), F.col(text).alias("text")), C.WIDE)
    rows = found.select("source_doc", "pos", "paragraph_id", F.col("body").alias("text"))
    return keep_first(rows, ["paragraph_id", "text"], ["source_doc", "pos"]).withColumn("formatted_text", T.format_chunk(F.col("paragraph_id"), F.col("text")))


def build_index(chunks: DataFrame, embedder: M.Embedder) -> DataFrame:
    """Chunks with chunk_id and unit vectors. chunk_id ascends with (source_doc, pos), so that ties go to the earlier chunk: it is pos plus the places of
    all sources before. No window is over a source's chunks; sources are summed up in groups by their first letters."""
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda w: F.coalesce(F.sum("places").over(w), F.lit(0))
    sources = chunks.groupBy(F.col("source_doc").alias("of")).agg((F.max("pos") + 1).cast("long").alias("places")).withColumn("head", F.substring("of", 1, 2))
    heads = sources.groupBy("head").agg(F.sum("places").alias("places")).select(F.col("head").alias("of_head"), so_far(before().orderBy("head")).alias("first"))
    base = sources.withColumn("inner", so_far(before("head").orderBy("of"))).join(heads, F.col("head").eqNullSafe(F.col("of_head")))
    ided = chunks.join(base.select("of", (F.col("first") + F.col("inner")).alias("base")), F.col("source_doc").eqNullSafe(F.col("of")))
    ided = ided.withColumn("chunk_id", F.col("base") + F.col("pos")).drop("of", "base")
    return M.embed(ided, "formatted_text", embedder).withColumn("model_name", F.lit(embedder.name))


def retrieve_contexts(questions: DataFrame, index: DataFrame, embedder: M.Embedder, k: int = 3) -> DataFrame:
    """``questions``: query_id, query. Hits with their texts."""
    return R.contexts(R.retrieve(M.embed(questions, "query", embedder), index, k), index)


def compare(questions: DataFrame, index: DataFrame, embedder: M.Embedder, base: M.Generator, tuned: M.Generator | None, *, missing: str = "na", names: V.Names = V.Names()) -> tuple[DataFrame, DataFrame]:
    """(hits, answers) of all configurations; hits are computed once and kept for those that use them."""
    hits = retrieve_contexts(questions, index, embedder).persist()
    asked = questions.join(P.context_blocks(hits), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return hits, M.answers(asked, base, tuned, missing=missing, names=names)


def answer_query(spark: SparkSession, query: str, index: DataFrame, embedder: M.Embedder, base: M.Generator, tuned: M.Generator | None = None, names: V.Names = V.Names()) -> str:
    """One question's contexts and three answers as JSON. Raises ValueError on a blank question."""
    if not (query or "").strip():
        raise ValueError("Empty query provided.")
    query = query.strip()
    began = time.perf_counter()
    questions = spark.createDataFrame([(0, query)], "query_id long, query string")
    hits = retrieve_contexts(questions, index, embedder).persist()
    try:
        found = [r.asDict(True) for r in R.api_rows(hits).select(F.explode("retrieved_contexts").alias("x")).select("x.*").collect()]
        took = time.perf_counter() - began
        asked = questions.join(P.context_blocks(hits), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
        got = {r["config"]: r for r in M.answers(asked, base, tuned, names=names).collect()}
    finally:
        hits.unpersist()
    out = {"query": query, "retrieved_contexts": found, "retrieval_time": round(took, 3)}
    for p in M.PROFILES:
        out[f"config_{p.config.lower()}"] = {"response": got[p.config]["response"], "time": round(got[p.config]["seconds"], 2)}
    return json.dumps(out, ensure_ascii=False)
