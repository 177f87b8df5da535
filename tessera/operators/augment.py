"""Augmentation of training data: hard negatives, and conversations of several turns.

Hard negatives are documents that a retriever ranks high for a question but that don't answer it: not among the known positives, not a near copy of one (``shingle`` words,
similarity ``similarity``), and without any known answer in their words; of a question's equal negatives only the best-ranked stays. A question's candidates meet its positives,
so work grows with the hits; texts are fetched for these only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.workers import ship


def shingles(words: list[str], k: int) -> set:
    """Every k words in a row; the whole of a shorter text."""
    return {tuple(words[i: i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def likeness(pairs: DataFrame, keys: list[str], one: str, two: str, shingle: int = 5) -> DataFrame:
    """keys and ``likeness``: Jaccard similarity of the shingle sets of two columns of word arrays (0 if either has no words). Row by row."""
    ship(pairs.sparkSession)
    kind = pairs.select(*keys).schema.add("likeness", "double")
    n = len(keys)

    def run(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                a, b = shingles(a or [], shingle), shingles(b or [], shingle)
                out.append(len(a & b) / len(a | b) if a and b else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.array(out, float))], [*keys, "likeness"])

    return pairs.select(*keys, one, two).mapInArrow(run, kind)


def hard_negatives(
    hits: DataFrame, positives: DataFrame, texts: DataFrame, answers: DataFrame | None = None, k: int = 5, similarity: float = 0.8, shingle: int = 5, key: str = "query_id", item: str = "id",
) -> DataFrame:
    """key, place (from 1), item, rank of the ``k`` best-ranked negatives of each question.

    ``hits``: key, rank, item; ``positives``: key, item; ``texts``: item, text; ``answers``: key, answer. Hits whose text is null, empty or missing are no negatives; null and wordless answers
    exclude nothing; repeated hits count once, at their best rank.
    """
    best = hits.groupBy(key, item).agg(F.min("rank").alias("rank"))
    known = positives.select(key, item).distinct()
    candidates = best.join(known, [key, item], "left_anti")
    words = texts.select(item, T.words(F.coalesce(F.col("text"), F.lit(""))).alias("words")).join(best.select(item).union(known.select(item)).distinct(), item, "left_semi")
    words = words.groupBy(item).agg(F.max("words").alias("words"))  # a repeated id has one text
    own = candidates.join(words, item).where(F.size("words") > 0)
    right = known.join(words, item).select(key, F.col("words").alias("right"))
    near = likeness(own.join(right, key), [key, item], "words", "right", shingle).where(F.col("likeness") >= similarity).select(key, item).distinct()
    own = own.join(near, [key, item], "left_anti")
    if answers is not None:
        line = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
        said = answers.select(key, T.words(F.coalesce(F.col("answer"), F.lit(""))).alias("a")).where(F.size("a") > 0).select(key, line(F.col("a")).alias("answer"))
        told = own.join(said, key).where(F.contains(line(F.col("words")), F.col("answer"))).select(key, item).distinct()
        own = own.join(told, [key, item], "left_anti")
    text = F.sha2(F.array_join("words", " "), 256).alias("text")
    first = own.select(key, item, "rank", text).groupBy(key, "text").agg(F.min(F.struct("rank", item)).alias("first")).select(key, F.col(f"first.{item}").alias(item), F.col("first.rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("rank", item))
    return first.withColumn("place", place).where(F.col("place") <= k).select(key, "place", item, "rank")


def threads(pairs: DataFrame, turns: int = 3, source: str = "source", pos: str = "pos", question: str = "question", answer: str = "answer") -> DataFrame:
    """conv_id, turn, role, text: the pairs of a source at ``turns`` consecutive places become one conversation, user and assistant in turn. ``pos`` numbers a source's pairs from 0.

    Row by row, no shuffle. Pairs with a blank question or answer, or without source or place, are left out; the turns around them keep their numbers.
    """
    if turns < 1:
        raise ValueError("a conversation has at least one turn")
    use = pairs.where(F.col(source).isNotNull() & F.col(pos).isNotNull() & ~T.is_blank(F.coalesce(question, F.lit(""))) & ~T.is_blank(F.coalesce(answer, F.lit(""))))
    place = F.pmod(F.col(pos), F.lit(turns))
    said = F.array(F.struct(F.lit(0).alias("n"), F.lit("user").alias("role"), F.col(question).alias("text")), F.struct(F.lit(1).alias("n"), F.lit("assistant").alias("role"), F.col(answer).alias("text")))
    rows = use.select(F.concat_ws("-", source, F.floor(F.col(pos) / turns)).alias("conv_id"), (2 * place).cast("int").alias("at"), F.explode(said).alias("x"))
    return rows.select("conv_id", (F.col("at") + F.col("x.n")).alias("turn"), "x.role", "x.text")
