"""How well answers rest on what they were given: cited sections that exist, cited sections that were given, numbers that the contexts have.

All of it is joins and sums over citations and numbers, so it grows with them: known sections are joined on kind and first number, an answer's own contexts on the answer too.
A range of any width is one row, and it counts if one run of known numbers without a gap holds it.

Defined results: an answer without citations has null accuracy, one without numbers null grounding; an answer without contexts has none of its numbers
grounded; null texts are empty; repeated known sections count once; repeated citations count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import citations as C


def citation_rows(answers: DataFrame, key: str = "answer_id", text: str = "answer") -> DataFrame:
    """key, at, kind, first, last: a row for each citation, a range being one; ``at`` is the citation's place."""
    each = answers.select(key, F.posexplode(C.citations(F.col(text))).alias("at", "c"))
    return each.select(key, "at", "c.kind", "c.first", "c.last")


def citation_accuracy(answers: DataFrame, known: DataFrame, given: DataFrame | None = None, key: str = "answer_id", text: str = "answer") -> DataFrame:
    """A row an answer: n_cited (citations), n_real (all of whose numbers ``known`` (kind, first, last) covers), accuracy, and, with ``given`` (key, kind, first, last), n_given.

    Known sections are intervals of numbers, put together to runs without a gap. A citation's numbers are all known if the run that holds its first number holds its last one.
    """
    rows = citation_rows(answers, key, text)
    joined = rows.join(_reach(rows, known, []).withColumnRenamed("reach", "real"), ["kind", "first"], "left")
    if given is not None:
        mine = _reach(rows, given, [key]).withColumnRenamed("reach", "mine")
        joined = joined.join(mine, [key, "kind", "first"], "left")
    else:
        joined = joined.withColumn("mine", F.lit(None).cast("long"))
    held = lambda c: F.min(F.coalesce(F.col("last") <= F.col(c), F.lit(False))).alias(c)
    each = joined.groupBy(key, "at").agg(held("real"), held("mine"))
    n = each.groupBy(key).agg(F.count(F.lit(1)).alias("n_cited"), F.sum(F.col("real").cast("long")).alias("n_real"), F.sum(F.col("mine").cast("long")).alias("n_given"))
    out = answers.select(key).distinct().join(n, key, "left").fillna(0, ["n_cited", "n_real", "n_given"])
    out = out.withColumn("accuracy", F.when(F.col("n_cited") > 0, F.col("n_real") / F.when(F.col("n_cited") > 0, F.col("n_cited"))))
    return out if given is not None else out.drop("n_given")


def _reach(rows: DataFrame, sections: DataFrame, by: list[str], block: int = 1024) -> DataFrame:
    """by, kind, first, reach: for the distinct first numbers of ``rows`` that ``sections`` contain, the last number up to which they contain all.

    A run is found by the blocks of 1,024 numbers that it meets; runs are disjoint, so that is at most a row a run and block.
    """
    asked = rows.select(*by, "kind", "first").distinct().withColumn("block", F.floor(F.col("first") / block))
    runs = _runs(sections, [*by, "kind"], block)
    runs = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("reach") / block))))
    return asked.join(runs, [*by, "kind", "block"]).where("first BETWEEN start AND reach").select(*by, "kind", "first", "reach")


def _runs(sections: DataFrame, keys: list[str], block: int) -> DataFrame:
    """keys, start, reach: the numbers of ``sections`` as runs without a gap, intervals that overlap or touch being one. Numbers that no citation can have are left out.

    Intervals are dealt out by the block that they start in, at most one a start, however wide. What blocks tell each other is a row a block, so no task gathers a kind's intervals.
    """
    low, high = F.greatest(F.col("first").cast("long"), F.lit(0)), F.least(F.col("last").cast("long"), F.lit(C.LARGEST))
    spans = sections.where(f"first <= last AND last >= 0 AND first <= {C.LARGEST}").select(*keys, low.alias("start"), high.alias("last"))
    spans = spans.groupBy(*keys, "start").agg(F.max("last").alias("last")).withColumn("block", F.floor(F.col("start") / block))
    blocks, within = Window.partitionBy(*keys).orderBy("block"), Window.partitionBy(*keys, "block").orderBy("start")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = spans.groupBy(*keys, "block").agg(F.max("last").alias("top"))
    tops = tops.select(*keys, "block", F.max("top").over(earlier(blocks)).alias("carried"), F.max("top").over(Window.partitionBy(*keys)).alias("top"))
    # before: the last number of all intervals that start earlier; a run starts where it leaves a gap, and the run before ends there
    heads = spans.join(tops, [*keys, "block"]).withColumn("before", F.greatest("carried", F.max("last").over(earlier(within)))).where("before IS NULL OR start > before + 1")
    later = heads.groupBy(*keys, "block").agg(F.min("before").alias("before")).select(*keys, "block", F.lead("before").over(blocks).alias("next"))
    reach = F.coalesce(F.lead("before").over(within), "next", "top").alias("reach")
    return heads.join(later, [*keys, "block"]).select(*keys, "start", reach)


def number_grounding(answers: DataFrame, contexts: DataFrame, key: str = "answer_id", text: str = "answer", context: str = "context") -> DataFrame:
    """A row an answer: n_numbers (distinct numbers), n_grounded (those that one of its contexts has), grounding and hallucinated (the others, in order)."""
    said = answers.select(key, F.explode(C.figures(F.col(text))).alias("number")).distinct()
    read = contexts.select(key, F.explode(C.figures(F.col(context))).alias("number")).distinct().withColumn("found", F.lit(True))
    both = said.join(read, [key, "number"], "left")
    n = both.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_numbers"), F.sum(F.coalesce(F.col("found"), F.lit(False)).cast("long")).alias("n_grounded"),
        F.array_sort(F.collect_list(F.when(F.col("found").isNull(), F.col("number")))).alias("hallucinated"),
    )
    out = answers.select(key).distinct().join(n, key, "left").fillna(0, ["n_numbers", "n_grounded"])
    share = F.when(F.col("n_numbers") > 0, F.col("n_grounded") / F.when(F.col("n_numbers") > 0, F.col("n_numbers")))
    return out.withColumn("hallucinated", F.coalesce("hallucinated", F.array().cast("array<string>"))).withColumn("grounding", share)
