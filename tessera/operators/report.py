"""Comparison reports over questions and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V
from tessera.operators.models import PROFILES


def matrix(answers: DataFrame, configs=("A", "B", "C"), missing: str = V.NOT_AVAILABLE) -> DataFrame:
    """(query_id, config_a, config_b, ...): a row per question, missing answers filled in."""
    wide = answers.groupBy("query_id").pivot("config", list(configs)).agg(F.first("response"))
    return wide.select("query_id", *[F.coalesce(F.col(c), F.lit(missing)).alias(f"config_{c.lower()}") for c in configs])


def question_reports(questions: DataFrame, hits: DataFrame, answers: DataFrame, profiles=PROFILES) -> DataFrame:
    """(query_id, report): the Markdown section of each question."""
    line = F.concat(
        F.lit("- **Paragraph "), "paragraph_id", F.lit("** (Score: "), T.render_score(F.col("score")), F.lit(", Source: `"), "source_doc", F.lit("`):\n  > "), "text", F.lit("\n"),
    )
    found = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("found"))
    wide = matrix(answers, [p.config for p in profiles])
    fence = lambda p: F.concat(F.lit(f"##### Configuration {p.config}: {p.title}\n```text\n"), F.col(f"config_{p.config.lower()}"), F.lit("\n```\n"))
    body = F.concat_ws(
        "\n", F.concat(F.lit("### [QUESTION "), F.col("query_id").cast("string"), F.lit("] "), "query", F.lit("\n")), F.lit("#### Retrieved Contexts:"),
        F.col("found"), F.lit("#### Comparative Outputs:"), *map(fence, profiles), F.lit("---\n"),
    )
    return questions.select("query_id", "query").join(found, "query_id", "left").join(wide, "query_id", "left").select("query_id", body.alias("report"))


def full_report(sections: DataFrame, title: str = "Comparative Evaluation Report") -> str:
    """One Markdown text; the questions of a report are few by nature and come to the driver."""
    parts = [r["report"] for r in sections.orderBy("query_id").toLocalIterator()]
    head = [f"# {title}", f"\nThis report provides the non-truncated outputs of the evaluation configurations on the {len(parts)} questions.", "\n## Comparison Matrix\n"]
    return "\n".join(head + parts)


def tuning_report(questions: DataFrame, base: DataFrame, tuned: DataFrame, names: V.Names = V.Names()) -> DataFrame:
    """(query_id, report): what the base model and the tuned one say to each question. ``questions``: query_id, query; answers: query_id, response."""
    rule = lambda c, n: F.lit(c * n)
    both = questions.select("query_id", "query").join(base.select("query_id", F.col("response").alias("base")), "query_id", "left").join(tuned.select("query_id", F.col("response").alias("tuned")), "query_id", "left")
    missing = F.lit(V.NOT_AVAILABLE)
    body = F.concat_ws(
        "\n", F.concat(F.lit("[QUESTION "), F.col("query_id").cast("string"), F.lit("]")), F.concat(F.lit("Question: "), "query", F.lit("\n")), F.lit(V.BASE_OUTPUT), F.coalesce("base", missing),
        rule("-", 50), F.lit(names.fill(V.TUNED_OUTPUT)), F.coalesce("tuned", missing), rule("=", 80),
    )
    return both.select("query_id", body.alias("report"))


def console_lines(hits: DataFrame, width: int = 120) -> DataFrame:
    """(query_id, rank, line): what is printed for a hit."""
    return hits.select(
        "query_id", "rank",
        F.concat(F.lit("  ["), F.col("rank").cast("string"), F.lit("] Score: "), T.render_score(F.col("score")), F.lit(" | Paragraph: "), "paragraph_id", F.lit(" | Source: "), "source_doc", F.lit("\n      Text: "), T.preview(F.col("text"), width)).alias("line"),
    )
