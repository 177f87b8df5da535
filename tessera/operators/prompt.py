"""Prompts, chats and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V


def context_blocks(hits: DataFrame) -> DataFrame:
    """(query_id, context): the hits' texts under their headings, in rank order. k rows make a block; it is null if none of them has a part."""
    part = F.concat(F.lit("Paragraph "), "paragraph_id", F.lit(" (from "), "source_doc", F.lit("):\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    joined = F.when(F.count(part) > 0, F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n"))
    return hits.groupBy("query_id").agg(joined.alias("context"))


def user_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Contexts:\n"), context, F.lit("\n\nQuestion: "), question)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def render_chat(messages: Column, generation: bool = False, default_system: str = V.DEFAULT_SYSTEM) -> Column:
    """The chat template over array<struct<role, content>>."""
    turn = lambda role, content: F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))
    head = F.when((F.size(messages) > 0) & (messages[0]["role"] != "system"), turn(F.lit("system"), F.lit(default_system))).otherwise(F.lit(""))
    body = F.array_join(F.transform(messages, lambda m: turn(m["role"], m["content"])), "")
    return F.concat(head, body, F.lit("<|im_start|>assistant\n" if generation else ""))


def conversations(turns: DataFrame, generation: bool = False) -> DataFrame:
    """(conv_id, prompt) of a table of turns."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    messages = F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return turns.groupBy("conv_id").agg(render_chat(messages, generation).alias("prompt"))


def sft_text(instruction: Column, output: Column) -> Column:
    return render_chat(F.array(message("user", instruction), message("assistant", output)))


def training_records(chunks: DataFrame, instruction: Column, output: Column) -> DataFrame:
    return chunks.select(instruction.alias("instruction"), F.lit("").alias("input"), output.alias("output"))


def qa_records(sections: DataFrame, section: str, generated: str, names: V.Names = V.Names()) -> DataFrame:
    """Records from generated questions: cleaned, accepted or replaced."""
    body = T.strip_code(F.substring(section, 1, 1000))
    return training_records(sections, T.accept_question(T.clean_question(F.col(generated)), body, names), body)


def reader_prompt(context: Column, question: Column, names: V.Names = V.Names()) -> Column:
    """The prompt of the configurations that see contexts; null without a context or a question."""
    system = F.lit(names.fill(V.READER_SYSTEM))
    prompt = render_chat(F.array(message("system", system), message("user", user_prompt(context, question))), generation=True)
    return F.when(context.isNotNull() & question.isNotNull(), prompt)


def plain_prompt(question: Column) -> Column:
    return F.when(question.isNotNull(), render_chat(F.array(message("user", question)), generation=True))
