"""Cutting documents into rows: fixed word windows and numbered sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V


def word_windows(df: DataFrame, text: str = "text", size: int = 175) -> DataFrame:
    """Adds chunk_idx, n_words and ``chunk``: consecutive windows of ``size`` words; the last may be short. Columns of these names are replaced. No shuffle."""
    words = F.filter(F.split(F.col(text), T.BLANK + "+"), lambda x: x != "")
    starts = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    kept = [c for c in df.columns if c.lower() not in ("chunk_idx", "n_words", "chunk")]
    own, window = unused(df.columns, "words"), unused(df.columns, "window")
    cut = F.transform(starts(F.size(own)), lambda s: F.slice(own, s + 1, size))
    return (
        df.select(*[F.col(f"`{c}`") for c in kept], words.alias(own))
        .select(*[F.col(f"`{c}`") for c in kept], F.posexplode(cut).alias("chunk_idx", window))
        .select(*[F.col(f"`{c}`") for c in kept], "chunk_idx", F.size(window).alias("n_words"), F.array_join(window, " ").alias("chunk"))
    )


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_window(df: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """The place of the first window of all: that of the first row in ``order`` with a word (a top-1 of each partition, no text is cut)."""
    return df.where(F.col(text).rlike(T.BLANK.replace("[", "[^", 1))).orderBy(*order).limit(1).select(*order, F.lit(0).alias("chunk_idx"))


def keep_long(chunks: DataFrame, order: list[str], least: int = 50, first: DataFrame | None = None) -> DataFrame:
    """Chunks of at least ``least`` words, and the very first chunk in ``order`` whatever its length.

    ``first``: its place, where it is known more cheaply than from the chunks.
    """
    own = {c: unused(chunks.columns, f"first_{c}") for c in order}
    first = (chunks.orderBy(*order).limit(1) if first is None else first).select(*[F.col(c).alias(own[c]) for c in order])
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(own[c]))
    return chunks.join(F.broadcast(first), same, "left").where((F.col("n_words") >= least) | F.col(own[order[-1]]).isNotNull()).drop(*own.values())  # one row


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a total order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


@dataclass(frozen=True)
class SectionProfile:
    """How a manual's numbered sections are recognised and which stay."""

    code: str
    least_chars: int = 80
    keywords: tuple[str, ...] = ()


NARROW = SectionProfile(V.SECTION_NARROW, keywords=V.SECTION_KEYWORDS)
WIDE = SectionProfile(V.SECTION_WIDE)


def has_keyword(c: Column, keywords) -> Column:
    low, found = F.lower(c), F.lit(False)
    for k in keywords:
        found = found | low.contains(k)
    return found


def sections(df: DataFrame, profile: SectionProfile = WIDE, text: str = "text") -> DataFrame:
    """A row per numbered section: pos (from 0, among sections), paragraph_id, ``section`` (clean, with its code) and ``body`` (without). Columns of these names are replaced.

    A section reaches from its code to the next one or the end; what stands before the first code is dropped.
    """
    code = "(?U)" + profile.code
    parts = F.filter(F.split(F.col(text), f"(?U)(?={profile.code})"), lambda x: x.rlike(f"\\A{code}"))
    raw = unused(df.columns, "raw")
    kept = [F.col(f"`{c}`") for c in df.columns if c != text and c.lower() not in ("pos", "paragraph_id", "section", "body")]
    out = (
        df.select(*kept, F.posexplode(parts).alias("pos", raw))
        .withColumn("paragraph_id", F.substring(raw, 1, 5))
        .withColumn("section", T.clean_text(F.col(raw)))
        .where(F.length("section") > profile.least_chars)
    )
    if profile.keywords:
        out = out.where(has_keyword(F.col("section"), profile.keywords))
    return out.withColumn("body", T.strip(T.strip_code(F.col("section")))).drop(raw)
