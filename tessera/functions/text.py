"""Scalar text functions: Column in, Column out, all inside the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V

#: Blanks left after the ASCII strip, and all white space of Unicode as Python's str.split sees it.
ASCII_BLANK = r"[\x09-\x0d\x1c-\x20]"
BLANK = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")


def squash(c: Column, blank: str = BLANK) -> Column:
    """White-space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, blank + "+", " "))


def fold_punctuation(c: Column) -> Column:
    """Curly quotes and long dashes to ASCII; no-break space and tab to a blank."""
    return F.translate(c, "’‘“”–—\xa0\t", "''\"\"--  ")


def strip_non_ascii(c: Column) -> Column:
    """Other characters are dropped, not spaced."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def clean_text(c: Column) -> Column:
    return squash(strip_non_ascii(fold_punctuation(c)), ASCII_BLANK)


def strip_code(c: Column) -> Column:
    """Without a five-digit code at the start; no word boundary is asked after it."""
    return F.regexp_replace(c, rf"\A{BLANK}*\d{{5}}{BLANK}*", "")


def clean_question(c: Column) -> Column:
    c = F.regexp_replace(strip(c), rf"(?i)\A(Question|Q):{BLANK}*", "")
    return strip(F.regexp_replace(c, r"(?U)\b[0-9]{5}\b", ""))


def accept_question(question: Column, section: Column, names: V.Names = V.Names()) -> Column:
    """The question if it is one, else one made of the section's start."""
    made = F.concat(F.lit(names.fill(V.FALLBACK_QUESTION)), F.substring(section, 1, 80), F.lit("..."))
    return F.when((F.length(question) > 15) & question.contains("?"), question).otherwise(made)


def preview(c: Column, n: int) -> Column:
    return F.concat(F.substring(c, 1, n), F.lit("..."))


def shorten(c: Column, n: int = 120) -> Column:
    """At most n characters, the last three of a longer text being an ellipsis."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\."), strip), lambda x: x != "")


def first_sentence(c: Column) -> Column:
    """The first of ``sentences``, by one pattern; empty if there is none."""
    return strip(F.regexp_extract(c, rf"\A[.{BLANK[1:]}*([^.]*)", 1))


def topic(c: Column, default: str = V.DEFAULT_TOPIC) -> Column:
    return F.coalesce(shorten(F.nullif(first_sentence(c), F.lit(""))), F.lit(default))


def instruction(c: Column, names: V.Names = V.Names()) -> Column:
    """One of the templates, by the text's length, about its topic."""
    heads = F.array(*[F.lit(names.fill(t)) for t in V.INSTRUCTIONS])
    return F.concat(F.element_at(heads, F.pmod(F.length(c), F.lit(len(V.INSTRUCTIONS))) + 1), topic(c))


def question_prompt(section: Column, names: V.Names = V.Names()) -> Column:
    head, tail = V.QUESTION_PROMPT
    return F.concat(F.lit(names.fill(head)), section, F.lit(tail))


def format_chunk(paragraph_id: Column, text: Column) -> Column:
    return F.concat(F.lit("Paragraph "), paragraph_id, F.lit(": "), text)


def lower(c: Column) -> Column:
    """In lower case letter by letter, as in the SQL; Spark makes two characters of one letter and lets another depend on its place."""
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def words(c: Column) -> Column:
    """Words in lower case, in order, with repeats."""
    return F.regexp_extract_all(lower(c), F.lit(WORD), F.lit(0))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def escape_html(c: Column) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(V.NO_RESPONSE)).otherwise(out)


def citations(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(V.CITATION), F.lit(0))


def figures(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(V.FIGURE), F.lit(0))


def render_html(c: Column) -> Column:
    """Escaped, citations and figures marked, line feeds as breaks."""
    out = F.regexp_replace(escape_html(c), V.CITATION, '<span class="citation">$1</span>')
    out = F.regexp_replace(out, V.FIGURE, '<span class="number-highlight">$1</span>')
    return F.replace(out, F.lit("\n"), F.lit("<br>"))


def render_score(c: Column) -> Column:
    """To four places; null, nan, inf and -inf as in the SQL."""
    c = c.cast("double")
    odd = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.when(c.isNotNull(), F.coalesce(odd, F.format_string("%.4f", c)))


def train_steps(n: Column, batch: int = 1, accumulate: int = 2, epochs: int = 2) -> Column:
    return F.floor(n / F.lit(batch * accumulate) * epochs).cast("long")
