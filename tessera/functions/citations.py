"""Citations of an answer, resolved against the sections that there are, and its numbers, looked for in what it was given to read.

A citation names paragraphs, sections, regulations, chapters, tables or schedules by number: single ones, lists and ranges ("paragraphs 3 to 5 and 7"), with letters and
sub-paragraphs ("regulation 12A(3)(b)"). A number of more than six digits and an address of four numbers ("para 97.108.109.124") are none. A list is one citation a number or range, and a range of any width is one citation of all its numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 999_999  # number that a citation can have: six digits at most
_NUMBER = r"\d{1,6}(?!\d)(?!(?:\.\d+){3})[a-zA-Z]?(?:\(\w{1,5}\))*"
_JOIN = r"\s*(?:,\s*(?:and\s+)?|and\s+|&\s*|to\s+|-\s*|–\s*)"
#: A citation: its kind, then numbers with what joins them.
CITATION = rf"(?i)\b(paragraph|para|section|regulation|reg|chapter|table|schedule|article)s?\.?\s+({_NUMBER}(?:{_JOIN}{_NUMBER})*)"
_ITEM = rf"(?i)({_NUMBER})(?:\s*(?:to\s+|-\s*|–\s*)({_NUMBER}))?"
#: Short forms of the kinds.
KINDS = {"para": "paragraph", "reg": "regulation"}
#: A number as it stands in running text: thousands, decimals, per cent or a pound sign.
FIGURE = r"£?\d[\d,]*(?:\.\d+)?%?"


def citations(text: Column) -> Column:
    """Array of structs: kind (lower case), first and last (whole numbers), label (the first number as written, lower case). In order, repeats included."""
    whole = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), F.lit(0))

    def one(c: Column) -> Column:
        kind = F.lower(F.regexp_extract(c, CITATION, 1))
        for short, long in KINDS.items():
            kind = F.when(kind == short, F.lit(long)).otherwise(kind)
        items = F.regexp_extract_all(F.regexp_extract(c, CITATION, 2), F.lit(_ITEM), F.lit(0))
        return F.transform(items, lambda i: F.struct(kind.alias("kind"), *_ends(i)))

    return F.flatten(F.transform(whole, one))


def _ends(item: Column):
    left, right = F.regexp_extract(item, _ITEM, 1), F.regexp_extract(item, _ITEM, 2)
    digits = lambda c: F.regexp_extract(c, r"^\d+", 0)
    first, last = digits(left).cast("long"), F.when(right != "", digits(right).cast("long"))
    return first.alias("first"), F.greatest(F.coalesce(last, first), first).alias("last"), F.lower(left).alias("label")


def figures(text: Column) -> Column:
    """The distinct numbers in a text as plain ones: without pound signs and thousands' commas, per cent signs kept."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FIGURE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "[£,]", ""), r"^0+(?=\d)", "")))
