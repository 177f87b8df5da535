"""Quality rules as a short-circuit cascade.

A rule looks at a document's measures (words, lines, counts, each made once and only if asked for) and says
whether the document may stay. On a sample of the table, chosen by a hash, every rule is asked about every document, on measures made anew for it: that tells which
measures a rule needs, what each costs, and which documents which rules reject. The rules are then put in order once, for all tasks: next comes
the one that rejects most of what is left per unit of what it still costs, a measure that an earlier rule made being free.
Tasks stop at the first rule that rejects. The order only changes what is spent: the verdict is the conjunction of all rules.

Defined results: null text counts as empty; an empty text has no words and fails the rule on length. Repeated rows are judged each;
other columns are passed through by ``quality_filter`` and ignored by the query. The stop-word rule knows four languages; a row whose ``lang`` names another isn't
asked for their words, and one without lang is.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import documents, lean, ship

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Frequent function words of the languages the rule knows.
LANGS = ("de", "en", "es", "fr")
STOP_WORDS = frozenset(
    "the of and to a in is that for it as was with be by on are this from or an at "
    "de la le et les des en un une du que dans pour pas est sur qui elle avec par "
    "der die und das den ist von zu mit sich auf für ein eine nicht auch "
    "el los las se y del por con una no su para al lo como".split()
)


class measure_of(cached_property):
    """A measure that is made once and notes the seconds it took, less those of the measures it asked for."""

    def __get__(self, m, owner=None):
        if m is None or self.attrname in m.__dict__:
            return super().__get__(m, owner)
        outer, m.inner = m.inner, 0.0
        began = time.perf_counter()
        value = super().__get__(m, owner)
        took = time.perf_counter() - began
        m.spent[self.attrname] = took - m.inner
        m.inner = outer + took
        return value


class Measures:
    """What rules ask of one text; everything is made at most once."""

    def __init__(self, text: str | None, lang: str | None = None):
        self.text, self.lang = text or "", lang
        self.spent: dict[str, float] = {}
        self.inner = 0.0

    @measure_of
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @measure_of
    def n_words(self) -> int:
        return len(self.words)

    @measure_of
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @measure_of
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @measure_of
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(BLANKS)]

    @measure_of
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @measure_of
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        ids = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        x = np.fromiter(map(ids.__getitem__, self.words), np.int64, n)
        code = x[:-1] * len(ids) + x[1:]
        if len(ids) >= 1 << 20:
            code = np.unique(code, return_inverse=True)[1]
        code = code[:-1] * len(ids) + x[2:]
        order = np.argsort(code, kind="stable")
        ranked = code[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            return 0
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k: n - 2 + k] |= twice
        return int(covered.sum())

    @measure_of
    def n_stop_words(self) -> int:
        return sum(map(STOP_WORDS.__contains__, self.text.lower().split()))

    @measure_of
    def n_letter_words(self) -> int:
        return sum(any(map(str.isalpha, w)) for w in self.text.split())

    @property
    def other_lang(self) -> bool:
        return self.lang is not None and self.lang not in LANGS


@dataclass(frozen=True)
class Rule:
    name: str
    keeps: Callable[[Measures], bool]


BASE_RULES = (
    Rule("length", lambda m: m.n_words >= 50),
    Rule("repeats", lambda m: 100 * m.n_repeat_words <= 50 * m.n_words),
)
METHOD_RULES = (
    Rule("symbols", lambda m: 10 * m.n_symbols <= m.n_words),
    Rule("word_length", lambda m: 3 * m.n_words <= m.word_chars <= 12 * m.n_words),
    Rule("dup_lines", lambda m: 2 * m.n_dup_lines <= len(m.lines)),
    Rule("stop_words", lambda m: m.other_lang or m.n_stop_words >= 2),
    Rule("letter_words", lambda m: 10 * m.n_letter_words >= 7 * len(m.text.split())),
)


def share_between(k: int, n: int, z: float = 1.645) -> tuple[float, float]:
    """Bounds of a share of which k of n were seen (Wilson's interval); the fewer there are, the wider it is."""
    if not n:
        return 0.0, 1.0
    middle, spread = k + z * z / 2, z * math.sqrt(k * (n - k) / n + z * z / 4)
    return max(0.0, (middle - spread) / (n + z * z)), min(1.0, (middle + spread) / (n + z * z))


#: For a corpus that keeps short documents: rates are asked of every text, and reject it if they are beyond doubt at its length.
CORPUS_RULES = (
    Rule("words", lambda m: m.n_words >= 1),
    Rule("repeats", lambda m: share_between(m.n_repeat_words, m.n_words)[0] <= 0.5),
    *(r for r in METHOD_RULES if r.name not in ("stop_words", "letter_words")),
    Rule("stop_words", lambda m: m.other_lang or share_between(min(m.n_stop_words, m.n_words), m.n_words)[1] >= 0.04),
    Rule("letter_words", lambda m: share_between(m.n_letter_words, len(m.text.split()))[1] >= 0.7),
)
SAMPLE = 4096  # documents, about


@dataclass
class Trial:
    """What a sample says of the rules: documents by the set of rules that reject them, and each rule's and measure's seconds."""

    patterns: dict[int, int]
    own: list[float]
    needs: list[set[str]]
    cost: dict[str, float]


def trial(texts, rules) -> Trial:
    """Every rule on every (text, lang), on fresh measures."""
    out = Trial({}, [0.0] * len(rules), [set() for _ in rules], {})
    for text, lang in texts:
        bits = 0
        for i, rule in enumerate(rules):
            m = Measures(text, lang)
            began = time.perf_counter()
            bits |= (not rule.keeps(m)) << i
            took = time.perf_counter() - began
            out.own[i] += max(0.0, took - sum(m.spent.values()))
            out.needs[i] |= m.spent.keys()
            for name, s in m.spent.items():  # a measure that several rules need is timed several times
                n, total = out.cost.get(name, (0, 0.0))
                out.cost[name] = (n + 1, total + s)
        out.patterns[bits] = out.patterns.get(bits, 0) + 1
    return out


def order_of(rules, patterns: dict[int, int], own: list[float], needs: list[set[str]], cost: dict[str, float], made=()) -> list[int]:
    """The rules' numbers by rejections of what is left per cost that is left; ``made``: measures that are there anyway. ``own`` and ``cost`` are seconds for a document."""
    left, made, order = dict(patterns), set(made), []
    todo = list(range(len(rules)))
    while todo:
        def gain(i: int) -> tuple:
            price = own[i] + sum(cost.get(n, 0.0) for n in needs[i] - made)
            return (sum(n for bits, n in left.items() if bits >> i & 1) / max(price, 1e-12), -price, -i)

        best = max(todo, key=gain)
        todo.remove(best)
        order.append(best)
        made |= needs[best]
        left = {bits: n for bits, n in left.items() if not bits >> best & 1}
    return order


def learned_order(docs: DataFrame, text: str, rules, sample: int = SAMPLE, made=()) -> list:
    """The rules in the order that a sample of about ``sample`` rows gives. What comes to the driver: a row for each set of rules that reject together, measure and task."""
    n = docs.count()
    lang = [F.col("lang").cast("string")] if "lang" in docs.columns else [F.lit(None).cast("string").alias("lang")]
    key = "doc_id" if "doc_id" in docs.columns else text
    some = docs.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(8)), F.lit(max(1, n // max(1, sample)))) == 0).select(F.col(text).cast("string"), *lang)

    def run(batches):
        for batch in batches:
            t = trial(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), rules)
            rows = [("pattern", str(bits), float(k), 1) for bits, k in t.patterns.items()]
            rows += [("own", str(i), s, batch.num_rows) for i, s in enumerate(t.own)]
            rows += [("needs", f"{i} {name}", 0.0, 1) for i, names in enumerate(t.needs) for name in names]
            rows += [("cost", name, s, k) for name, (k, s) in t.cost.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.float64(), pa.int64()))], ["what", "name", "value", "n"])

    got = some.mapInArrow(lean(run), "what string, name string, value double, n long").groupBy("what", "name").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()
    patterns = {int(r["name"]): int(r["value"]) for r in got if r["what"] == "pattern"}
    own, needs = [0.0] * len(rules), [set() for _ in rules]
    for r in got:
        if r["what"] == "own":
            own[int(r["name"])] = r["value"] / max(1, r["n"])
        elif r["what"] == "needs":
            i, name = r["name"].split(" ")
            needs[int(i)].add(name)
    cost = {r["name"]: r["value"] / max(1, r["n"]) for r in got if r["what"] == "cost"}
    return [rules[i] for i in order_of(rules, patterns, own, needs, cost, made)]


def keeps(rules, m: Measures) -> bool:
    return all(rule.keeps(m) for rule in rules)


def quality_filter(docs: DataFrame, text: str = "text", rules=BASE_RULES + METHOD_RULES, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, all columns as they were."""
    ship(docs.sparkSession)
    rules = learned_order(docs, text, rules, sample)
    at, lang = docs.columns.index(text), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches):
        for batch in batches:
            langs = [None] * batch.num_rows if lang is None else batch.column(lang).cast(pa.string()).to_pylist()
            keep = [keeps(rules, Measures(t, x)) for t, x in zip(batch.column(at).to_pylist(), langs)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text", rules=METHOD_RULES, sample: int = SAMPLE) -> DataFrame:
    """Every row's doc_id and base measures, with the base verdict and the cascade's."""
    ship(docs.sparkSession)
    rules = learned_order(docs, text, rules, sample, made={*COUNTS, "words", "lines"})
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches):
        for batch in batches:
            rows = []
            for t, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                m = Measures(t, lang)
                failed = not keeps(BASE_RULES, m)
                rows.append((*(getattr(m, c) for c in COUNTS), failed, not failed and keeps(rules, m)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], schema.names)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string"), lang.alias("lang")).mapInArrow(lean(run), schema)


def op8_quality_rules(spark, sf_dir):
    return measure(documents(spark, sf_dir))
