import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocabulary as V

ODD = [
    "“a” ‘b’ – c — d", "a\xa0b\tc", "a b", "a​b", "a\x85b", "\x1ca\x1fb\x0b\x0c", "£25 café", "", "   ", "😀 x", "a\x00b",
    "Café naïve don’t parent's 25% x_y ½", "123456 x", " 17001 x", "Question: Q: What is 17001 this rule?", "q:  12345?", "é17001 17001é 17001",
]


def py_clean(s):
    for a, b in zip("’‘“”–—\xa0\t", "''\"\"--  "):
        s = s.replace(a, b)
    return " ".join(s.encode("ascii", "ignore").decode().split())


def apply(spark, strings, *columns):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i long, s string")
    return [r[1:] for r in sorted(df.select("i", *columns).collect())]


def test_scalars_equal_python(spark):
    c = F.col("s")
    got = apply(spark, ODD, T.clean_text(c), T.squash(c), T.strip_code(c), T.clean_question(c), T.words(c), T.is_blank(c))
    for s, (clean, squashed, body, question, words, blank) in zip(ODD, got):
        assert clean == py_clean(s)
        assert squashed == " ".join(s.split())
        assert body == re.sub(r"^\s*\d{5}\s*", "", s)
        assert question == re.sub(r"\b\d{5}\b", "", re.sub(r"^(Question|Q):\s*", "", s.strip(), flags=re.I)).strip()
        assert words == re.findall(r"\b\w+\b", s.lower())
        assert blank == (not s.strip())


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(max_codepoint=0x7FF, exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=20))
def test_clean_and_squash_any_text(spark, strings):
    c = F.col("s")
    for s, (clean, squashed) in zip(strings, apply(spark, strings, T.clean_text(c), T.squash(c))):
        assert clean == py_clean(s) and squashed == " ".join(s.split())


def test_lengths_and_topics(spark):
    c = F.col("s")
    strings = ["a" * 120, "b" * 121 + ". x", ". . ", "One. Two.", ""]
    got = apply(spark, strings, T.shorten(c), T.topic(c), T.instruction(c))
    assert got[0][0] == "a" * 120 and got[1][0] == ("b" * 121 + ". x")[:117] + "..."
    assert got[1][1] == "b" * 117 + "..." and got[2][1] == V.DEFAULT_TOPIC and got[3][1] == "One" and got[4][1] == V.DEFAULT_TOPIC
    heads = [V.Names().fill(t) for t in V.INSTRUCTIONS]
    assert [g[2] for g in got] == [heads[len(s) % 3] + g[1] for s, g in zip(strings, got)]


def test_questions(spark):
    c = F.col("s")
    got = apply(spark, ["What is the rule here?", "Short?", "No mark at all in here"], T.accept_question(c, F.lit("x" * 90)))
    made = V.Names().fill(V.FALLBACK_QUESTION) + "x" * 80 + "..."
    assert [g[0] for g in got] == ["What is the rule here?", made, made]


def test_marks(spark):
    c = F.col("s")
    got = apply(spark, ["25% of, 30%x, £3,000.50, 12 percent", "see paragraph 17a & Table 3 <b>\n", "", None], T.figures(c), T.citations(c), T.render_html(c))
    assert got[0][0] == ["30%", "£3,000.50", "12 percent"]
    assert got[1][1] == ["paragraph 17a", "Table 3"]
    assert got[1][2] == 'see <span class="citation">paragraph 17a</span> &amp; <span class="citation">Table 3</span> &lt;b&gt;<br>'
    assert got[2][2] == got[3][2] == V.NO_RESPONSE


def test_steps_and_scores(spark):
    got = spark.range(1).select(T.train_steps(F.lit(80)), T.train_steps(F.lit(7)), T.render_score(F.lit(0.47131))).first()
    assert tuple(got) == (80, 7, "0.4713")


def test_fixed_values_and_names(spark):
    """The constants written out here, so that a wrong one doesn't pass by being wrong on both sides."""
    assert V.SECTION_WIDE == r"\b((?:1[7-9]|2[0-9]|3[0-6]|4[9]|5[0-9]|6[0-9]|7[0-9]|8[0-9]|9[0-5])\d{3})\b"
    assert [bool(re.search(V.SECTION_WIDE, s)) for s in ("17000", "16999", "36999", "37000", "49000", "48999", "95999", "96000", "x17000", "170001")] == [True, False] * 4 + [False, False]
    assert [bool(re.search(V.SECTION_NARROW, s)) for s in ("17000", "36999", "37000", "49000", "50000", "51000", "95000", "94000")] == [True, True, False, True, True, False, True, False]
    assert re.findall(V.CITATION, "Paragraph 17a, para 3; CHAPTER 25 Table 1b") == ["Paragraph 17a", "para 3", "CHAPTER 25", "Table 1"]
    assert re.findall(V.FIGURE, "25%x 25% of 12 percent £3,000.50") == ["25%", "12 percent", "£3,000.50"]
    assert len(V.STOP_WORDS) == 25 and {"how", "regarding", "treated"} <= set(V.STOP_WORDS)
    names = V.Names("the office", "the body", "the book")
    rows = [("a" * n + ".",) for n in (5, 3, 4)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.instruction(F.col("t"), names)).collect()]
    assert got == ["What is the the body policy regarding: aaaaa", "Explain the the book rules for: aaa", "Detail the official the body guidelines on: aaaa"]
    asked = spark.createDataFrame([("no", "x" * 90)], "q string, s string").select(T.accept_question(F.col("q"), F.col("s"), names)).first()[0]
    assert asked == "What is the the office policy regarding the section: " + "x" * 80 + "..."


def test_first_sentence(spark):
    texts = ["A b. C", " . .\u3000. x\ny .z", "...", "", None, "no stop", "\x85lead. x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(T.first_sentence(F.col("t")), F.coalesce(F.try_element_at(T.sentences(F.col("t")), F.lit(1)), F.when(F.col("t").isNotNull(), ""))).collect()
    assert [r[0] for r in both] == [r[1] for r in both] == ["A b", "x\ny", "", "", None, "no stop", "lead"]
