"""ROUGE-L against the plain table of the longest common subsequence."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import rouge


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


lists = st.lists(st.sampled_from("abcd"), max_size=90)


@settings(max_examples=300, deadline=None)
@given(lists, lists)
def test_bits_equal_the_table(a, b):
    n = table(a, b)
    assert rouge.lcs_length(a, b) == n
    places = sorted(rouge.lcs_places(a, b))
    assert len(places) == n
    rest = iter(b)
    assert all(any(x == y for y in rest) for x in (a[i] for i in places))  # it is a subsequence of b


def test_all_benchmark_pairs(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    pairs = items.select("item_id", F_col("text", "reference")).crossJoin(items.limit(10).select(F_col("text", "candidate")))
    from tessera.functions import text as T

    words = pairs.select("*", T.words(pairs["reference"]).alias("a"), T.words(pairs["candidate"]).alias("b"))
    rows = rouge.rouge_l(words).collect()
    assert len(rows) == 10 * items.count()
    for r in rows:
        n = table(r["a"], r["b"])
        assert r["lcs"] == n
        if n:
            p, q = n / len(r["b"]), n / len(r["a"])
            assert (r["precision"], r["recall"]) == (p, q) and r["f"] == pytest.approx(2 * p * q / (p + q))


def F_col(name, alias):
    from pyspark.sql import functions as F

    return F.col(name).alias(alias)


def test_summary_level_unites_sentences(spark):
    # the classic example: the union of w1 w2 and w1 w3 w5 covers four of five words
    rows = [("w1 w2 w3 w4 w5", "w1 w2 w6 w7 w8. w1 w3 w8 w9 w5"), ("a b. c d", "c d\na b"), ("a a b", "a. a"), (None, "a"), ("", ""), ("a", "b")]
    got = [(r["lcs"], round(r["precision"], 4), round(r["recall"], 4)) for r in rouge.rouge_l(spark.createDataFrame(rows, "reference string, candidate string"), summary=True).collect()]
    assert got == [(4, 0.4, 0.8), (4, 1.0, 1.0), (1, 0.5, 0.3333), (0, 0.0, 0.0), (0, 0.0, 0.0), (0, 0.0, 0.0)]


def test_names_and_lengths(spark):
    df = spark.createDataFrame([("x " * 30_000, "y x " * 10_000, 5, 7.0)], "reference string, candidate string, r_words int, f double")
    got = rouge.rouge_l(df, beta=2.0)
    assert got.columns == ["reference", "candidate", "r_words", "lcs", "precision", "recall", "f"]
    r = got.first()
    assert (r["lcs"], r["r_words"], r["precision"]) == (10_000, 5, 0.5) and r["f"] == pytest.approx(5 * 0.5 / 3 / (1 / 3 + 4 * 0.5))
    assert rouge.rouge_l(df.limit(0)).count() == 0
