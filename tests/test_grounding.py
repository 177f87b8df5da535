"""Token matching against plain loops; citations and numbers against planted ones."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import citations as C
from tessera.operators import grounding as G
from tessera.operators import token_match as M


def test_token_scores_equal_plain_loops(spark):
    rng = np.random.default_rng(3)
    vec = {w: rng.normal(size=5) for w in "abcdefgh"}
    texts = [("".join(rng.choice(list("abcdefgh"), size=rng.integers(1, 12))), "".join(rng.choice(list("abcdefgh"), size=rng.integers(1, 12)))) for _ in range(30)]
    rows = [(i, list(r), list(c)) for i, (r, c) in enumerate(texts)] + [(98, [], ["a"]), (99, None, ["a"])]
    df = spark.createDataFrame(rows, "pair_id long, r array<string>, c array<string>")
    w = M.document_frequencies(df.select("pair_id", F.col("r").alias("tokens")).where("r IS NOT NULL"))
    wr = M.weighted(df.select("pair_id", F.col("r").alias("tokens")), w).withColumnRenamed("weights", "reference_weights")
    wc = M.weighted(df.select("pair_id", F.col("c").alias("tokens")), w).withColumnRenamed("weights", "candidate_weights")
    look = F.create_map(*[x for k, v in vec.items() for x in (F.lit(k), F.array(*map(F.lit, map(float, v))))])
    pairs = df.select("pair_id", F.transform("r", lambda x: look[x]).alias("reference"), F.transform("c", lambda x: look[x]).alias("candidate")).join(wr, "pair_id", "left").join(wc, "pair_id", "left")
    got = {r["pair_id"]: tuple(r)[1:] for r in M.token_scores(pairs).collect()}
    refs = [r for _, r, _ in rows if r is not None]
    idf = {t: math.log((len(refs) + 1) / (sum(t in r for r in refs) + 1)) for t in vec}
    unit = {t: v / np.linalg.norm(v) for t, v in vec.items()}
    for i, r, c in rows:
        if not r:
            assert got[i] == (0.0, 0.0, 0.0)
            continue
        rec = sum(idf[t] * max(unit[t] @ unit[u] for u in c) for t in r) / sum(idf[t] for t in r)
        pre = sum(idf[u] * max(unit[t] @ unit[u] for t in r) for u in c) / sum(idf[u] for u in c)
        assert got[i] == pytest.approx((pre, rec, 2 * pre * rec / (pre + rec) if pre + rec > 0 else 0.0))


def test_blocks_give_the_whole_product():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(70, 4)), rng.normal(size=(55, 4))
    one, two = M.best_matches(a, b, block=16)
    assert np.allclose(one, (a @ b.T).max(1)) and np.allclose(two, (a @ b.T).max(0))


def cited(spark, text):
    return [tuple(r) for r in spark.createDataFrame([(text,)], "t string").select(F.explode(C.citations(F.col("t"))).alias("c")).select("c.*").collect()]


def test_citation_grammar(spark):
    assert cited(spark, "See Paragraphs 3 to 5, 7 and 9A; para 12; Reg. 34(1)(b), table 2 & 3, Chapter 4-6.") == [
        ("paragraph", 3, 5, "3"), ("paragraph", 7, 7, "7"), ("paragraph", 9, 9, "9a"), ("paragraph", 12, 12, "12"),
        ("regulation", 34, 34, "34(1)(b)"), ("table", 2, 2, "2"), ("table", 3, 3, "3"), ("chapter", 4, 6, "4"),
    ]
    assert cited(spark, "no paragraph here, 5 tables, paragraphs") == [] and cited(spark, None) == []
    assert cited(spark, "section 9 to 2") == [("section", 9, 9, "9")]


def test_long_numbers_and_addresses_are_no_citations(spark):
    assert cited(spark, "para 97.108.109.124, para 4803325992187775 e para 1234567") == []
    assert cited(spark, "See paragraphs 3 to 5, 97.108.109.124; section 6, 1234567 and para 9.2, table 123456.") == [
        ("paragraph", 3, 5, "3"), ("section", 6, 6, "6"), ("paragraph", 9, 9, "9"), ("table", 123456, 123456, "123456"),
    ]


def test_planted_false_citations(spark):
    known = spark.createDataFrame([("paragraph", 100, 180), ("paragraph", 100, 180), ("table", 1, 3000), ("regulation", 34, 34)], "kind string, first long, last long")
    answers = [(1, "Paragraph 120 and paragraph 900"), (2, "paras 178 to 182, table 2999"), (3, "nothing"), (4, None), (5, "reg 34, regs 34 and 35; table 1 to 3000")]
    given = spark.createDataFrame([(1, "paragraph", 120, 120), (2, "table", 1, 5)], "answer_id long, kind string, first long, last long")
    df = spark.createDataFrame(answers, "answer_id long, answer string")
    got = {r["answer_id"]: (r["n_cited"], r["n_real"], r["n_given"], r["accuracy"]) for r in G.citation_accuracy(df, known, given).collect()}
    assert got == {1: (2, 1, 1, 0.5), 2: (2, 1, 0, 0.5), 3: (0, 0, 0, None), 4: (0, 0, 0, None), 5: (4, 3, 0, 0.75)}
    assert G.citation_accuracy(df.limit(0), known).count() == 0
    assert {r["n_real"] for r in G.citation_accuracy(df, known.limit(0)).collect()} == {0}


def test_gaps_within_wide_ranges_are_found(spark):
    known = spark.createDataFrame([("paragraph", 1, 40), ("paragraph", 61, 100), ("table", 1, 50), ("table", 51, 100), ("section", 1, 999_999)], "kind string, first long, last long")
    answers = [(1, "paragraphs 1 to 100"), (2, "tables 1 to 100"), (3, "tables 1 to 101"), (4, "sections 1 to 999999"), (5, "paras 1 to 40, 61-100 and 2 to 99")]
    given = spark.createDataFrame([(2, "table", 1, 70), (2, "table", 72, 100), (3, "table", 0, 2000)], "answer_id long, kind string, first long, last long")
    df = spark.createDataFrame(answers, "answer_id long, answer string")
    got = {r["answer_id"]: (r["n_cited"], r["n_real"], r["n_given"]) for r in G.citation_accuracy(df, known, given).collect()}
    assert got == {1: (1, 0, 0), 2: (1, 1, 0), 3: (1, 0, 1), 4: (1, 1, 0), 5: (3, 2, 0)}


def test_ranges_equal_sets_of_numbers(spark):
    rng = np.random.default_rng(7)
    spans = []
    for kind in ("paragraph", "table", "chapter"):
        starts = rng.integers(-50, 9000, size=400)
        widths = rng.choice([0, 3, 20, 60, 1024, 3000], p=[0.3, 0.3, 0.2, 0.17, 0.02, 0.01], size=400)
        spans += [(int(rng.integers(1, 6)), kind, int(a), int(a + w)) for a, w in zip(starts, widths)]
    spans += [(1, "table", 20, 10), (1, "table", None, 5), (1, "chapter", 1023, 1023), (1, "chapter", 1024, 2047), (2, "table", 999_000, 10**12), (2, "table", 10**7, 10**8), (3, "chapter", -(10**12), 2)]
    given = spark.createDataFrame(spans, "answer_id long, kind string, first long, last long")
    answers, cites = [], {}
    for i in range(1, 121):
        key = (i - 1) % 5 + 1
        kind, first = str(rng.choice(["paragraph", "table", "chapter"])), int(rng.integers(0, 9000))
        if i % 2:  # from an interval on, so that many are covered
            _, kind, first, _ = spans[int(rng.integers(0, 1200))]
        first, last = max(first, 0), max(first, 0) + int(rng.choice([0, 2, 49, 50, 51, 300, 2000]))
        cites.setdefault(key, []).append((kind, first, last))
    cites[2].append(("table", 999_500, 999_999))
    answers = [(k, "; ".join(f"{kind} {a} to {b}" for kind, a, b in c)) for k, c in cites.items()]
    numbers = lambda key: {(k, n) for i, k, a, b in spans if key in (None, i) and a is not None for n in range(max(a, 0), min(b, 999_999) + 1)}
    every = numbers(None)
    want = {}
    for k, c in cites.items():
        mine = numbers(k)
        real, had = (sum(all((kind, n) in have for n in range(a, b + 1)) for kind, a, b in c) for have in (every, mine))
        want[k] = (len(c), real, had)
    got = {r["answer_id"]: (r["n_cited"], r["n_real"], r["n_given"]) for r in G.citation_accuracy(spark.createDataFrame(answers, "answer_id long, answer string"), given.drop("answer_id"), given).collect()}
    assert got == want and all(0 < r < n for n, r, _ in want.values()) and sum(h for _, _, h in want.values()) > 0


def test_numbers(spark):
    answers = spark.createDataFrame([(1, "£3,000 or 12% of 007, and 12 again"), (2, "none"), (3, "42"), (4, None)], "answer_id long, answer string")
    contexts = spark.createDataFrame([(1, "3000 pounds"), (1, "12%"), (2, "5"), (9, "42")], "answer_id long, context string")
    got = {r["answer_id"]: (r["n_numbers"], r["n_grounded"], r["grounding"], r["hallucinated"]) for r in G.number_grounding(answers, contexts).collect()}
    assert got == {1: (4, 2, 0.5, ["12", "7"]), 2: (0, 0, None, []), 3: (1, 0, 0.0, ["42"]), 4: (0, 0, None, [])}
