"""Language id, quality rules, line dedup, decontamination, URL filters."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D
from tessera.llm import langid, linededup, quality, registry, urlfilter
from tests.llm import brute


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    protos = langid.prototypes(docs.where(~langid.held_out()))
    got = langid.classify(docs.where(langid.held_out()), protos).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "der Hund und die Katze", "de", "y"), (3, None, "en", None), (4, "", None, ""), (5, "12 !?", "en", ""), (None, "the dog", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    protos = langid.prototypes(docs.where("doc_id < 3"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.classify(docs, protos).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[None][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert {r["lang_pred"] for r in langid.classify(docs, {}).collect()} == {"und"}
    assert langid.prototypes(docs.limit(0)) == {}
    with pytest.raises(ValueError):
        langid.prototypes(docs, max_langs=1)


def test_language_equals_plain_vectors(spark, sf):
    """Sums of bound letter vectors, letter by letter in plain Python, give the same predictions and scores."""
    import numpy as np

    dim = 256

    def grams(t):
        letters = "".join(c if c.isalpha() else " " for c in t.lower())
        padded = " " + " ".join(letters.split()) + " "
        return [padded[i: i + 3] for i in range(len(padded) - 2)] if letters.strip() else []

    def vector(t):
        out = np.zeros(dim)
        for g, n in Counter(grams(t)).items():
            a, b, c = (langid.letter_vector(0 if x == " " else ord(x), dim).astype(float) for x in g)
            out += n * np.roll(a, 2) * np.roll(b, 1) * c
        return out

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(120)
    docs = docs.union(spark.createDataFrame([(-1, "a", "en"), (-2, " ab ", "de"), (-3, "é!", None), (-4, "1 2", None)], docs.schema)).cache()
    rows = docs.collect()
    sums = {}
    for r in rows:
        if r["lang"]:
            sums[r["lang"]] = sums.get(r["lang"], 0) + vector(r["text"])
    names = sorted(sums)
    p = np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])
    p = p - p.mean(0)
    p = p / np.linalg.norm(p, axis=1, keepdims=True)
    protos = langid.prototypes(docs.where("lang IS NOT NULL"), dim=dim)
    assert list(protos) == names and all(np.allclose(protos[n], sums[n]) for n in names)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.classify(docs, protos, dim=dim).collect()}
    for r in rows:
        v = vector(r["text"])
        if not v.any():
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        cos = p @ v / np.linalg.norm(v)
        name, score = got[r["doc_id"]]
        assert abs(cos[names.index(name)] - cos.max()) < 1e-5 and abs(score - min(1, max(0, cos.max()))) < 1e-5


def test_quality_measures(spark, sf):
    odd = [(-1, None), (-2, ""), (-3, " \n \n"), (-4, "a b c a b c"), (-5, "x\nx\n\nx\n"), (-6, "é | # " * 60), (-7, "w " * 5000)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = dict(map(tuple, docs.collect()))
    got = quality.measure(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        w = brute.words(t)
        count = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if count[g] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if brute.words(line):
                dup += line in seen
                seen.add(line)
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        m = quality.Measures(t)
        assert r["kept"] == (not r["base_failed"] and all(x.keeps(m) for x in quality.METHOD_RULES))


def test_quality_keeps_clean_documents(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.measure(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count() and bad.where("kept").count() <= 0.2 * bad.count()


def test_cascade_order_changes_nothing(spark):
    calls = Counter()

    def rule(name, word):
        def keeps(m):
            calls[name] += 1
            return word not in m.words

        return quality.Rule(name, keeps)

    rules = [rule("rare", b"zz"), rule("common", b"a")]
    texts = ["a b", "zz b", "b", "a zz"] * 50
    for order in (rules, rules[::-1]):
        assert [quality.keeps(order, quality.Measures(t)) for t in texts] == [not {"a", "zz"} & set(t.split()) for t in texts]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    plain = [quality.Rule("rare", lambda m: b"zz" not in m.words), quality.Rule("common", lambda m: b"a" not in m.words)]
    got = quality.quality_filter(docs, rules=plain, sample=20)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [i for i, t in enumerate(texts) if t == "b"]
    assert quality.quality_filter(docs.limit(0), rules=plain).count() == 0


def test_cascade_goes_by_rejections_per_cost():
    # numbers of documents by the rules that reject them: rule 0 rejects 10, rule 1 rejects 60, rule 2 the same 60 and 5 more
    patterns = {0: 30, 0b001: 5, 0b110: 60, 0b100: 5, 0b101: 5}
    own, needs = [1e-6] * 3, [{"a"}, {"b"}, {"b", "c"}]
    cost = {"a": 1e-3, "b": 1e-3, "c": 1e-2}
    assert quality.order_of([0, 1, 2], patterns, own, needs, cost) == [1, 0, 2]  # what rule 1 has rejected counts for no other
    assert quality.order_of([0, 1, 2], patterns, own, needs, cost, made={"c"}) == [2, 0, 1]
    assert quality.order_of([0, 1, 2], patterns, own, needs, {**cost, "a": 1e-5}) == [0, 1, 2]
    assert quality.order_of([0, 1, 2], {0: 5}, [3.0, 1.0, 2.0], [set()] * 3, {}) == [1, 2, 0]  # nothing is rejected: the cheapest first


def test_trial_charges_measures_to_themselves():
    t = quality.trial([("a b c " * 400, "en"), ("# | " * 300, "en")], quality.METHOD_RULES)
    names = [r.name for r in quality.METHOD_RULES]
    assert sum(t.patterns.values()) == 2 and t.needs[names.index("symbols")] == {"words", "n_words", "n_symbols"}
    assert t.cost["words"][0] >= 4 and all(s >= 0 for _, s in t.cost.values()) and t.cost["n_words"][1] < t.cost["words"][1]


def test_stop_words_ask_known_languages_only():
    rule = next(r for r in quality.METHOD_RULES if r.name == "stop_words")
    assert [rule.keeps(quality.Measures("kissa koira talo", lang)) for lang in ("fi", "en", None)] == [True, False, False]


def test_corpus_rules_keep_short_clean_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.quality_filter(docs, rules=quality.CORPUS_RULES).join(labels, "doc_id")
    for good, share in ((1, 0.98), (0, 0.9)):
        all_of = labels.where(f"quality = {good}").count()
        n = kept.where(f"quality = {good}").count()
        assert n >= share * all_of if good else n <= (1 - share) * all_of


def test_corpus_rules_follow_the_length():
    """Rates reject where they are beyond doubt: no rule is switched off by a number of words."""
    keeps = lambda t: quality.keeps(quality.CORPUS_RULES, quality.Measures(t))
    assert not keeps("buy now " * 24) and not keeps("buy now buy now buy now") and not keeps("1234 5678 9012") and not keeps("") and not keeps(" \n")
    assert not keeps(" ".join(f"wort{i}x" for i in "abcdefghijklmnopqrstuvw" * 4))  # 92 words, none a function word
    assert keeps("A short note on the river.") and keeps("hello") and keeps("the old mill by the river was to be sold and then it was not")
    for n in (1, 5, 60, 5000):
        for k in (0, n // 2, n):
            low, high = quality.share_between(k, n)
            assert 0 <= low <= k / n + 1e-12 and k / n - 1e-12 <= high <= 1
    assert quality.share_between(0, 0) == (0.0, 1.0)


LINES = [(1, "a\nb\nc\nd"), (2, "x\na\n\nb \nc\nd\ny"), (3, "q\nq\nq\nq\nq"), (4, None), (5, ""), (6, "a\nb"), (7, "a\nb\nc\nd"), (8, "a\nb\nz\nb\nc\nd")]


def test_line_windows(spark):
    docs = spark.createDataFrame(LINES, "doc_id long, text string").withColumn("later", F.lit("mine"))
    got = {r["doc_id"]: (r["text"], r["later"]) for r in linededup.line_dedup(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "a\nb\nc\nd", 2: "x\n\ny", 3: "q", 4: None, 5: "", 6: "a\nb", 7: "", 8: "a\nb\nz"}
    assert {v[1] for v in got.values()} == {"mine"}
    kept = linededup.line_dedup(docs, drop_emptied=True)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 8]
    twice = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_lines"], r["n_removed"]) for r in linededup.line_digests(twice).collect())
    assert got == [(False, 3, 0), (False, 3, 0), (True, 0, 0), (True, 3, 3)]  # a null doc_id is after all others
    assert linededup.line_digests(docs.limit(0)).count() == 0


def test_line_dedup_with_clashing_columns(spark):
    rows = [(1, "a\nb\nc", "p", 1, "q", 5, 7), (2, "a\nb\nc\nd", "r", 2, "s", 6, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string, later long, __later string, t long, first long")
    got = {r["doc_id"]: tuple(r) for r in linededup.line_dedup(docs).collect()}
    assert got == {1: rows[0], 2: (2, "d", *rows[1][2:])}


def test_rows_that_share_an_id_lose_only_their_own_lines(spark):
    rows = [(None, "a\nb\nc"), (None, "x\ny\nz\na\nb\nc"), (None, "k\nl\nm\nn\no\np"), (5, "q\nr\ns\nt"), (5, "q\nr\ns\nu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["text"] for r in linededup.line_dedup(docs).collect())
    whole = ["a\nb\nc", "x\ny\nz", "k\nl\nm\nn\no\np"]
    assert got in (sorted([*whole, "q\nr\ns\nt", "u"]), sorted([*whole, "t", "q\nr\ns\nu"]))  # the text's hash decides
    assert sorted(r["n_removed"] for r in linededup.line_digests(docs).collect()) == [0, 0, 0, 3, 3]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])


def test_masks_meet_every_case():
    """Every way to replace 3 words of 15 leaves some mask untouched at some place."""
    places = [frozenset(s + i for i, c in enumerate(m) if c == "1") for m in D.MASKS for s in range(D.WINDOW - len(m) + 1)]
    for lost in itertools.combinations(range(D.WINDOW), 3):
        assert any(not p & set(lost) for p in places)


def test_decontamination(spark):
    item = [f"word{i}" for i in range(30)]
    changed = list(item)
    for i in (4, 9, 14, 19, 24):
        changed[i] = "other"
    part = item[5:20]
    broken = [w if i % 3 else "no" for i, w in enumerate(item)]
    noise = [f"noise{i}" for i in range(40)]
    docs = [
        (1, " ".join(noise + item + noise)), (2, ("So, " + ", ".join(changed)).upper()), (3, " ".join(noise + part)), (4, " ".join(broken)), (5, " ".join(noise)),
        (6, None), (7, ""), (8, "short item here only eight words are enough"), (9, " ".join(noise + item[5:16])), (None, " ".join(item)),
    ]
    items = [(1, " ".join(item)), (2, "short item here only eight words are enough"), (3, "too short"), (4, None), (5, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {(1, 1), (2, 1), (3, 1), (8, 2), (None, 1)}
    for block in (1 << 20, 31):
        got = D.overlaps(d, b, block_words=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
        kept = D.clean(d, b, block_words=block)
        assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 7, 9}
    whole = {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_words"]) for r in got}
    assert whole[1, 1] == (40, 30) and whole[3, 1][1] >= 15
    assert D.overlaps(d.limit(0), b).count() == D.overlaps(d, b.limit(0)).count() == 0


def _search(docs, items):
    import numpy as np

    raw = [(t or "").encode() for t in docs]
    found = D.Benchmark(list(enumerate(items)), D.WINDOW, D.SHARE, D.LEAST).search(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return {(d, i): (a, n) for d, i, a, n in found}


@pytest.mark.parametrize("hits,marks", [(1 << 20, 1 << 25), (5, 1 << 25), (5, 10)])
def test_overlaps_equal_all_alignments(spark, sf, monkeypatch, hits, marks):
    """Random texts over few or many words and real ones, with up to three words of a passage replaced, whatever is listed or marked."""
    import random

    monkeypatch.setattr(D, "HITS", hits)
    monkeypatch.setattr(D, "MARKS", marks)
    rng = random.Random(3)
    seen = 0
    for size in (1, 2, 3, 6, 40, 400):
        some = [f"w{i}" for i in range(size)]
        items = [" ".join(rng.choice(some) for _ in range(rng.choice((3, 7, 8, 12, 15, 16, 30)))) for _ in range(6)] + ["", None]
        docs = [" ".join(rng.choice(some) for _ in range(rng.choice((0, 2, 9, 20, 60)))) for _ in range(6)] + [None]
        for k in range(4):
            w = items[k].split()
            for _ in range(k):
                w[rng.randrange(len(w))] = "zz"
            docs.append("a b c " + " ".join(w) + " d e")
        want = brute.overlaps(docs, items, D.WINDOW, D.SHARE, D.LEAST)
        assert _search(docs, items) == want
        seen += len(want)
    assert seen > 50
    real = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").limit(25).collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(8).collect()]
    docs = [*real, *(f"{t[:200]} {i}" for t, i in zip(real, items))]
    want = brute.overlaps(docs, items, D.WINDOW, D.SHARE, D.LEAST)
    assert _search(docs, items) == want and want


def test_one_word_many_times_is_bounded():
    import tracemalloc

    tracemalloc.start()
    got = _search(["same " * 2000], ["same " * 1500, "same " * 1500])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {(0, 0): (0, 2000), (0, 1): (0, 2000)} and most < 200e6


def test_many_blocks_equal_one(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, D.overlaps(docs, items).collect()))
    assert sorted(map(tuple, D.overlaps(docs, items, block_words=400).collect())) == one and one
    bad = {r[0] for r in one}
    want = sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad)
    for words in (1 << 20, 400):
        kept = D.clean(docs, items, block_words=words)
        assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == want


def test_short_items_match_whole(spark):
    docs = [(1, "so: Which Planet is, largest? yes"), (2, "which planet is the largest"), (3, "one"), (4, "a b c d x f g"), (5, "planet is largest"), (6, "z a b c d e f g z"), (7, None)]
    items = [(1, "Which planet is largest?"), (2, "One"), (3, "a b c d e f g"), (4, ""), (5, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in D.overlaps(d, b).collect()}
    assert got == {(1, 1, 1, 4), (3, 2, 0, 1), (6, 3, 1, 7)}
    assert sorted(r["doc_id"] for r in D.clean(d, b).collect()) == [2, 4, 5, 7]


def test_url_rules_and_propagation(spark):
    rows = [
        (1, "HTTP://A.example.COM:80/en/7x?q", '<a href="http://bad.org/x">'), (2, None, None), (3, "no url", "x"), (4, "x://b.net/de/8", ""), (5, "http://a.example.net/de/81", ""),
        (6, "http://bad.org/es/", "<a href=//c.io/>"), (7, "http://z.io", '<a HREF="http://bad.org"><a href="/own">'), (8, "http://z.io?x/en/", ""), (9, "http://com/en/", ""),
        (10, "http://b.net/fr/", '<a href="http://good.io/">'), (11, "http://good.io/x#/en/", ""), (12, "http://c.io/", ""), (None, "http://example.com/en/71", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(7))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages).collect()}
    assert got == {
        1: ("a.example.com:80", "/en/7x", None, "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("b.net", "/de/8", "net/de/", "allow"),
        5: ("a.example.net", "/de/81", "example.net/de/8", "block"), 6: ("bad.org", "/es/", "org/es/", "block"), 7: ("z.io", "", None, "block"), 8: ("z.io", "", None, "block"),
        9: ("com", "/en/", "com/en/", "block"), 10: ("b.net", "/fr/", None, "allow"), 11: ("good.io", "/x", None, "allow"), 12: ("c.io", "/", None, "allow"),
        None: ("example.com", "/en/71", "example.com/en/7", "allow"),
    }
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_rules_table_equals_list(spark, sf):
    """Lists written out as a CASE, long lists and tables of rules say the same; no rule is left out however many there are."""
    import random

    rng = random.Random(9)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "org:80", "A.com", "c"]
    urls = [f"http://{rng.choice(['', 'www.', 'b.'])}{rng.choice(hosts)}/{'/'.join(rng.choice('xyz') * rng.randint(0, 2) for _ in range(rng.randint(0, 3)))}" for _ in range(300)] + [None, "", "no", "http:///x", "://"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rules = [(rng.choice(["allow", "block"]), h.lower(), p) for h in hosts if h != "A.com" for p in ("", "/", "/x", "/xx/", "/y", "/x/y")]
    listed = sorted(map(tuple, urlfilter.ruled_pages(pages, rules).collect()))
    table = spark.createDataFrame([*rules, ("block", None, "/"), ("allow", "", None)], "verdict string, host string, path string")
    assert sorted(map(tuple, urlfilter.ruled_pages(pages, table).collect())) == listed
    more = rules + [("block", f"h{i}.example", "/") for i in range(600)]
    assert sorted(map(tuple, urlfilter.ruled_pages(pages, more).collect())) == listed
    assert {r[3] for r in listed} >= {"com/", "a.com/x", None}
    real = spark.read.parquet(f"{sf}/pages.parquet")
    own = spark.createDataFrame(list(urlfilter.RULES), "verdict string, host string, path string")
    assert sorted(map(tuple, urlfilter.judge(real, own).collect()), key=repr) == sorted(map(tuple, urlfilter.judge(real).collect()), key=repr)


def test_ranks_equal_dense_iteration(spark):
    import numpy as np

    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 3), ("c", "a", 1), ("d", "c", 5)]
    seeds = {"a": (1.0, 0.0), "c": (0.0, 1.0)}
    e = spark.createDataFrame(edges, "src string, dst string, n long")
    s = spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urlfilter.propagate(e, s, steps=12).collect()}
    names = "abcd"
    m = np.zeros((4, 4))
    for x, y, n in edges:
        m[names.index(x), names.index(y)] = n
    for k, walk in ((0, m), (1, m.T)):
        w = np.divide(walk, walk.sum(1, keepdims=True), out=np.zeros((4, 4)), where=walk.sum(1, keepdims=True) > 0)
        start = np.array([seeds.get(h, (0, 0))[k] for h in names])
        r = start
        for _ in range(12):
            r = 0.15 * start + 0.85 * r @ w
        assert np.allclose([got.get(h, (0, 0))[k] for h in names], r)


def test_link_query_equals_sql_on_linked_pages(spark, tmp_path):
    """The tables have no links between hosts, so the SQL is also asked of pages that have: trust and distrust decide some verdicts."""
    import random

    import duckdb

    rng = random.Random(11)
    hosts = [f"h{i}.{t}" for i in range(9) for t in ("io", "example.com", "example.net", "org")]
    rows = []
    for i in range(400):
        host = rng.choice(hosts)
        path = rng.choice(["", "/", "/en/7", "/de/81", "/es/1", "/fr/x?q=1", "/en/9#a"])
        links = "".join(f"<a href=\"{rng.choice(['http', 'https'])}://{rng.choice(hosts[:12] if rng.random() < 0.5 else hosts)}/p\">x</a>" for _ in range(rng.randrange(5)))
        rows.append((i, f"http://{host}{path}", f"<p>{links}</p>"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["op3_link_trust"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    cur = con.execute(registry.ORACLES["op3_link_trust"])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(r[names.index(c)] for c in got.columns) for r in cur.fetchall())
    assert sorted(map(tuple, got.collect())) == want and len(want) == 400
    plain = {r[-1] for r in want if r[got.columns.index("rule")] is None}
    assert plain == {"allow", "block"}  # by the links, without a rule


def test_remembered_windows_are_looked_up_together(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tessera.llm import toxicity as X
    from tessera.llm.common import text_bytes

    for words, n in ((1, 5), (2, 4)):
        d = X.Differences(b" awful nasty", b" lovely sunny", b" the", words)
        data, offs = text_bytes(pa.array(["awful Sunny day", "", "awful sunny awful sunny day", "x" * 100 if words == 1 else "day sunny awful"]))
        first, asked, of = d.histograms(data, offs), [], d.of
        monkeypatch.setattr(d, "of", lambda w: asked.append(w) or of(w))
        assert (d.histograms(data, offs) == first).all() and not asked and len(d.cache) >= n
        assert first[:, : X.BINS].sum(1).tolist() == ([3, 0, 5, 2] if words == 1 else [2, 0, 3, 2])
        assert all(d.cache[w] == of(w) for w in list(d.cache)) and np.array(list(d.cache.values())).shape[1] == len(X.LEVELS)
