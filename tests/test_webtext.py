"""Page text: the tokeniser against the standard library's parser, malformed markup, and the chosen run against all runs."""

import itertools
import re
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import webtext as W


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in W.RAW
        self.out.append(("open", tag))

    def handle_endtag(self, tag):
        self.skip -= tag in W.RAW
        self.out.append(("close", tag))

    def handle_data(self, data):
        if not self.skip:
            if self.out and self.out[-1][0] == "text":
                data = self.out.pop()[1] + data
            self.out.append(("text", data))


def test_pages_equal_the_standard_parser(spark, sf):
    """Tags and texts of every page of the table, in order."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    assert len(pages) > 10
    for page in pages:
        p = Plain()
        p.feed(page)
        p.close()
        ours = [(k, v if k == "text" else n) for k, n, v in W.tokens(page)]
        assert ours == p.out


def test_articles_are_found(spark, sf):
    """Paragraphs of the article stay, navigation, advertisements and footers go."""
    from pyspark.sql import functions as F

    for r in W.page_texts(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("html")), "page_id").collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", r["html"])
        want = [" ".join(b.text.split()) for b in W.blocks(body[1])[1]] if body else []
        assert r["text"].split("\n") == (want or [""]) and r["n_kept"] <= r["n_blocks"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5).map(float), max_size=12))
def test_best_run_of_all(worth):
    a, b = W.best_run(worth)
    assert sum(worth[a:b]) == max([0.0, *(sum(worth[i:j]) for i, j in itertools.combinations(range(len(worth) + 1), 2))])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "</", "p", "a", " href=", '"', "'", "<!--", "-->", "<script>", "</script>", "&amp", "&lt;", "x ", "<p>", "</p", "<![CDATA[", "]]>", "<br/>", "<nav>", "é"]), max_size=40).map("".join))
def test_any_markup_ends(page):
    found = list(W.tokens(page))
    assert all(k in ("text", "open", "close") for k, _, _ in found)
    W.main_text(page)


def test_malformed_markup():
    texts = lambda page: [v for k, _, v in W.tokens(page) if k == "text"]
    assert texts('<a href="x>y">one</a> 1 < 2 &lt;b&gt; &copy; &nosuch;') == ["one", " 1 < 2 <b> © &nosuch;"]
    assert texts("a<!-- <p> --> b<script>var t='</p>';</script>c<style>x") == ["a b", "c"]
    assert texts('<p class="x>open quote') == ["open quote"] and texts("<") == ["<"] and texts("a</ b>c") == ["ac"]
    assert texts("<![CDATA[1 & <2>]]>") == ["1 & <2>"]
    assert W.main_text("<p>one two<p>three <b>fo</b>ur")[2:] == (1, "one two")  # two short blocks: the longest (first) one
    long = "word " * 40
    assert W.main_text(f"<div class='sidebar'>{long}<div>{long}</div></div><div>{long}</div>")[1:3] == (3, 1)
    assert W.main_text(f"<ul><li><a href=x>{long}</a></ul>")[3].split() == long.split()  # nothing else: the longest block
    assert W.main_text(None) == W.main_text("") == W.main_text("<p> </p>") == ("", 0, 0, "")
    assert W.main_text("<nav>only menu</nav>") == ("", 1, 0, "")


def test_linear_time():
    import time

    began = time.perf_counter()
    for page in ('<a b="' * 100_000, "<p '" * 100_000, "<!--" * 100_000, "<" * 300_000, "<script>" * 50_000, "</x " * 100_000):
        W.main_text(page)
    assert time.perf_counter() - began < 20


def test_frame(spark):
    rows = [("k", "<title>T &amp; U</title><p>" + "w " * 20, 1), (None, None, 2)]
    got = [tuple(r) for r in W.page_texts(spark.createDataFrame(rows, "page_id string, html string, text int")).collect()]
    assert got == [("k", "T & U", 1, 1, " ".join(["w"] * 20)), (None, "", 0, 0, "")]
