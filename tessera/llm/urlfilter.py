"""URL filters: path rules, and link-graph propagation for pages without one.

Hosts whose pages an allow rule names are trusted seeds, those that a block rule names are distrusted ones, weighted by pages.
Trust walks the host edges forward as personalised PageRank, distrust walks them backward (a host that links to a
distrusted one is suspect). A host is blocked if its distrust exceeds ``threshold`` times its trust.

A short list of rules is a CASE in the scan's stage. A longer one, or a table of rules, is joined: every host suffix of a page looks up the lengths
of the paths its rules have, and then (suffix, that much of the page's path) is looked up among the rules, so a host with very many rules or pages
makes no pairs of pages and rules.

Everything is DataFrame operations. Links are counted per pair of hosts before they are shuffled; a walk's step is a join and a
sum; ranks are written to the shared folder every few steps. Host verdicts meet the pages in a join that Spark may split for hot hosts.

Defined results: null urls and urls without ``://`` have empty host and path, no rule, and are allowed; null html has no links; repeated rows are judged
each; an empty table gives no rows; of two rules that fit with one length the longer host wins, then the later rule (of a table: a block); a rule without host
never fits, one without path fits all; links inside a host, relative ones and empty hosts are no edges; a host that no walk reaches is allowed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import remove, stage, work_path

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
LINK = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: The longest list that is written out as a CASE.
LISTED = 500


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """verdict, host, path and nth (greater: wins over an equal rule) of a list or table of rules."""
    if isinstance(rules, DataFrame):
        return rules.select("verdict", "host", F.coalesce("path", F.lit("")).alias("path"), (F.col("verdict") == "block").cast("long").alias("nth")).where("host <> ''")
    return spark.createDataFrame([(v, h, p, i) for i, (v, h, p) in enumerate(rules)], "verdict string, host string, path string, nth long").where("host <> ''")


def joined_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, told for the distinct (host, path) that a rule fits."""
    lengths = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = places.where("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix")).join(lengths, "suffix")
    asked = asked.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    asked = asked.select("host", "path", "suffix", F.col("path").substr(F.lit(1), F.col("n")).alias("head"))
    own = rules.select(F.col("host").alias("suffix"), F.col("path").alias("head"), "verdict", "nth")
    order = F.struct((F.length("suffix") + F.length("head")).alias("size"), F.length("suffix").alias("host_size"), "nth")
    best = asked.join(own, ["suffix", "head"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("suffix", "head").alias("rule"), F.col("verdict").alias("told")), order).alias("best"))
    return best.select("host", "path", "best.rule", "best.told")


def ruled_pages(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """page_id, host, path, rule and told (the rule's verdict) of every page."""
    placed = pages.select("page_id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if isinstance(rules, DataFrame) or len(rules) > LISTED:
        found = joined_rules(placed.select("host", "path").distinct(), rule_table(pages.sparkSession, rules))
        return placed.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", "told")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return placed.withColumn("rule", rule).withColumn("told", verdict)


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    links = F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1)), lambda x: x.rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//"))
    found = pages.select(host_of(F.col(url)).alias("src"), F.explode(links).alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    return found.select("src", dst.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, steps: int = 20, keep_every: int = 5) -> DataFrame:
    """(host, trust, distrust) from seeds (host, trust, distrust), each summing to 1 over the seeds; rank at dead ends is lost."""
    spark = edges.sparkSession
    edges = stage(edges, "edges")
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    forward = edges.join(out, "src").select(F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("total")).alias("w"))
    backward = edges.join(into, "dst").select(F.lit(2).alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("total")).alias("w"))
    walk = stage(forward.union(backward), "walk")
    start = stage(
        seeds.select(F.explode(F.array(F.struct(F.lit(1).alias("kind"), "host", F.col("trust").alias("s")), F.struct(F.lit(2).alias("kind"), "host", F.col("distrust").alias("s")))).alias("x"))
        .select("x.*").where("s > 0"), "seeds",
    )
    base = start.select("kind", "host", (F.col("s") * (1 - damping)).alias("r"))
    rank, before = start.select("kind", "host", F.col("s").alias("r")), None
    for i in range(steps if walk.limit(1).count() else 1):  # without edges a step changes nothing after the first
        moved = walk.join(rank.withColumnRenamed("host", "a"), ["kind", "a"]).select("kind", F.col("b").alias("host"), (F.col("r") * F.col("w") * damping).alias("r"))
        rank = base.union(moved).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if i % keep_every == keep_every - 1:
            path = work_path(spark, "rank")
            rank.write.parquet(path)
            rank = spark.read.schema("kind int, host string, r double").parquet(path)
            if before:
                remove(spark, before)
            before = path
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0))
    return rank.groupBy("host").agg(part(1).alias("trust"), part(2).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = 1.0, url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of every page. ``rules``: a list of (verdict, host, path), or a table with these columns."""
    ruled = ruled_pages(pages, rules, url)
    count = lambda v: F.sum((F.col("told") == v).cast("long"))
    named = ruled.where("told IS NOT NULL").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    both = named.agg(F.sum("allowed").alias("all_allowed"), F.sum("blocked").alias("all_blocked"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    seeds = named.join(F.broadcast(both)).select("host", share("allowed", "all_allowed").alias("trust"), share("blocked", "all_blocked").alias("distrust"))  # one row of totals
    ranks = propagate(host_edges(pages, url, html), seeds)
    bad = ranks.where(F.round("distrust", 12) > F.round(F.col("trust") * threshold, 12)).select("host", F.lit(True).alias("bad"))
    return ruled.join(bad, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("told", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict")
    )


def op3_link_trust(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
