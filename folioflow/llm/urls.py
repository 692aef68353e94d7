"""URL rules, and trust and distrust over the link graph of hosts where no rule fits (operator 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, forget, lookup, release, stored

#: (rule, verdict): a host, with all its subdomains, and a path that the url's must start with.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, ITERATIONS = 0.85, 20
#: Distrust received, as a share of the host's own links, at which a host without a rule is blocked; trust must be less.
DISTRUST = 0.01
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of src that link to another host dst, counted before the shuffle as far as they can be."""
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), ascii_lower))
    rows = pages.select("host", F.explode_outer(links).alias("dst")).where("host <> '' AND dst <> '' AND host <> dst")
    return rows.groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, received): DAMPING times the mean level of the hosts that edges (src, dst, n) lead from, weighed by n. A level
    is what a host received, or its weight of 0 to 1 as a seed (host, weight) if that is more: the personalised
    PageRank that a walk from the host back over the edges leaves at the seeds. It depends on what the walk
    can reach, and not on how many seeds or hosts there are elsewhere.
    """
    total = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    steps = stored(edges.join(total, "dst").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "edges")
    base = seeds.groupBy("host").agg(F.max("weight").alias("seed"))
    base = stored(base.join(steps.select(F.col("src").alias("host")).distinct(), "host"), "seeds")
    level, moved = base.select("host", F.col("seed").alias("level")), None
    for turn in range(ITERATIONS):
        before, moved = moved, stored(steps.join(level, F.col("src") == F.col("host")).groupBy("dst").agg((DAMPING * F.sum(F.col("level") * F.col("share"))).alias("received")), "received")
        if before is not None:
            forget(before)
        if turn % 7 == 6:
            release(edges.sparkSession)
        level = base.join(moved, F.col("host") == F.col("dst"), "full").select(F.coalesce("host", "dst").alias("host"), F.greatest(F.coalesce("seed", F.lit(0.0)), F.coalesce("received", F.lit(0.0))).alias("level"))
    return moved.select(F.col("dst").alias("host"), "received")


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as (rule, verdict), or null. Rules are a short list, so each row looks at all of them."""
    fitting = []
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=True):
        of, _, rest = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + rest)
        fitting.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fitting, F.lit(None).cast("struct<rule:string,verdict:string>"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) for every page.

    The longest fitting rule decides. Elsewhere the host's links do: seeds are the hosts with pages that a rule
    allows (or blocks), weighed by the share of their pages; trust flows along links from the allowed, distrust
    against them from the blocked, each as a mean over the receiving host's own links, in or out; a host is
    blocked if it received distrust of DISTRUST or more, and more of it than trust. Null urls, and urls without ://, have an empty host and path, fit no rule and are allowed. Null
    html has no links; repeated rows and null ids keep a result each; no pages give no rows.
    """
    rows = pages.select(F.col("page_id"), F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html"))
    rows = rows.withColumn("best", rule_of(F.col("host"), F.col("path"), rules))
    out = rows.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    edges = stored(host_edges(rows), "links")
    if edges.isEmpty():
        return out.select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    hosts = stored(out.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")), "hosts")
    seeds = lambda c: hosts.where(F.col(c) > 0).select("host", (F.col(c) / F.col("pages")).alias("weight"))
    trust = spread(edges, seeds("allowed"))
    distrust = spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), seeds("blocked"))
    graph = distrust.select("host", F.col("received").alias("distrust")).join(trust.select("host", F.col("received").alias("trust")), "host", "left")
    graph = graph.where((F.col("distrust") >= DISTRUST) & (F.col("distrust") > F.coalesce("trust", F.lit(0.0)))).select("host", F.lit("block").alias("linked"))
    judged = stored(hosts.select("host", "pages").join(graph, "host", "left"), "judged")
    return lookup(out, judged, "host", "pages").select("page_id", "url", "host", "path", "rule", F.coalesce("ruled", "linked", F.lit("allow")).alias("verdict"))
