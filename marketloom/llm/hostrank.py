"""URL filters by link-graph propagation, in DataFrame functions only.

Hosts are nodes; an edge is an absolute link from a page of one host to another host, weighted by
its share among the links of its source. Trust spreads from trusted seeds along links (personalised
PageRank); distrust spreads from blocked seeds against the links, to hosts that link to them. Both
are sums over walks, discounted by ``damping`` a step, so a host without links keeps its own seed
value. A host is blocked if its distrust exceeds its trust by ``limit``. Written rules win over the
graph's verdict.

A blocked host's distrust would be divided among its in-links, so of many hosts that link to it each
would get little. With ``surfer`` (what the query uses) distrust is instead the chance that a surfer who follows links of the host
at random, goes on with ``damping`` and stops at pages that a rule judges, stops at a blocked one:
at most 1, and the same however many other hosts link there.

Null urls and urls without ``://`` have an empty host and path and are allowed unless a rule fits.
Null html has no links. Repeated pages count as often as they occur. Of rules of equal length that fit
one page the later in the list wins; such rules are the same text, so only their verdicts can differ.
Other columns than page_id, url and html, whatever their names, are not read. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        on, _, below = text.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` from ``host, html``: absolute and protocol-relative links to other hosts."""
    links = F.regexp_extract_all("html", F.lit(r"""(?is)\b(?:href|src)\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), 1)
    found = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(links).alias("_url"))
    dst = host_of(F.concat(F.lit("x:"), F.regexp_replace("_url", "(?i)^https?:", "")))
    found = found.select("src", dst.alias("dst")).where((F.col("dst") != "") & (F.col("dst") != F.col("src")))
    return found.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, surfer: bool = False) -> DataFrame:
    """``host, trust, distrust`` for hosts that either reaches.

    ``seeds``: host, trusted, blocked (0 to 1). Each round is one join and one sum; state and edges
    are stored, so a lost executor costs no more than a round. Without edges no round is run.
    """
    sides = []
    for kind, a, b in (("trust", "src", "dst"), ("distrust", "dst", "src")):
        among = "src" if surfer else a
        out = edges.groupBy(F.col(among).alias("_from")).agg(F.sum("weight").alias("_all"))
        side = edges.join(out, F.col(among) == F.col("_from"))
        share = F.col("weight") / F.col("_all")
        if surfer and kind == "distrust":
            side = side.join(seeds.select(F.col("host").alias("_host"), (1 - F.col("trusted") - F.col("blocked")).alias("_on")), F.col("src") == F.col("_host"), "left")
            share = share * F.coalesce("_on", F.lit(1.0))
        sides.append(side.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), share.alias("share")))
    links = saved(sides[0].unionByName(sides[1]), "host-links")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trusted", F.lit("distrust"), "blocked")).alias("kind", "seed"))
    start = saved(start.where(F.col("seed") > 0), "host-seeds")
    scores, front = [start.select("kind", "host", F.col("seed").alias("score"))], start.select("kind", "host", F.col("seed").alias("mass"))
    if not links.isEmpty():
        for _ in range(rounds):
            # what walks of one step more carry; the sum over all lengths is the score
            stepped = front.join(links, (front["kind"] == links["kind"]) & (front["host"] == links["a"])).select(front["kind"], F.col("b").alias("host"), (F.col("mass") * F.col("share") * damping).alias("mass"))
            front = saved(stepped.groupBy("kind", "host").agg(F.sum("mass").alias("mass")), "host-mass")
            scores.append(front.select("kind", "host", F.col("mass").alias("score")))
    every = scores[0]
    for more in scores[1:]:
        every = every.unionByName(more)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return every.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], limit: float = 0.8, damping: float = 0.85, rounds: int = 20, surfer: bool = False) -> DataFrame:
    """``page_id, url, html`` to page_id, host, path, rule, verdict, trust and distrust.

    Seeds are the hosts of pages that a rule judges, weighted by the share of the host's pages.
    """
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    at = at.withColumns({"rule": rule, "_verdict": verdict})
    share = lambda what: F.avg(F.when(F.col("_verdict") == what, 1.0).otherwise(0.0))
    seeds = at.where(F.col("host") != "").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    edges = host_edges(pages.select(host_of(F.col("url")).alias("host"), "html"))
    bad = propagate(edges, seeds, damping, rounds, surfer).withColumnRenamed("host", "_host")
    out = at.join(bad, F.col("host") == F.col("_host"), "left")
    graph = F.when(F.coalesce(F.col("distrust") - F.col("trust"), F.lit(0.0)) >= limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", graph).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
