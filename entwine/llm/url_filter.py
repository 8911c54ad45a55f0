"""URL filters with column functions only: host and path rules, and trust propagated over host links.

A rule (verdict, host, path) fits its host and all subdomains if the URL's path starts with the rule's path; of the
rules that fit, the longest written form (host + path) wins. Where no rule fits, the link graph decides: links between
hosts are counted, personalised PageRank runs from the trusted pages along the links and from the blocked pages
against them, and a host is blocked when its distrust exceeds both its trust and a share of what its own pages would
get if all of them were blocked. PageRank runs until all mass that is still under way is less than TOLERANCE of what decides
about a host of one page, so only a verdict that is closer than that to its limit could differ.

Defined cases: a null URL or one without "://" has empty host and path and fits no rule; null html has no links;
links inside a host count nothing; URLs and html of any length are read whole; repeated rows count as pages and give repeated results; ties between rules of
equal length go to the first listed; without links only a host's own rules count; an empty table gives an empty
table; of the input only the key, the URL and the html are read, so other columns cannot clash. Hosts with very many
pages are aggregated to one row before any join, and the last join is one that adaptive execution can split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwine.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host up to / ? # or the end, then path up to ? # or the end
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: absolute links in html, with or without a scheme
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s<>]*)"""
TOLERANCE = 1e-3


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def written(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path of a URL; empty without one."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def first_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = None
    for r in sorted(rules, key=lambda r: -len(r.written)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.struct(F.lit(r.written).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, out) if found is None else found.when(fits, out)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links between different hosts, one row per pair: src, dst, n."""
    linked = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("to"))
    to = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    return linked.select("src", host_of(to).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int | None, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank of `seeds` (host, weight) over `links` (src, dst, n): host, mass. Mass of hosts without links out is not handed on.

    Each round delivers what is left after damping at most, so the mass still under way is known; rounds end when it is below `tolerance`, or after `rounds` where given.
    """
    share = cut(links.join(links.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "links")
    base = cut(seeds.where("weight > 0").select("host", (F.col("weight") * (1 - damping)).alias("mass")), "seeds")
    if share.isEmpty():
        return base
    total = lambda df: df.agg(F.sum("mass")).first()[0] or 0.0
    mass, before, done = base, total(base), 0
    moving = before
    while moving * damping / (1 - damping) >= tolerance and done != rounds:
        moved = share.join(mass, share["src"] == mass["host"]).select(F.col("dst").alias("host"), (F.col("share") * F.col("mass") * damping).alias("mass"))
        mass = cut(base.unionByName(moved).groupBy("host").agg(F.sum("mass").alias("mass")), "mass")
        after = total(mass)
        moving, before, done = after - before, after, done + 1
    return mass


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str = "html", rounds: int | None = None, damping: float = 0.85, share: float = 0.5) -> DataFrame:
    """key, host, path, rule, verdict ('allow' or 'block') for every row of pages."""
    place = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = place.withColumn("_r", first_rule(F.col("host"), F.col("path"), rules)).select(key, "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("by_rule"))
    counts = cut(ruled.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")), "hosts")
    links = cut(host_links(pages, url, html), "host-links")
    least = share * (1 - damping)
    trust = propagate(links, counts.select("host", F.col("allowed").alias("weight")), rounds, damping, TOLERANCE * least)
    distrust = propagate(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), counts.select("host", F.col("blocked").alias("weight")), rounds, damping, TOLERANCE * least)
    bad = (
        counts.join(distrust.withColumnRenamed("mass", "distrust"), "host")
        .join(trust.withColumnRenamed("mass", "trust"), "host", "left")
        .where((F.col("distrust") > F.coalesce("trust", F.lit(0.0))) & (F.col("distrust") > F.col("pages") * least))
        .select(F.col("host").alias("_bad"))
    )
    return ruled.join(bad, F.col("host") == F.col("_bad"), "left").select(key, "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("_bad").isNotNull(), "block").otherwise("allow")).alias("verdict"))
