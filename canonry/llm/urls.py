"""URL filters: explicit rules first, and trust propagated over the host graph for the rest.

Hosts are linked by what their pages refer to and by being parts of one another: a page's absolute links, and the step
from a host to the host one label up, whose owner answers for it. Trust is a personalised PageRank from the hosts of
pages that the rules allow; distrust runs from the hosts of blocked pages over reversed links, since who refers to a
bad host is suspect. All of it is DataFrame code; each step is one join and one sum.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, rule); the longest that fits a url decides.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, CHECKPOINT_EVERY = 0.85, 4
#: Edges that a partition of the propagation holds: host graphs are small beside their pages, and each step is a shuffle.
EDGES_IN_PART = 200_000
#: Propagation ends when so many steps as lie between checkpoints move less mass than this, of 1 for each kind.
TOLERANCE = 1e-6
#: A host is blocked if its distrust, as a share of all, is over so many times its trust.
RATIO = 1.0
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or end, A-Z lower-cased; without "://" empty."""
    return common.lower_ascii(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the host's end up to "?", "#" or end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does. Of equal rules the first counts."""
    rule = verdict = None
    for judged, text in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, judged) if verdict is None else verdict.when(fits, judged)
    return (rule, verdict) if rules else (F.lit(None).cast("string"),) * 2


def links_of(html: Column) -> Column:
    """Absolute links of a page, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), 1)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight over distinct hosts. pages: host, links."""
    links = pages.where("host <> ''").select("host", F.explode("links").alias("url"))
    named = links.select(F.col("host").alias("src"), host_of(F.when(F.col("url").startswith("//"), F.concat(F.lit("http:"), "url")).otherwise(F.col("url"))).alias("dst"))
    linked = named.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = linked.select(F.col("src").alias("h")).union(linked.select("dst")).union(pages.select("host")).where("h <> ''").distinct()
    # each host and those it is part of, down to two labels; a host of n labels gives n - 2 steps
    labels = F.split("h", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("src"), F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("dst")))
    family = hosts.where(F.size(labels) > 2).select(F.explode(chain).alias("e")).select("e.src", "e.dst").distinct()
    both = family.union(family.select("dst", "src")).select("src", "dst", F.lit(1.0).alias("weight"))
    return linked.unionByName(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """kind, host, mass: personalised PageRank, converged. edges: kind, src, dst, weight; seeds: kind, host, seed, those of
    each kind summing to 1. Kinds are apart, and go through the same steps.

    From the seeds on, ranks only grow, so the change of their sum is the mass that moved. What reaches a host without
    links out goes back to the seeds: as the equation is linear, that is the solution without it, scaled to a sum of 1.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    parts = 1 + edges.count() // EDGES_IN_PART
    shares = common.small(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (damping * F.col("weight") / F.col("total")).alias("share")).coalesce(parts))
    start = common.cut(seeds.select("kind", "host", ((1 - damping) * F.col("seed")).alias("mass")).coalesce(parts))
    ranks, before = start, 0.0
    while True:
        whole = ranks.agg(F.coalesce(F.sum("mass"), F.lit(0.0)).alias("mass")).first()["mass"]
        if whole - before < tolerance:
            break
        before = whole
        for _ in range(CHECKPOINT_EVERY):
            moved = ranks.join(shares, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("mass") * F.col("share")).alias("mass"))
            ranks = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("mass").alias("mass")).coalesce(parts)
        ranks = common.cut(ranks)
    sums = {r["kind"]: r["mass"] for r in ranks.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}  # a row for each kind
    scale = F.lit(1.0)
    for kind, mass in sums.items():
        scale = F.when(F.col("kind") == kind, F.lit(float(mass))).otherwise(scale)
    return ranks.select("kind", "host", (F.col("mass") / scale).alias("mass"))


def seed_table(judged: DataFrame, verdict: str) -> DataFrame:
    """host, seed: each host's share of the pages with that verdict."""
    counts = judged.where(F.col("_verdict") == verdict).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    counts = common.cut(counts)
    total = counts.agg(F.sum("n").alias("total")).first()["total"] or 1
    return counts.select("host", (F.col("n") / F.lit(total)).alias("seed"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: float = DAMPING, ratio: float = RATIO, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, with the host's trust and distrust.

    A url that is null or has no "://" has an empty host and path, and no rule. Hosts that neither trust nor distrust
    reaches are allowed, so are empty ones, and those where both are equal. Very long pages are read whole. Repeated rows
    and null ids are each judged; an empty table gives an empty result; extra columns are left out.
    """
    url = F.coalesce("url", F.lit(""))
    read = common.cut(common.documents_only(pages, "page_id", "url", "html").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), links_of(F.col("html")).alias("links")))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    slim = read.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_verdict"))
    edges = common.cut(host_edges(read))
    kinds = edges.withColumn("kind", F.lit("trust")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("kind")))
    seeds = seed_table(slim, "allow").withColumn("kind", F.lit("trust")).unionByName(seed_table(slim, "block").withColumn("kind", F.lit("distrust")))
    mass_of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)).alias(kind)
    hosts = common.small(propagate(kinds, seeds, damping, tolerance).groupBy("host").agg(mass_of("trust"), mass_of("distrust")).withColumnRenamed("host", "_host"))
    known = slim.join(hosts, F.col("host") == F.col("_host"), "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    by_graph = F.when(distrust > ratio * trust, "block").otherwise("allow")
    return known.select("page_id", "host", "path", "rule", F.coalesce("_verdict", by_graph).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(common.read_table(spark, sf_dir, "pages"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_url_filters that the urls alone decide, which SQL can check."""
    judged = op4_url_filters(spark, sf_dir)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


QUERIES = {"op4_url_filters": op4_url_filters, "url_rules": url_rules}

ORACLE_SQL = {
    "url_rules": r"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, rule, name, start) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS ruled FROM (SELECT DISTINCT host, path FROM parts) p JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY ALL)
SELECT page_id, host, path, rule, ruled FROM parts LEFT JOIN best USING (host, path)"""
}
