"""URL verdicts from rules and from trust that travels along links (DataFrame functions only).

Rules decide the URLs they fit. For the others, two personalised PageRanks run over the edges between hosts: trust
starts at hosts with allowed pages and follows links; distrust starts at hosts with blocked pages and runs against
them, as who links to bad hosts is suspect. Both are compared per host.

Edges are absolute links from a page to another host, and both ways between a host and the one it is a subdomain of
(where that still has three labels, so that whole registries don't become hubs).

Ranks are held to a number of significant bits and steps go on until no host's rank grows by more than a share of itself,
so results don't depend on how many hosts share the ranks' sum or on how far a host lies from the seeds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, named, salted_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A tag ends at its > or where the next one begins, so the search is linear in the page.
LINK = r"""(?i)<a(?=\s)[^<>]*?\shref\s*=\s*["']?((?:[a-z][a-z0-9+.-]{0,20}:)?//[^\s"'<>/?#]+)"""
#: Significant bits of a rank: sums of the same parts in any order agree in them.
BITS = 40


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query: the longest that fits decides.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and for URLs without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty like the host."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(name, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, html: str) -> DataFrame:
    """(src, dst, n): how often pages of one host refer to another, counted before any shuffle of pages."""
    found = pages.select(F.col("__host").alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("to"))
    linked = found.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit(":"), F.col("to"))).otherwise(F.col("to"))).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    linked = cut(linked)  # the pages' html is searched once
    hosts = pages.select(F.col("__host").alias("src")).union(linked.select("dst")).distinct()
    parts = F.split("src", r"\.")
    parent = F.when(F.size(parts) > 3, F.concat_ws(".", F.slice(parts, 2, F.size(parts) - 1)))
    kin = hosts.select("src", parent.alias("dst")).where("dst is not null")
    both = kin.select("src", "dst", F.lit(1).alias("n")).union(kin.select("dst", "src", F.lit(1).alias("n")))
    return linked.union(both).where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def significant(x: Column) -> Column:
    """A positive number rounded to BITS significant bits; 0 stays 0."""
    unit = F.pow(F.lit(2.0), F.floor(F.log2(x)) - BITS)
    return F.when(x > 0, F.floor(x / unit + 0.5) * unit).otherwise(F.lit(0.0))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 0.005) -> DataFrame:
    """(kind, host, rank) by personalised PageRank of each kind, over edges (kind, src, dst, n) from seeds (kind, host, weight).

    A walk from the seeds goes on with probability ``damping``; the rank of a host is its share of all visits, so what hosts
    without outgoing edges hold goes back to the seeds. Visits of one more step are added until they are at most
    ``tolerance`` of any host's visits so far (a host met for the first time has all of them in that step). Parts are
    summed before they are shuffled, and the join on the source can be split, so a host with very many links never gathers
    in one task.
    """
    totals = edges.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = cut(edges.join(totals, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("share")))
    sums = seeds.groupBy("kind").agg(F.sum("weight").alias("all"))
    start = F.col("weight") / F.col("all")
    state = cut(seeds.join(F.broadcast(sums), "kind").select("kind", "host", start.alias("visits"), start.alias("last")))
    while True:
        figures = state.agg(F.count("*").alias("n"), F.max(F.col("last") / F.col("visits")).alias("growth")).first()
        if not figures.n or figures.growth <= tolerance:
            break
        moved = state.where("last > 0").join(shares, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("last") * F.col("share") * damping).alias("part"))
        both = state.select("kind", "host", "visits", F.lit(0.0).alias("last")).union(moved.select("kind", "host", "part", "part"))
        state = cut(both.groupBy("kind", "host").agg(significant(F.sum("visits")).alias("visits"), significant(F.sum("last")).alias("last")), 2 * figures.n + 50_000)
    whole = state.groupBy("kind").agg(F.sum("visits").alias("all"))  # a row for each kind
    return state.join(F.broadcast(whole), "kind").select("kind", "host", (F.col("visits") / F.col("all")).alias("rank"))


def verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", html: str = "html", key: str = "page_id", ratio: float = 1.0, otherwise: str = "allow", damping: float = 0.85, tolerance: float = 0.005) -> DataFrame:
    """Per row of ``pages``: key, host, path, rule, verdict, and the host's trust and distrust.

    Where no rule fits, a host is blocked if its distrust exceeds ``ratio`` times its trust; a host that neither
    reaches gets ``otherwise``. Null URLs and those without :// have empty host and path and get ``otherwise``. Null
    html has no links. Repeated rows give a row each; an empty table gives none. Extra columns are not read.
    """
    read = pages.select(named(key).alias("__key"), host_of(named(url)).alias("__host"), path_of(named(url)).alias("__path"), named(html).alias("__html"))
    ruled = read.withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules))
    edges = cut(host_edges(ruled, "__html"))
    seeds = ruled.where("__rule is not null and __host != ''").groupBy(F.when(F.col("__rule.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), F.col("__host").alias("host")).agg(F.count("*").alias("weight"))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    rank = propagated(both, seeds, damping, tolerance)
    hosts = rank.groupBy(F.col("host").alias("__host")).agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))
    judged = salted_join(ruled.drop("__html"), cut(hosts), "__host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    own = F.when((trust == 0) & (distrust == 0), F.lit(otherwise)).when(distrust > ratio * trust, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("__key").alias(key), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.name").alias("rule"), F.coalesce("__rule.verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
