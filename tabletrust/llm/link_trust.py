"""URL filters: rules per host and path, and trust that spreads over links between hosts.

Hosts with pages that a rule allows are trusted seeds; hosts with pages that a rule blocks are
blocked seeds. Trust spreads along links by personalised PageRank. Distrust spreads against them: a
host that links to blocked hosts takes some of their distrust. Both run in one loop over one table
of host edges. A host is blocked if its distrust exceeds its trust and is not small for a host of
its number of pages.

An edge is an absolute link in a page to another host, weighted by the number of links, or ties a
host to each of its parent domains of two labels or more, both ways, with weight one.

Defined results: a null url, or one without `://`, has an empty host and an empty path; an empty
host gets no edges and the verdict allow. A host without evidence is allowed; so are ties. Without
seeds all scores are zero. Null html has no links. Repeated pages count as often as they occur.
Extra columns are ignored. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.text import ascii_lower
from tabletrust.operators.skew import join_by_key
from tabletrust.session import materialize

DAMPING = 0.85
ROUNDS = 12
#: Lineage is cut by a written table after so many rounds.
ROUNDS_PER_TABLE = 4
#: A host is blocked when its distrust exceeds its trust, and this part of its share of all pages.
LEAST_DENSITY = 0.5

_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule that fits, as a struct of name and verdict; null if none does."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")),
        )
        for r in ranked
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<name:string,verdict:string>")


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, and the rule that fits."""
    parts = pages.select("page_id", url_host("url").alias("host"), url_path("url").alias("path"))
    return parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts, links and parent domains."""
    links = (
        pages.select(
            url_host("url").alias("src"),
            F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("to"),
        )
        .select("src", ascii_lower(F.col("to")).alias("dst"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    known = links.select(F.explode(F.array("src", "dst")).alias("host")).union(
        pages.select(url_host("url").alias("host"))
    )
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(2), F.size(labels) - 1),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    up = (
        known.distinct()
        .where(F.size(labels) > 2)
        .select("host", F.explode(parents).alias("parent"))
        .where("parent <> ''")
    )
    ties = up.select(
        F.explode(
            F.array(
                F.struct(F.col("host").alias("src"), F.col("parent").alias("dst")),
                F.struct(F.col("parent").alias("src"), F.col("host").alias("dst")),
            )
        ).alias("e"),
    ).select("e.src", "e.dst", F.lit(1.0).alias("weight"))
    return (
        links.unionByName(ties)
        .where("src <> dst and src <> '' and dst <> ''")
        .groupBy("src", "dst")
        .agg(F.sum("weight").alias("weight"))
    )


def spread(
    seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS
) -> DataFrame:
    """(host, trust, distrust) after `rounds` rounds; `seeds` holds (kind, host, seed) summing to 1 each.

    Trust runs along the edges and distrust against them, so the edges of the second kind are turned
    round once. Each round is a join on the host and a sum that is combined inside the tasks.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(
        edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("weight"))
    )
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    shares = materialize(
        both.join(out, ["kind", "src"]).select(
            "kind", F.col("src").alias("host"), "dst",
            (F.col("weight") / F.col("out") * damping).alias("share"),
        ),
        "host-shares",
    )
    seeds = materialize(seeds, "host-seeds")
    restart = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    scores = seeds.select("kind", "host", F.col("seed").alias("score"))
    for k in range(rounds):
        moved = scores.join(shares, ["kind", "host"]).select(
            "kind", F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("score")
        )
        scores = moved.unionByName(restart)
        scores = scores.groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (k + 1) % ROUNDS_PER_TABLE == 0 and k + 1 < rounds:
            scores = materialize(scores, "host-scores")
    one = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    return scores.groupBy("host").agg(
        one("trust").alias("trust"), one("distrust").alias("distrust")
    )


def seeds_of(judged_pages: DataFrame) -> DataFrame:
    """(kind, host, seed): each kind's pages per host, divided by all its pages."""
    kind = F.when(F.col("rule.verdict") == "allow", "trust").otherwise("distrust")
    counts = (
        judged_pages.where(F.col("rule").isNotNull() & (F.col("host") != ""))
        .groupBy(kind.alias("kind"), "host")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("kind").agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(totals), "kind").select(
        "kind", "host", (F.col("n") / F.col("all")).alias("seed")
    )


def verdicts(
    pages: DataFrame, rules: Sequence[Rule] = RULES, least: float = LEAST_DENSITY
) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, of every page."""
    marked = judged(pages, rules)
    scores = spread(seeds_of(marked), host_edges(pages))
    sizes = marked.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = marked.agg(F.count(F.lit(1)).alias("pages"))
    zero = F.lit(0.0)
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    hosts = materialize(
        sizes.join(scores, "host", "left").select(
            "host", trust.alias("trust"), distrust.alias("distrust"),
            ((distrust > trust) & (distrust > F.col("n") / total.scalar() * least)).alias("bad"),
        ),
        "host-verdicts",
    )
    spreads = F.when(F.col("bad"), "block").otherwise("allow")
    return join_by_key(marked, hosts, "host", "left").select(
        "page_id", "host", "path", F.col("rule.name").alias("rule"),
        F.coalesce("rule.verdict", spreads).alias("verdict"),
        F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"),
    )
