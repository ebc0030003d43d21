"""URL filters: rules where one fits, link-graph propagation elsewhere.

Every url is judged by the longest rule that fits its host (or a domain above it) and its path.
Hosts without a rule's word on a page get theirs from the host graph: trust is a personalised
PageRank from the pages that rules allow, distrust one over the reversed links from the pages
that rules block, so a host that links to blocked hosts is distrusted. Both are in pages and not
scaled by a total: a host without links has exactly its own pages, whatever other hosts there
are. A host is blocked if its distrust is above ``RATIO`` times its trust by more than ``SLACK``.

The host graph has one row per pair of hosts with the number of links, so a host with a third of
all pages is one node; ranks are summed by destination before they are shuffled. What goes along
a link is rounded to twelve decimals and summed exactly, so ranks do not depend on the order or
the partitioning of rows. Steps are written to the shared folder; the loop ends when all ranks
together move by ``TOLERANCE`` at most, and what is then missing is less than ``SLACK``.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and
is allowed, since nothing speaks against it. Null html has no links. Links of a host to itself
are left out. Repeated rows are judged one by one and count as pages each. If no page is allowed
or none is blocked, that rank is 0 everywhere. Other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, written
from .common import ascii_lower

#: Fixed values: (verdict, rule) of the contract.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING = 0.85
RATIO = 2.0
#: In pages. Steps shrink by DAMPING, so the rest of the series is below TOLERANCE * 0.85 / 0.15.
TOLERANCE = 1e-5
SLACK = 1e-3
#: Exact sums; up to 10^16 pages.
EXACT = "decimal(28,12)"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct of the longest fitting rule and its verdict, nulls where none fits."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        of_host = (host == domain) | host.endswith("." + domain)
        fits = F.when(
            of_host & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(fits)
    return fits


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links): absolute links of each host to other hosts."""
    found = F.regexp_extract_all(
        F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), F.lit(1)
    )
    target = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return (
        pages.select(host_of(F.col(url_col)).alias("src"), found.alias("found"))
        .where("src != '' AND size(found) > 0")
        .select("src", F.explode("found").alias("link"))
        .select("src", host_of(target).alias("dst"))
        .where("dst != '' AND src != dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )


def personalised_rank(
    links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE
) -> DataFrame:
    """(host, rank): personalised PageRank from the seeds (host, weight), in units of their weight.

    The rank of a host is its own weight and ``damping`` times what the hosts that link to it
    send, each in proportion to its ``links`` (src, dst, links); a host without links sends
    nothing. That is PageRank with restart, divided by the share of restarts, and it is linear:
    the ranks of a part of the graph do not depend on any other part. The steps shrink by
    ``damping``, so the loop ends by itself.
    """
    start = written(seeds.groupBy("host").agg(F.sum("weight").cast(EXACT).alias("start")), "rank-seeds")
    out = links.groupBy("src").agg(F.sum("links").alias("out"))
    shares = written(
        links.join(out, "src").select("src", "dst", (F.col("links") / F.col("out") * F.lit(damping)).alias("share")),
        "link-shares",
    )
    ranks = written(start.select("host", F.col("start").alias("rank")), "ranks")
    while True:
        sent = (
            ranks.join(shares, F.col("host") == F.col("src"))
            .select(F.col("dst").alias("host"), (F.col("rank").cast("double") * F.col("share")).cast(EXACT).alias("sent"))
            .groupBy("host")
            .agg(F.sum("sent").cast(EXACT).alias("got"))
        )
        none = F.lit(0).cast(EXACT)
        step = written(
            start.join(sent, "host", "full")
            .join(ranks.select("host", F.col("rank").alias("was")), "host", "full")
            .select(
                "host", (F.coalesce("got", none) + F.coalesce("start", none)).cast(EXACT).alias("rank"),
                F.coalesce("was", none).alias("was"),
            ),
            "ranks",
        )
        moved = step.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        discard(ranks)
        ranks = step
        if (moved or 0) <= tolerance:
            discard(start)
            discard(shares)
            return ranks.select("host", "rank")


def host_scores(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: tuple[tuple[str, str], ...] = RULES
) -> DataFrame:
    """(host, trust, distrust) of every host that either rank reaches."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    seeds = written(
        pages.select(host.alias("host"), path.alias("path"))
        .select("host", ruled(F.col("host"), F.col("path"), rules)["verdict"].alias("verdict"))
        .where("verdict IS NOT NULL")
        .groupBy("host", "verdict")
        .agg(F.count("*").alias("weight")),
        "seeds",
    )
    links = written(host_links(pages, url_col, html_col), "host-links")
    trust = personalised_rank(links, seeds.where("verdict = 'allow'"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = personalised_rank(back, seeds.where("verdict = 'block'"))
    none = F.lit(0).cast(EXACT)
    return trust.withColumnRenamed("rank", "trust").join(
        distrust.withColumnRenamed("rank", "distrust"), "host", "full"
    ).select("host", F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust"))


def judged(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    rules: tuple[tuple[str, str], ...] = RULES, ratio: float = RATIO,
) -> DataFrame:
    """One row per page: id, host, path, the rule if one fits, and the verdict."""
    scores = host_scores(pages, url_col, html_col, rules)
    rows = pages.select(
        F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("path")
    ).withColumn("_r", ruled(F.col("_host"), F.col("path"), rules))
    none = F.lit(0).cast(EXACT)
    excess = F.coalesce("distrust", none).cast("double") - F.coalesce("trust", none).cast("double") * F.lit(ratio)
    by_links = F.when(excess > SLACK, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(scores, F.col("_host") == F.col("host"), "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), "path",
        F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", by_links).alias("verdict"),
    )
