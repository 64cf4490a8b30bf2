"""URL filter by trust and distrust that spread over the host link graph.

Trust starts at trusted hosts and follows links; distrust starts at blocked hosts and follows links
backwards, for a host answers for what it links to.  Both are personalised PageRank with a fixed number
of rounds; mass at a host without out-links is lost.  Every seed restarts with a mass of 1, whatever their
number, so scores and MIN_DISTRUST mean the same on a graph of any size.  A page is kept unless its host is
a blocked seed or its distrust is at least MIN_DISTRUST and above its trust.

Defined results: pages whose url is null or has no host get a null host, zero scores and are kept; links
within a host are no edges; several links from one host to another weigh once a linking page and target
page; seeds that are no host of the graph take no mass; a repeated page row repeats in the result and its
links count again; with no seeds all scores are 0; an empty table gives an empty result; null html has no links;
pages of any length are read whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.collections import numbered
from loam.functions.let import let
from loam.runtime import materialise, release, small_side

ROUNDS, DAMPING, MIN_DISTRUST = 20, 0.85, 0.01
#: Production seeds: patterns of SQL LIKE over hosts.
TRUSTED, BLOCKED = ["%.example.org", "www.%"], ["blog.%.example.net", "m.%.example.com"]

_HOST = "^(?i:https?:)?//(?:[^/?#@]*@)?([^/?#:@\\[\\]]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of an http(s) or scheme-less // url, else null."""
    # the pattern is anchored, so there is one match at most; with a test for '' it would be searched twice
    return F.lower(F.get(F.regexp_extract_all(url, F.lit(_HOST), 1), F.lit(0)))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w: how many links of src's pages lead to dst, another host; a page's repeated link counts once."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?((?:https?:)?//[^\"'\\s>]+)"), 1))
    # hosts are compared inside the array: a filter over rows is pushed below, and each pattern searched again for it
    pairs = let(host_of(F.col("url")), lambda src: F.transform(F.filter(F.transform(links, host_of), lambda dst: src != dst), lambda dst: F.struct(src.alias("src"), dst.alias("dst"))))
    return pages.select(F.explode(pairs).alias("e")).groupBy(F.col("e.src").alias("src"), F.col("e.dst").alias("dst")).agg(F.count("*").alias("w"))


def _any_like(col: str, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.col(col).like(p)
    return out


def personalised_rank(hosts: DataFrame, edges: DataFrame, seed: Column, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """id, score over materialised hosts(id, host) and edges(src, dst, w) between ids; mass flows from src to dst.

    Each round's ranks are written, so a lost executor costs one round; while they are few enough to be broadcast the
    edges stay where they are, and only flows summed by target are shuffled.
    """
    base = hosts.where(seed).select("id", F.lit(1.0).alias("s"))
    if not edges.take(1):
        # nothing spreads: each round gives seeds their share of (1 - damping)
        return hosts.join(base, "id", "left").select("id", F.coalesce(F.col("s") * (1 - damping if rounds else 1.0), F.lit(0.0)).alias("score"))
    total = materialise(edges.groupBy("src").agg(F.sum("w").alias("total")))
    step = materialise(edges.join(small_side(total, 24), "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    base = materialise(base)
    rank = base.withColumnRenamed("s", "r")
    for i in range(rounds):
        flow = step.join(small_side(rank.withColumnRenamed("id", "src"), 24), "src").select(F.col("dst").alias("id"), (F.col("r") * F.col("p") * damping).alias("r"))
        last, rank = rank, materialise(flow.unionByName(base.select("id", (F.col("s") * (1 - damping)).alias("r"))).groupBy("id").agg(F.sum("r").alias("r")))
        if i:
            release(last)
    release(step)
    return hosts.join(rank, "id", "left").select("id", F.coalesce("r", F.lit(0.0)).alias("score"))


def score_hosts(pages: DataFrame, trusted: list[str], blocked: list[str], rounds: int = ROUNDS, damping: float = DAMPING, min_distrust: float = MIN_DISTRUST) -> DataFrame:
    """host, trust, distrust, keep for every host that has a page or is linked to."""
    named = materialise(host_edges(pages))
    own = materialise(pages.select(host_of(F.col("url")).alias("host")).distinct())
    hosts, _ = numbered(own.where("host IS NOT NULL").union(named.select("src")).union(named.select("dst")).distinct(), "host", "id")
    hosts = materialise(hosts)
    # 40 rounds go over the edges: with numbers for names they are a third as long and no string is hashed
    ids = small_side(hosts, 80)
    end = lambda name: ids.select(F.col("host").alias(name), F.col("id").alias(f"{name}_id"))
    edges = materialise(named.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "w"))
    release(named)
    block = _any_like("host", blocked)
    trust = personalised_rank(hosts, edges, _any_like("host", trusted) & ~block, rounds, damping)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    distrust = personalised_rank(hosts, back, block, rounds, damping)
    bad = block | ((F.col("distrust") >= min_distrust) & (F.col("distrust") > F.col("trust")))
    scores = hosts.join(trust.withColumnRenamed("score", "trust"), "id").join(distrust.withColumnRenamed("score", "distrust"), "id")
    return scores.withColumn("keep", ~bad).select("host", "trust", "distrust", "keep")


def filter_urls(pages: DataFrame, trusted: list[str] = TRUSTED, blocked: list[str] = BLOCKED, rounds: int = ROUNDS, damping: float = DAMPING, min_distrust: float = MIN_DISTRUST) -> DataFrame:
    """page_id, url, host, trust, distrust, keep: one row a page."""
    scores = materialise(score_hosts(pages, trusted, blocked, rounds, damping, min_distrust))
    out = pages.select("page_id", "url", host_of(F.col("url")).alias("host"))
    joined = out.join(small_side(scores, 200), "host", "left")
    return joined.select("page_id", "url", "host", *[F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("trust", "distrust")], F.coalesce("keep", F.lit(True)).alias("keep"))


#: A table of pages that link to other hosts: each line of an order is a page of its supplier's host that links to the next line's.
_LINKED_SQL = """lines AS (SELECT l_orderkey * 10 + l_linenumber AS page_id, l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS b FROM lineitem),
pages AS (SELECT page_id, 'https://s' || a || '.example.' || (['com', 'net', 'org'])[a % 3 + 1] || '/' || page_id AS url, '<p><a href="https://s' || b || '.example.' || (['com', 'net', 'org'])[b % 3 + 1] || '/">next</a>' AS html FROM lines),
"""
LINKED_TRUSTED, LINKED_BLOCKED = ["s%1.example.%"], ["s%7.example.net"]


def linked_pages(lineitem: DataFrame) -> DataFrame:
    """page_id, url, html: pages with links between hosts, which the pages at hand don't have."""
    after = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    lines = lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("page_id"), F.col("l_suppkey").alias("a"), after.alias("b"))
    name = lambda c: F.concat(F.lit("https://s"), F.col(c).cast("string"), F.lit(".example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), (F.col(c) % 3 + 1).cast("int")), F.lit("/"))
    return lines.select("page_id", F.concat(name("a"), F.col("page_id").cast("string")).alias("url"), F.concat(F.lit('<p><a href="'), name("b"), F.lit('">next</a>')).alias("html"))


def _sql(pages: str = "", trusted: list[str] = TRUSTED, blocked: list[str] = BLOCKED) -> str:
    host = lambda u: f"nullif(lower(regexp_extract(coalesce({u}, ''), '{_HOST}', 1)), '')"
    like = lambda ps: "(" + " OR ".join(f"host LIKE '{p}'" for p in ps) + ")"
    rounds = []
    for kind, edges in (("t", "step"), ("d", "pets")):
        seed = f"{like(trusted)} AND NOT {like(blocked)}" if kind == "t" else like(blocked)
        rounds.append(f"{kind}s AS (SELECT host, 1.0::DOUBLE AS s FROM hosts WHERE {seed})")
        rounds.append(f"{kind}0 AS (SELECT host, s AS r FROM {kind}s)")
        for i in range(ROUNDS):
            rounds.append(
                f"{kind}{i + 1} AS MATERIALIZED (SELECT host, sum(r) AS r FROM (SELECT dst AS host, {DAMPING} * r * p AS r FROM {kind}{i} JOIN {edges} ON src = host "
                f"UNION ALL SELECT host, {1 - DAMPING} * s FROM {kind}s) GROUP BY host)"
            )
    return f"""
WITH {pages}links AS (SELECT {host('url')} AS src, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]+)', 1))) AS link FROM pages),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS w FROM (SELECT src, {host('link')} AS dst FROM links) WHERE src <> dst GROUP BY src, dst),
hosts AS MATERIALIZED (SELECT {host('url')} AS host FROM pages WHERE {host('url')} IS NOT NULL UNION SELECT src FROM edges UNION SELECT dst FROM edges),
step AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM edges),
pets AS MATERIALIZED (SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS p FROM edges),
{', '.join(rounds)},
scores AS (SELECT host, coalesce(a.r, 0) AS trust, coalesce(b.r, 0) AS distrust FROM hosts LEFT JOIN t{ROUNDS} a USING (host) LEFT JOIN d{ROUNDS} b USING (host))
SELECT page_id, url, p.host, round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust,
       coalesce(NOT ({like(blocked).replace('host', 'p.host')} OR (distrust >= {MIN_DISTRUST} AND distrust > trust)), true) AS keep
FROM (SELECT page_id, url, {host('url')} AS host FROM pages) p LEFT JOIN scores s ON s.host = p.host"""


FILTER_SQL = _sql()
LINKED_SQL = _sql(_LINKED_SQL, LINKED_TRUSTED, LINKED_BLOCKED)
