"""Duplicates by declared canonical and by near fingerprints; election of one page of each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import is_blank
from loam.functions.urls import _TAILS, is_probably_canonical
from loam.operators.components import connected_components
from loam.operators.lsh import page_edges
from loam.sources.tables import canonical_candidates, simhash_candidates


def canonical_groups(pages: DataFrame, with_exact: bool = True) -> DataFrame:
    """page_id, duplicate_of: pages that declare a canonical which another page owns; of owners of one url the last counts."""
    c = canonical_candidates(pages, with_exact).select("page_id", "final_url", "found_canonical")
    c = c.withColumn("owns", is_probably_canonical(F.col("final_url"), F.col("found_canonical")))
    owners = c.where("owns").groupBy("found_canonical").agg(F.max("page_id").alias("duplicate_of"))
    return c.where("NOT owns").join(owners, "found_canonical").select("page_id", "duplicate_of")


def assign_duplicates(pages: DataFrame, assigned: DataFrame) -> DataFrame:
    """A new version of pages with duplicate_of and resolved_canonical set for the pages of assigned(page_id, duplicate_of)."""
    new = assigned.select("page_id", F.col("duplicate_of").alias("__of"))
    joined = pages.join(new, "page_id", "left")
    changed = {"duplicate_of": F.coalesce("__of", "duplicate_of"), "resolved_canonical": F.col("resolved_canonical") | F.col("__of").isNotNull()}
    return joined.select(*[changed[c].alias(c) if c in changed else c for c in pages.columns])


def near_clusters(pages: DataFrame) -> DataFrame:
    """page_id, root of pages that are near another, joined transitively."""
    prints = simhash_candidates(pages).select("page_id", F.col("content_hash").alias("fp"))
    return connected_components(page_edges(prints)).withColumnRenamed("node", "page_id")


def members(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("root").agg(F.sort_array(F.collect_list("page_id")).alias("members"))


def elect(clusters: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, root, rank, duplicate_of (null for the elected).

    50 for a page that is its own canonical, 100 for each other page of the cluster that declares it, 20 for a
    2xx status, 5 for text, 10 for a title; ties by the lower page_id.  Declarations are counted by an equi join
    on (cluster, url), not pair by pair.
    """
    p = clusters.join(pages.select("page_id", "final_url", "found_canonical", "status_code", "title", "text"), "page_id")
    own = F.when(is_probably_canonical(F.col("final_url"), F.col("found_canonical")), 50).otherwise(0)
    named = p.where("found_canonical IS NOT NULL").select("root", F.col("found_canonical").alias("url"), F.col("page_id").alias("namer"))
    ends = p.select("root", "page_id", F.explode(F.array_distinct(F.array(*[F.concat("final_url", F.lit(t)) for t in _TAILS]))).alias("url"))
    votes = ends.join(named, ["root", "url"]).where("namer <> page_id").groupBy("root", "page_id").agg(F.count("*").alias("votes"))
    score = own + F.when(F.col("status_code").between(200, 299), 20).otherwise(0) + F.when(is_blank(F.col("text")), 0).otherwise(5) + F.when(F.coalesce("title", F.lit("")) != "", 10).otherwise(0)
    ranked = p.join(votes, ["root", "page_id"], "left").select("root", "page_id", (score + 100 * F.coalesce("votes", F.lit(0))).cast("long").alias("rank"))
    best = ranked.groupBy("root").agg(F.max_by("page_id", F.struct("rank", -F.col("page_id"))).alias("best"))
    return ranked.join(best, "root").select("page_id", "root", "rank", F.when(F.col("best") != F.col("page_id"), F.col("best")).alias("duplicate_of"))


def deduplicate(pages: DataFrame) -> DataFrame:
    """pages with duplicates marked: first by declared canonical, then, of those left, by near text."""
    first = assign_duplicates(pages, canonical_groups(pages))
    elected = elect(near_clusters(first), first).where("duplicate_of IS NOT NULL").select("page_id", "duplicate_of")
    return assign_duplicates(first, elected)
