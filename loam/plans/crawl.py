"""Whole runs: rounds of a crawl against a page snapshot, then dedup, index and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.functions.urls import BLACKLIST
from loam.operators import frontier
from loam.operators.canonical import deduplicate
from loam.operators.index import Index, build_index
from loam.runtime import materialise
from loam.sources.html import parse_pages
from loam.sources.tables import Settings, fetched


def crawl(seeds: DataFrame, snapshot: DataFrame, settings: Settings, blacklist: list[str] = BLACKLIST, failed: DataFrame | None = None) -> DataFrame:
    """Pages reached from seeds(url) within a snapshot(page_id, url, html): rounds of dispatch, fetch, parse and admission.

    A round takes one url a host and at most dispatch_slots; the clock goes on by the cool-down each round.
    It ends when crawl_count pages are parsed or nothing is left to ask for, after however many rounds.  A url that the
    snapshot lacks is not known by that: a later page that links to it offers it again.  Hosts in failed(host,
    expires_at) wait until that has expired.  Only counts reach the driver.
    """
    spark = seeds.sparkSession
    clock = lambda i: F.timestamp_seconds(F.lit(i * settings.cooldown_seconds))
    known = spark.createDataFrame([], "url string")
    queue = spark.createDataFrame([], "url string, host string, queued_at timestamp")
    hosts = spark.createDataFrame([], "host string, next_eligible_at timestamp")
    queue = materialise(frontier.admit(seeds.select("url", clock(0).alias("queued_at")), known, queue, settings.max_urls_per_host, settings.max_pending_urls, blacklist, settings.max_host_queues))
    done, total = [], 0
    i = 0
    while queue.take(1):
        jobs = materialise(frontier.dispatch(queue, hosts, clock(i), settings.dispatch_slots, failed))
        if not jobs.take(1):
            # all hosts left wait: on to when the first of them may be asked
            waits = queue.select("host").distinct().join(hosts, "host", "left").select(F.col("next_eligible_at").alias("at"))
            if failed is not None:
                waits = waits.union(queue.select("host").distinct().join(failed, "host").select("expires_at"))
            soon = waits.where(F.col("at") > clock(i)).agg(F.min(F.unix_seconds("at"))).first()[0]
            if soon is None:
                break
            i = max(i + 1, -(-soon // max(1, settings.cooldown_seconds)))
            continue
        page = fetched(jobs.select("url"), snapshot.withColumn("url", frontier.normalize(F.col("url")))).where("html IS NOT NULL")
        parsed = materialise(parse_pages(page.withColumn("fetched_at", clock(i))))
        kept = parsed.where("has_been_crawled").limit(settings.crawl_count - total)
        kept = materialise(kept)
        total += kept.count()
        done.append(kept)
        known, links = frontier.complete(parsed, known)
        known = materialise(known)
        hosts = materialise(frontier.cooled(jobs, hosts, clock(i), settings.cooldown_seconds))
        left = queue.join(jobs.select("url"), "url", "left_anti")
        new = frontier.admit(links.select("url", clock(i + 1).alias("queued_at")), known, left, settings.max_urls_per_host, settings.max_pending_urls, blacklist, settings.max_host_queues)
        queue = materialise(left.unionByName(new))
        i += 1
        if total >= settings.crawl_count:
            break
    out = done[0] if done else parse_pages(snapshot.limit(0))
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def index_snapshot(snapshot: DataFrame, stemmed: bool = True) -> tuple[DataFrame, Index]:
    """Parsed, deduplicated pages of a snapshot and the index over them."""
    pages = materialise(deduplicate(materialise(parse_pages(snapshot))))
    return pages, build_index(pages.where("has_been_crawled"), stemmed)
