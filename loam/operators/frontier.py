"""A crawl's frontier in rounds: admission, per-host queues, dispatch, cool-down, completion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.urls import BLACKLIST, drop_blacklisted, host, normalize
from loam.runtime import materialise

COOLDOWN_SECONDS = 2


def admit(links: DataFrame, known: DataFrame, queue: DataFrame, per_host: int, pending: int, blacklist: list[str] = BLACKLIST, host_queues: int | None = None) -> DataFrame:
    """Links that join the queue: url, host, queued_at, added to queue(url, host, queued_at).

    links(url, queued_at) are normalised, stripped of listed domains and of urls in known(url) or queued, and
    taken oldest first while their host has fewer than per_host urls queued and the queue fewer than pending.  With
    host_queues, hosts without a queue get one, those of the oldest links first, while there are fewer queues.
    """
    new = links.select(normalize(F.col("url")).alias("url"), "queued_at").where("url <> ''")
    new = drop_blacklisted(new, "url", blacklist).withColumn("host", host(F.col("url"))).where("host IS NOT NULL")
    new = new.groupBy("url", "host").agg(F.min("queued_at").alias("queued_at"))
    new = new.join(known.select("url"), "url", "left_anti").join(queue.select("url"), "url", "left_anti")
    have = queue.groupBy("host").agg(F.count("*").alias("have"))
    turn = F.row_number().over(Window.partitionBy("host").orderBy("queued_at", "url"))
    # the literal bound lets each task drop a hot host's later links before they are shuffled
    new = new.withColumn("turn", turn).where(F.col("turn") <= per_host)
    new = new.join(have, "host", "left").where(F.col("turn") + F.coalesce("have", F.lit(0)) <= per_host)
    new = materialise(new.select("url", "host", "queued_at", F.col("have").isNull().alias("unqueued")))
    if host_queues is not None:
        fresh = new.where("unqueued").groupBy("host").agg(F.min("queued_at").alias("oldest")).orderBy("oldest", "host").limit(max(0, host_queues - have.count()))
        new = materialise(new.where("NOT unqueued").unionByName(new.where("unqueued").join(fresh.select("host"), "host", "left_semi").select(*new.columns)))
    new = new.select("url", "host", "queued_at")
    room = max(0, pending - queue.count())
    return new if new.count() <= room else new.orderBy("queued_at", "url").limit(room)


def host_capped(urls: DataFrame, cap: int) -> DataFrame:
    """At most cap urls a host, the oldest."""
    turn = F.row_number().over(Window.partitionBy("host").orderBy("queued_at", "url"))
    return urls.withColumn("__turn", turn).where(F.col("__turn") <= cap).drop("__turn")


def dispatch(queue: DataFrame, hosts: DataFrame, now: Column, slots: int, failed: DataFrame | None = None) -> DataFrame:
    """url, host of this round's jobs: the oldest url of each host that is not cooling, longest-ready hosts first.

    hosts(host, next_eligible_at) need not have every host; one it lacks is ready.  Hosts whose lookups failed, in
    failed(host, expires_at), are not asked before that has expired.
    """
    if failed is not None:
        queue = queue.join(still_failed(queue.select("host").distinct(), failed, now), "host", "left_anti").select(*queue.columns)
    ready = queue.join(hosts.select("host", "next_eligible_at"), "host", "left").where(F.col("next_eligible_at").isNull() | (F.col("next_eligible_at") <= now))
    first = F.row_number().over(Window.partitionBy("host").orderBy("queued_at", "url"))
    jobs = ready.withColumn("turn", first).where("turn = 1")
    return jobs.orderBy(F.col("next_eligible_at").asc_nulls_first(), "queued_at", "url").limit(slots).select("url", "host")


def cooled(jobs: DataFrame, hosts: DataFrame, now: Column, seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """hosts with those just asked not eligible again before now + seconds."""
    asked = jobs.select("host").distinct().withColumn("until", now + F.make_interval(secs=F.lit(seconds)))
    return hosts.join(asked, "host", "full").select("host", F.greatest("next_eligible_at", "until").alias("next_eligible_at"))


def complete(parsed: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known urls with the pages' requested and final ones, links of the pages that are not among them)."""
    done = parsed.select(normalize(F.col("request_url")).alias("url")).union(parsed.select(normalize(F.col("final_url")).alias("url"))).union(known.select("url")).distinct()
    links = parsed.select(F.explode("links").alias("link")).select(normalize(F.col("link")).alias("url")).distinct()
    return done, links.join(done, "url", "left_anti")


def negative_cooldown(failures: Column) -> Column:
    """Seconds a host whose lookups fail is left alone, by how often they have."""
    return F.when(failures <= 0, 0).when(failures == 1, 10).when(failures == 2, 30).otherwise(180)


def still_failed(hosts: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """hosts(host) whose entry in failed(host, expires_at) has not expired."""
    return hosts.join(failed.where(F.col("expires_at") > now).select("host"), "host", "left_semi")


def expire_failures(attempts: DataFrame) -> DataFrame:
    """host, failures since its last success, expires_at, of attempts(host, at, ok)."""
    last_ok = attempts.where("ok").groupBy("host").agg(F.max("at").alias("last_ok"))
    bad = attempts.where("NOT ok").join(last_ok, "host", "left").where("last_ok IS NULL OR at > last_ok")
    out = bad.groupBy("host").agg(F.count("*").alias("failures"), F.max("at").alias("last"))
    return out.select("host", "failures", (F.col("last") + F.make_interval(secs=negative_cooldown(F.col("failures")))).alias("expires_at"))


def frontier_stats(queue: DataFrame, hosts: DataFrame, now: Column) -> DataFrame:
    """One row: hosts, pending urls, the largest and the oldest queue, the most dispatched host, cooling and available hosts.

    hosts(host, next_eligible_at, dispatched); ties by the lower host.
    """
    q = queue.groupBy("host").agg(F.count("*").alias("pending"), F.min("queued_at").alias("oldest"))
    h = hosts.join(q, "host", "full").withColumn("pending", F.coalesce("pending", F.lit(0))).withColumn("cooling", F.coalesce(F.col("next_eligible_at") > now, F.lit(False)))
    first = lambda value, least=False: F.min(F.struct((value if least else -value).alias("v"), F.col("host")))["host"]
    return h.agg(
        F.count("*").alias("unique_hosts"), F.sum("pending").alias("pending_urls"), F.max("pending").alias("largest_queue"), first(F.col("pending")).alias("largest_queue_host"),
        F.min(F.when(F.col("oldest").isNotNull(), F.struct("oldest", "host")))["host"].alias("oldest_queue_host"),
        F.max("dispatched").alias("most_dispatched"), first(F.coalesce("dispatched", F.lit(0))).alias("most_dispatched_host"),
        F.count_if("cooling").alias("cooldown_hosts"), F.count_if(~F.col("cooling")).alias("available_hosts"),
    )
