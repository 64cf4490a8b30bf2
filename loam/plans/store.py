"""Tables of a run in one folder: pages, and indexes that are versioned so that readers never see half of one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators.canonical import deduplicate
from loam.operators.index import Index, build_index, read_index, write_index
from loam.plans.crawl import crawl
from loam.runtime import drop_folder, materialise
from loam.sources.tables import Settings, overwrite, seed_urls


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the whole indexes in a folder, the oldest first; one without its last table is left out."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/index")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [re.fullmatch(r"v(\d+)", s.getPath().getName()) for s in fs.listStatus(path)]
    done = lambda m: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/index/{m[0]}/meta/_SUCCESS"))
    return sorted(int(m[1]) for m in names if m and done(m))


def crawl_to(spark: SparkSession, snapshot: DataFrame, root: str, settings: Settings, blacklist: list[str] | None = None) -> DataFrame:
    """Crawls from the settings' seeds, marks duplicates, replaces root's pages; gives them."""
    more = {} if blacklist is None else {"blacklist": blacklist}
    pages = materialise(deduplicate(crawl(seed_urls(spark, settings.seeds), snapshot, settings, **more)))
    overwrite(pages, f"{root}/pages")
    return spark.read.parquet(f"{root}/pages")


def index_to(spark: SparkSession, root: str, settings: Settings) -> Index:
    """Indexes root's crawled pages as a new version; versions before the last few are deleted."""
    have = _versions(spark, root)
    pages = spark.read.parquet(f"{root}/pages")
    new = f"{root}/index/v{(have[-1] if have else 0) + 1:06d}"
    write_index(build_index(pages.where("has_been_crawled")), new)
    for v in have[: max(0, len(have) + 1 - settings.keep_indexes)]:
        drop_folder(spark, f"{root}/index/v{v:06d}")
    return read_index(spark, new)


def latest_index(spark: SparkSession, root: str) -> Index:
    have = _versions(spark, root)
    if not have:
        raise FileNotFoundError(f"no index in {root}")
    return read_index(spark, f"{root}/index/v{have[-1]:06d}")


def crawl_summary(pages: DataFrame) -> DataFrame:
    """One row of counts over crawled pages."""
    return pages.agg(
        F.count("*").alias("pages"), F.count_if("has_been_crawled").alias("crawled"), F.count_if("in_english").alias("in_english"), F.countDistinct("host").alias("hosts"),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"), F.count_if(F.col("content_hash") == 0).alias("without_fingerprint"), F.sum(F.size("links")).alias("links"),
        F.sum(F.octet_length("text")).alias("text_bytes"), F.max(F.octet_length("text")).alias("largest_text"),
    )


def index_summary(index: Index) -> DataFrame:
    """One row of counts over an index."""
    # by term first: the postings are read once, and what is summed then is a row a term
    each = index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("freq").alias("freq"), F.count_if("in_title").alias("t"), F.count_if("in_domain").alias("d"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = each.agg(
        none("df").alias("postings"), F.sum("freq").alias("occurrences"), none("t").alias("title_postings"), none("d").alias("domain_postings"),
        F.count("*").alias("terms"), F.max("df").alias("most_pages_of_a_term"), F.count_if(F.col("df") == 1).alias("terms_of_one_page"),
    )
    return index.meta.select("document_count", "total_token_count", "average_doc_length").crossJoin(counts)
