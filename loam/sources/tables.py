"""Reading and writing the engine's tables: scans with pushed-down predicates, versioned index folders."""

from __future__ import annotations

from dataclasses import dataclass, field
from os import environ

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a crawl starts unless told otherwise, by letter.
SEEDS = sorted(
    f"https://{h}"
    for h in "en.wikipedia.org github.com news.ycombinator.com web.archive.org www.amazon.com www.booking.com www.ebay.com www.goodreads.com www.imdb.com www.nytimes.com www.pinterest.com "
    "www.reddit.com www.target.com www.tripadvisor.com www.walmart.com".split()
)


@dataclass
class Settings:
    """Knobs of a crawl and of the index; each can be set by an environment variable LOAM_<NAME>."""

    crawl_count: int = 10_000
    max_pending_urls: int = 100_000
    max_urls_per_host: int = 500
    max_host_queues: int = 10_000
    dispatch_slots: int = 150
    cooldown_seconds: int = 2
    data_path: str = "data"
    keep_indexes: int = 2
    show_crawl_stats: bool = False
    show_index_stats: bool = False
    host: str = "127.0.0.1"
    port: int = 8000
    allowed_origins: list[str] = field(default_factory=lambda: ["http://localhost:3000"])
    requests_a_minute: int = 100
    seeds: list[str] = field(default_factory=lambda: list(SEEDS))

    @classmethod
    def from_environment(cls) -> Settings:
        out = cls()
        for name, value in vars(out).items():
            raw = environ.get(f"LOAM_{name.upper()}")
            if raw is not None:
                setattr(out, name, raw.split(",") if isinstance(value, list) else raw.lower() in ("1", "true", "yes") if isinstance(value, bool) else type(value)(raw))
        return out


def crawled(pages: DataFrame) -> DataFrame:
    return pages.where("has_been_crawled")


def page_batch(pages: DataFrame, after: int, n: int) -> DataFrame:
    """The next n crawled pages by id: the three columns the index needs."""
    return crawled(pages).where(F.col("page_id") > after).select("page_id", "title", "text").orderBy("page_id").limit(n)


def crawled_count(pages: DataFrame) -> DataFrame:
    return crawled(pages).agg(F.count("page_id").alias("n"))


def by_id(pages: DataFrame, page_id: int) -> DataFrame:
    return pages.where(F.col("page_id") == page_id).drop("text")


def by_url(pages: DataFrame, url: str) -> DataFrame:
    return pages.where(F.col("final_url") == url)


def exists(pages: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows of wanted whose column is in pages."""
    return wanted.join(pages.select(column), column, "left_semi")


def _no_text(text: Column) -> Column:
    return F.length(F.btrim(text, F.lit(" "))) > 0


def canonical_candidates(pages: DataFrame, with_exact: bool = True) -> DataFrame:
    """Crawled, unresolved pages with text and a fingerprint that declare a canonical; with_exact keeps those that declare themselves."""
    out = pages.where("has_been_crawled AND NOT resolved_canonical AND content_hash <> 0 AND duplicate_of IS NULL AND found_canonical IS NOT NULL AND found_canonical <> ''").where(_no_text(F.col("text")))
    return out if with_exact else out.where("found_canonical <> final_url")


def simhash_candidates(pages: DataFrame) -> DataFrame:
    """Crawled pages with text and a fingerprint that declare no canonical and are no duplicate yet."""
    return pages.where("has_been_crawled AND found_canonical IS NULL AND content_hash <> 0 AND duplicate_of IS NULL").where(_no_text(F.col("text")))


def latest(meta: DataFrame) -> DataFrame:
    return meta.orderBy(F.desc("id")).limit(1)


def append_pages(pages: DataFrame, path: str) -> None:
    """Appends pages, one a request url."""
    pages.dropDuplicates(["request_url"]).write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def fetched(urls: DataFrame, snapshot: DataFrame) -> DataFrame:
    """A fetch against a snapshot of pages: urls(url) with the snapshot's row of least page_id, null html where it has none.

    Only pages that are asked for are compared, so no other page's html is shuffled.
    """
    asked = snapshot.join(urls.select("url"), "url", "left_semi")
    first = asked.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return urls.join(asked.join(first, ["url", "page_id"]).dropDuplicates(["url"]), "url", "left")


def seed_urls(spark: SparkSession, seeds: list[str] = SEEDS) -> DataFrame:
    return spark.createDataFrame([(s,) for s in seeds], "url string")


def as_json(df: DataFrame) -> DataFrame:
    """One column of JSON objects."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
