"""python -m loam crawl|index|rank|run|serve: a crawl of a page snapshot, its index, and search over it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loam.functions.stats import as_table
from loam.functions.urls import BLACKLIST
from loam.operators.rank import search
from loam.plans import store
from loam.runtime import build_session
from loam.serve import make_server, searcher
from loam.sources.tables import Settings

#: Asked when rank is given no query.
SMOKE = [
    "github access tokens", "gItHuB access tokens", "google account", "python programming tutorial", "how to code for beginners", "space exploration", "mental health resources", "stomach pain", "acid reflux", "the and of",
]


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="loam", description=__doc__)
    p.add_argument("what", choices=["crawl", "index", "rank", "run", "serve"])
    p.add_argument("query", nargs="*", help="for rank and run: queries")
    p.add_argument("--snapshot", help="for crawl and run: Parquet of page_id, url, html")
    p.add_argument("--data", help="folder of the pages and indexes")
    p.add_argument("--allow-all", action="store_true", help="crawl listed domains too")
    a = p.parse_intermixed_args(args)
    settings = Settings.from_environment()
    root = a.data or settings.data_path
    spark = spark or build_session()
    if a.what in ("crawl", "run"):
        if not a.snapshot:
            p.error("a crawl needs --snapshot")
        pages = store.crawl_to(spark, spark.read.parquet(a.snapshot), root, settings, [] if a.allow_all else BLACKLIST)
        if settings.show_crawl_stats:
            as_table(store.crawl_summary(pages)).show(100, False)
    if a.what in ("index", "run"):
        index = store.index_to(spark, root, settings)
        if settings.show_index_stats:
            as_table(store.index_summary(index)).show(100, False)
    if a.what in ("rank", "run"):
        index, pages = store.latest_index(spark, root), spark.read.parquet(f"{root}/pages")
        for q in a.query or SMOKE:
            print(f"\n{q}")
            for i, r in enumerate(search(index, pages, q, 10).collect(), 1):
                print(f"{i:3} {r.score:10.4f} {r.url} {(r.title or '').strip()}")
    if a.what == "serve":
        server = make_server(searcher(spark, root), settings)
        print(f"http://{settings.host}:{server.server_address[1]}")
        server.serve_forever()


if __name__ == "__main__":
    main()
