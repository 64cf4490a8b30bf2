"""BM25 search with title and domain boosts: bounded top-k, then the pages of those k only."""

from __future__ import annotations

from collections import Counter

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.porter2 import stem
from loam.functions.text import snippet
from loam.operators.index import Index

K1, B, TITLE_BOOST, DOMAIN_BOOST, TOP = 1.35, 0.75, 10.0, 50.0, 50


def query_terms(query: str, stemmed: bool = True) -> Counter:
    """The query's terms and how often each occurs; every occurrence scores."""
    # as documents are: runs of letters and numbers, in lower case
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if w]
    return Counter(stem(w) if stemmed else w for w in words)


def bm25(freq: Column, length: Column, df: Column, documents: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log((documents - df + 0.5) / (df + 0.5) + 1)
    return F.when(average == 0, 0.0).otherwise(idf * freq * (k1 + 1) / (freq + k1 * (b * length / average + 1 - b)))


def scored(index: Index, query: str, stemmed: bool = True) -> DataFrame:
    """page_id, score for every page that has a term of the query."""
    spark = index.postings.sparkSession
    wanted = query_terms(query, stemmed)
    if not wanted:
        return spark.createDataFrame([], "page_id long, score double")
    terms = sorted(wanted)
    q = spark.createDataFrame([(t, n) for t, n in wanted.items()], "term string, times long")
    hits = index.postings.where(F.col("term").isin(terms)).join(F.broadcast(q), "term")
    dfs = index.terms.where(F.col("term").isin(terms))
    hits = hits.join(F.broadcast(dfs), "term").join(index.doc_stats, "page_id", "left").crossJoin(F.broadcast(index.meta.select("document_count", "average_doc_length")))
    one = bm25(F.col("freq"), F.coalesce("token_count", F.lit(0)), F.col("df"), F.col("document_count"), F.col("average_doc_length"))
    one = one + F.when(F.col("in_title"), TITLE_BOOST).otherwise(0.0) + F.when(F.col("in_domain"), DOMAIN_BOOST).otherwise(0.0)
    return hits.groupBy("page_id").agg(F.sum(one * F.col("times")).alias("score"))


def top(scores: DataFrame, k: int = TOP) -> DataFrame:
    """The k best, ties by the lower page_id."""
    return scores.orderBy(F.desc(F.round("score", 9)), "page_id").limit(k)


def search(index: Index, pages: DataFrame, query: str, k: int = TOP, stemmed: bool = True, exclude_duplicates: bool = False) -> DataFrame:
    """rank, page_id, score, title, og_title, favicon, desc, url of the k best pages; missing pages are left out."""
    scores = scored(index, query, stemmed)
    if exclude_duplicates:
        scores = scores.join(pages.where("duplicate_of IS NOT NULL").select("page_id"), "page_id", "left_anti")
    best = top(scores, k)
    found = pages.join(F.broadcast(best), "page_id")
    out = found.select("page_id", "score", "title", F.coalesce("og_title", F.lit("")).alias("og_title"), F.coalesce("favicon", F.lit("")).alias("favicon"), snippet(F.col("description")).alias("desc"), F.col("final_url").alias("url"))
    return out.orderBy(F.desc(F.round("score", 9)), "page_id")
