"""Postings counted page by page against those grouped from tokens, and that nothing is shuffled for them."""

import pytest
from pyspark.sql import functions as F

from loam.operators import index, rank
from loam.plans import store

PAGES = "page_id long, title string, text string, final_url string"
ROWS = [
    (1, "a c ", "a a b Running runs", "https://x.d.com/a"), (2, "t" * 101, "a b", "https://e.com"), (3, None, None, None), (4, "", "", "https://a.com"), (5, "a", "É é 42 𝟗 x_y", "https://co.uk"),
    (6, "com b", "word " * 3000, "https://b.com"), (None, "null", "a id", "https://d.com"),
]
AGAIN = [(1, "", "a d com", "https://com.org"), (4, "a", "", "https://a.com"), (None, "", "id a", None), (3, "", "", "https://q.net")]


def flat(df):
    return sorted(map(str, df.select("term", "page_id", "freq", "in_title", "in_domain").collect()))


@pytest.mark.parametrize("stemmed", [False, True])
@pytest.mark.parametrize("rows", [ROWS, ROWS + AGAIN, []])
def test_postings_are_those_of_the_tokens(spark, rows, stemmed):
    pages = spark.createDataFrame(rows, PAGES)
    want = index.postings(index.field_tokens(pages, stemmed))
    assert flat(index.page_postings(pages, stemmed)) == flat(want)
    assert flat(index.page_postings(pages, stemmed, only=["a", "com", "run"])) == flat(want.where(F.col("term").isin("a", "com", "run")))
    assert flat(index.page_postings(pages, stemmed, with_domain=False)) == flat(index.postings(index.field_tokens(pages, stemmed, with_domain=False)))


def test_postings_and_index_shuffle_nothing(spark):
    built = index.build_index(spark.createDataFrame(ROWS, PAGES))
    assert "Exchange" not in built.postings._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [ROWS, ROWS + AGAIN, []])
def test_a_query_s_index_scores_as_the_whole(spark, rows):
    pages = spark.createDataFrame(rows, PAGES)
    scores = lambda i: sorted((str(r.page_id), round(r.score, 9)) for r in rank.scored(i, "a a com running").collect())
    assert scores(index.query_index(pages, rank.query_terms("a a com running"))) == scores(index.build_index(pages))


def test_counters_read_the_postings_once(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    plan = store.index_summary(index.build_index(pages))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    none = store.index_summary(index.build_index(pages.limit(0))).first()
    assert (none.postings, none.occurrences, none.terms, none.most_pages_of_a_term, none.title_postings) == (0, None, 0, None, 0)
