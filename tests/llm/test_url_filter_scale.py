"""What url_filter_linked does for each row and each round, whatever the size."""

from loam.llm import url_filter

PAGES = "page_id long, url string, html string"


def test_each_host_is_searched_once(spark):
    pages = spark.createDataFrame([(1, "https://a.org/", '<a href="//b.org/">b</a>')], PAGES)
    plan = url_filter.host_edges(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.index("Generate") :].split("\n")[0].count("(?i:https?:)") == 2 and plan.count("(?i:https?:)") == 2


def test_rounds_carry_no_names(spark, monkeypatch):
    kinds = []
    real = url_filter.materialise
    monkeypatch.setattr(url_filter, "materialise", lambda df: (kinds.append({t for _, t in df.dtypes}), real(df))[1])
    pages = spark.createDataFrame([(i, f"https://h{i}.org/", f'<a href="//h{(i + 1) % 5}.org/">next</a>') for i in range(5)], PAGES)
    url_filter.score_hosts(pages, ["h1.org"], ["h2.org"], rounds=3).collect()
    assert sum("string" in k for k in kinds) == 3 and kinds.count({"bigint", "double"}) >= 6
