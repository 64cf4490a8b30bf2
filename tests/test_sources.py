import pytest
from pyspark.sql import functions as F

from loam.operators.index import build_index
from loam.operators.rank import search
from loam.plans.crawl import crawl, index_snapshot
from loam.runtime import shared_dir
from loam.schemas import PAGE
from loam.sources import tables
from loam.sources.html import admitted_type, parse_page, parse_pages
from loam.streaming import frontier as streaming

BASE = "https://h.org/dir/page"


def parse(html, status=200):
    return parse_page(html, BASE, status)


def test_skipping_is_a_switch():
    assert parse("<body>a<input>b<form>c</form>d</body>")["text"] == "a d "
    assert parse("<body><nav>n</nav>x<script>if (a<b) {}</script> y\n z</body>")["text"] == "x y z "


def test_titles_anywhere():
    assert parse("<title>T</title><body><svg><title>S</title></svg></body>")["title"] == "T S "


def test_a_page_that_ends_in_its_title():
    p = parse("<a href='/x'>l</a><title>never closed")
    assert not p["has_been_crawled"] and p["links"] == ["https://h.org/x"] and p["title"] == ""


def test_head_fields():
    p = parse(
        '<html lang="en-GB"><head><title>T</title><meta name="description" content="one"><meta property="og:description" content="two"><meta property="OG:Title" content="og"><meta name="description" content="">'
        '<link rel="shortcut ICON" href="/i.ico"><link rel="icon" href="/j.ico"><link rel="canonical" href="/c/?x"></head><body>b</body></html>'
    )
    assert (p["description"], p["og_title"], p["favicon"], p["found_canonical"], p["in_english"]) == ("two", "og", "https://h.org/i.ico", "/c/?x", True)
    assert not parse('<html lang="de">')["in_english"] and parse("x")["in_english"]
    assert parse('<title>T</title><meta name="description" content="T ">')["description"] == ""


def test_links_are_resolved_distinct_and_capped():
    html = "".join(f"<a href='{u}'>x</a>" for u in ["../a", "//o.org/b", "mailto:x@y", "#f", "../a", ""])
    assert parse(html)["links"] == ["https://h.org/a", "https://o.org/b", BASE + "#f"]
    assert len(parse("".join(f"<a href='/{i}'>x</a>" for i in range(200)))["links"]) == 100


@pytest.mark.parametrize("status", [None, 199, 301, 404, 503])
def test_other_statuses_are_empty(status):
    p = parse("<title>T</title><a href='/x'>l</a>", status)
    assert not p["has_been_crawled"] and p["links"] == [] and p["title"] == ""


def test_size_gate_and_plain_text():
    assert parse("x" * ((10 << 20) + 1)) is None
    assert parse("just text")["text"] == "" and parse("just text")["has_been_crawled"]


def test_pages_in_spark(spark):
    rows = [(1, BASE, "<title>T</title><body>one two</body>"), (2, None, None), (3, BASE, "x" * ((10 << 20) + 1)), (None, "nonsense", "")]
    out = parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert [f.name for f in out.schema] == [f.name for f in PAGE]
    got = {r.page_id: r for r in out.collect()}
    assert set(got) == {1, 2, None} and got[1].title == "T " and got[1].host == "h.org" and not got[2].has_been_crawled
    assert parse_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_content_types(spark):
    got = [r.x for r in spark.createDataFrame([("text/HTML; charset=x",), ("image/png",), ("application/pdf",), (None,), ("",)], "t string").select(admitted_type(F.col("t")).alias("x")).collect()]
    assert got == [True, False, True, False, False]


def test_settings_from_the_environment(monkeypatch):
    monkeypatch.setenv("LOAM_CRAWL_COUNT", "7")
    monkeypatch.setenv("LOAM_SEEDS", "https://a,https://b")
    s = tables.Settings.from_environment()
    assert s.crawl_count == 7 and s.seeds == ["https://a", "https://b"]


def test_sinks_and_lookups(spark):
    path = shared_dir(spark)
    p = spark.createDataFrame([(1, "u", "f", True), (2, "u", "g", True), (3, "v", "h", False)], "page_id long, request_url string, final_url string, has_been_crawled boolean").withColumn("text", F.lit("x"))
    tables.append_pages(p, path)
    tables.append_pages(p.where("page_id = 3"), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 3 and tables.crawled_count(stored).first().n == 1
    tables.overwrite(p.limit(0), path)
    assert spark.read.parquet(path).count() == 0
    assert tables.by_url(p, "g").first().page_id == 2 and "text" not in tables.by_id(p, 2).columns
    assert [r.page_id for r in tables.exists(p, p.where("page_id > 1"), "page_id").collect()] == [2, 3]
    assert tables.as_json(p.select("page_id", F.lit(None).cast("string").alias("t")).limit(1)).first().json == '{"page_id":1,"t":null}'
    assert tables.seed_urls(spark, ["a", "b"]).count() == 2


def site(spark):
    link = lambda *to: "".join(f'<a href="{t}">l</a>' for t in to)
    rows = [
        (1, "https://a.org", f"<title>home</title><body>welcome {link('/1', '/2', 'https://b.org/x', 'https://blocked.com/y')}</body>"),
        (2, "https://a.org/1", f"<title>one</title><body>cats and dogs {link('/', '/3')}</body>"),
        (3, "https://a.org/2", "<title>two</title><body>more cats</body>"),
        (4, "https://b.org/x", "<title>b</title><body>birds</body>"),
        (5, "https://a.org/3", "<title>deep</title><body>fish</body>"),
        (6, "https://lone.org", "<title>lone</title><body>unreached</body>"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_a_crawl_reaches_what_is_linked(spark):
    settings = tables.Settings(crawl_count=50)
    got = crawl(tables.seed_urls(spark, ["https://a.org/"]), site(spark), settings, ["blocked.com"]).collect()
    assert sorted(r.page_id for r in got) == [1, 2, 3, 4, 5]
    assert len({r.crawled_at for r in got if r.host == "a.org"}) == 4
    assert len(crawl(tables.seed_urls(spark, ["https://a.org/"]), site(spark), tables.Settings(crawl_count=2), ["blocked.com"]).collect()) == 2


def test_a_snapshot_is_searched(spark):
    pages, index = index_snapshot(site(spark))
    assert [r.page_id for r in search(index, pages, "cat").collect()] == [3, 2]
    assert search(build_index(pages), pages, "fish", exclude_duplicates=True).first().page_id == 5


def test_streams(spark):
    path = shared_dir(spark)
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0), ("a", 3), (None, 1)], "host string, s long").select("host", F.timestamp_seconds("s").alias("at"))
    rows.coalesce(1).write.parquet(path)
    stream = streaming.read_stream(spark, path + "/", rows.schema)
    got = sorted((r.host, r.at.second, r.dispatched) for r in streaming.drained(streaming.polite_dispatch(stream)).collect())
    assert got == [("a", 0, True), ("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 0, True)]
    assert streaming.drained(streaming.distinct_urls(stream.select(F.col("host").alias("url")))).count() == 3


def test_a_crawl_goes_on_while_there_are_urls_and_offers_failed_ones_again(spark):
    n = 12
    pages = [(i, f"https://a.org/{i}", f"<body>p{i}<a href='/{i + 1}'>n</a>" + ("<a href='https://b.org/late'>b</a>" if i in (1, 8) else "")) for i in range(n)]
    snapshot = spark.createDataFrame(pages, "page_id long, url string, html string")
    settings = tables.Settings(seeds=[])
    seeds = tables.seed_urls(spark, ["https://a.org/0"])
    got = crawl(seeds, snapshot, settings, [])
    assert sorted(r.page_id for r in got.collect()) == list(range(n))
    failed = spark.createDataFrame([("a.org",)], "host string").withColumn("expires_at", F.timestamp_seconds(F.lit(1000)))
    late = crawl(seeds, snapshot.limit(2), settings, [], failed).collect()
    assert len(late) == 2 and min(r.crawled_at.timestamp() for r in late) >= 1000
