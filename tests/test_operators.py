import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loam.functions.text import tokens
from loam.operators import canonical, frontier, index, lsh, rank
from loam.operators.components import connected_components
from loam.runtime import build_session, drop_folder, materialise, shared_dir, small_side

PAGES = "page_id long, title string, text string, final_url string"


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(
        [(1, "a c ", "a a b", "https://x.d.com/a"), (2, "t" * 101, "a b", "https://e.com"), (3, None, None, None), (4, "", "", "https://a.com")], PAGES
    )


def test_postings_count_fields(pages):
    got = {(r.term, r.page_id): (r.freq, r.in_title, r.in_domain) for r in index.postings(index.field_tokens(pages, stemmed=False)).collect()}
    assert got == {
        ("a", 1): (3, True, False), ("b", 1): (1, False, False), ("c", 1): (1, True, False), ("d", 1): (1, False, True), ("com", 1): (1, False, True), ("a", 4): (1, False, True), ("com", 4): (1, False, True),
    }


def test_lengths_and_statistics(pages):
    stats = index.document_lengths(pages)
    assert sorted(map(tuple, stats.collect())) == [(1, 5), (3, 0), (4, 0)]
    assert tuple(index.corpus_statistics(stats).first()) == (3, 5, 1.0)
    assert tuple(index.corpus_statistics(stats.limit(0)).first()) == (0, 0, 0.0)


def test_offsets_in_order_of_term(spark):
    terms = spark.createDataFrame([("b", 1), ("c", 2), ("a", 3)], "term string, df long")
    assert sorted(map(tuple, index.posting_offsets(terms).collect())) == [("a", 3, 0), ("b", 1, 30), ("c", 2, 40)]


def test_an_index_survives_its_folder(spark, pages):
    path = shared_dir(spark)
    built = index.build_index(pages)
    index.write_index(built, path)
    again = index.read_index(spark, path)
    for name in ("postings", "terms", "doc_stats", "meta"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(built, name).collect()))
    lists = {r.term: [p.page_id for p in r.postings] for r in index.posting_lists(again.postings).collect()}
    assert lists["a"] == [1, 4]
    drop_folder(spark, path)
    drop_folder(spark, path)


@pytest.mark.parametrize("n,df,f,d,avg,want", [(3, 2, 2, 10, 8, 0.6130836586), (3, 3, 1, 8, 8, 0.1335313926), (100, 1, 5, 50, 100, 8.4643338700), (3, 1, 1, 1, 0, 0.0)])
def test_bm25(spark, n, df, f, d, avg, want):
    lit = lambda x: F.lit(float(x))
    assert abs(spark.range(1).select(rank.bm25(lit(f), lit(d), lit(df), lit(n), lit(avg)).alias("s")).first().s - want) < 1e-9


def test_search_orders_ties_and_boosts(spark):
    p = spark.createDataFrame(
        [(i, "cats " if i == 7 else "x ", "a cat sat" if i % 2 else "dogs", f"https://{'cat' if i == 4 else 'h'}.com/{i}", None, None, "d" * 10) for i in range(10)],
        "page_id long, title string, text string, final_url string, og_title string, favicon string, description string",
    )
    got = rank.search(index.build_index(p), p, "Cats, cat!").collect()
    assert [r.page_id for r in got] == [4, 7, 1, 3, 5, 9]
    assert got[0].score > 100 and 20 < got[1].score < 50
    assert rank.search(index.build_index(p), p, "..., ").count() == 0 and rank.search(index.build_index(p), p, "zebra").count() == 0
    assert [r.page_id for r in rank.search(index.build_index(p), p, "cat", 2).collect()] == [4, 7]


def test_query_terms_split_as_text_is_split(spark):
    for q in ("Foo-bar_baz 42é", "a b a", "", "٣x y"):
        words = spark.range(1).select(tokens(F.lit(q)).alias("t")).first().t
        assert sorted(rank.query_terms(q, False).elements()) == sorted(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, *edges[:5], (None, 3), (4, None), (7, 7)], "a long, b long")
    got = connected_components(df).collect()
    assert dict(map(tuple, got)) == want and len(got) == len(want)
    assert connected_components(df.limit(0)).count() == 0


def test_near_fingerprints_are_brute_force_s(spark):
    r = random.Random(5)
    fps = [r.getrandbits(64) - 2**63 for _ in range(60)]
    fps += [f ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for f in fps[:30]] + fps[:3]
    prints = spark.createDataFrame(list(enumerate(fps)), "page_id long, fp long")
    near = lambda a, b, d=3: ((a ^ b) & (2**64 - 1)).bit_count() <= d
    want = {(i, j) for i, j in combinations(range(len(fps)), 2) if near(fps[i], fps[j])}
    assert {tuple(x) for x in lsh.near_pairs(prints).collect()} == want
    few, many = lsh.near_fingerprints(prints), lsh.near_fingerprints(prints, few=10)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and lsh.bands(prints, 6).groupBy("fp").count().first()["count"] == 20
    assert {tuple(x) for x in connected_components(lsh.page_edges(prints)).collect()} == {tuple(x) for x in connected_components(spark.createDataFrame(sorted(want), "a long, b long")).collect()}
    with pytest.raises(ValueError):
        lsh.near_fingerprints(prints, 4)
    new = spark.createDataFrame([(1, fps[0] ^ 0b111), (2, fps[0] ^ 0b1111 ^ (1 << 40))], "page_id long, fp long")
    assert [x.page_id for x in lsh.already_known(new, prints.limit(1)).collect()] == [1]


CANON = "page_id long, final_url string, found_canonical string, title string, text string, status_code int, content_hash long, has_been_crawled boolean, resolved_canonical boolean, duplicate_of long"


def page(i, url, canonical_=None, **over):
    row = {"title": "t", "text": "x", "status": 200, "hash": 1, "crawled": True, "resolved": False, "of": None} | over
    return (i, url, canonical_, row["title"], row["text"], row["status"], row["hash"], row["crawled"], row["resolved"], row["of"])


def test_declared_canonicals(spark):
    p = spark.createDataFrame(
        [page(1, "https://x.com/", "https://x.com"), page(2, "https://x.com/b", "https://x.com"), page(3, "https://x.com/c", "https://x.com", text=" "), page(4, "https://y.com/d", "https://y.com/none"), page(5, "https://z.com", None)],
        CANON,
    )
    groups = canonical.canonical_groups(p)
    assert [tuple(r) for r in groups.collect()] == [(2, 1)]
    after = {r.page_id: (r.duplicate_of, r.resolved_canonical) for r in canonical.assign_duplicates(p, groups).collect()}
    assert after == {1: (None, False), 2: (1, True), 3: (None, False), 4: (None, False), 5: (None, False)}


def test_election_by_rank_then_id(spark):
    p = spark.createDataFrame([page(9, "https://a/9", status=404), page(4, "https://a/4", status=404), page(1, "https://a/1", status=404, text=" ", title="")], CANON)
    clusters = spark.createDataFrame([(9, 1), (4, 1), (1, 1)], "page_id long, root long")
    got = {r.page_id: (r.rank, r.duplicate_of) for r in canonical.elect(clusters, p).collect()}
    assert got == {9: (15, 4), 4: (15, None), 1: (0, 4)}


def test_votes_of_other_pages_elect(spark):
    p = spark.createDataFrame([page(1, "https://a/1", "https://a/3"), page(2, "https://a/2", "https://a/3.html"), page(3, "https://a/3")], CANON)
    clusters = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "page_id long, root long")
    assert {r.page_id: (r.rank, r.duplicate_of) for r in canonical.elect(clusters, p).collect()} == {1: (35, 3), 2: (35, 3), 3: (235, None)}


def test_deduplicate_joins_both_kinds(spark):
    p = spark.createDataFrame([page(1, "https://x.com", "https://x.com", hash=5), page(2, "https://x.com/b", "https://x.com", hash=5), page(3, "https://q/3", hash=9), page(4, "https://q/4", hash=8), page(5, "https://q/5", hash=-1)], CANON)
    got = {r.page_id: r.duplicate_of for r in canonical.deduplicate(p).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 3, 5: None}


def at(s):
    return F.timestamp_seconds(F.lit(s))


def test_admission_caps_and_filters(spark):
    links = spark.createDataFrame([(f"https://a.org/{i}?x", i) for i in range(6)] + [("https://a.org/1", 9), ("https://bad.com/x", 0), ("nonsense", 0), (None, 0)], "url string, s long").select("url", F.timestamp_seconds("s").alias("queued_at"))
    known = spark.createDataFrame([("https://a.org/0",)], "url string")
    queue = spark.createDataFrame([("https://a.org/2", "a.org")], "url string, host string").withColumn("queued_at", at(0))
    got = frontier.admit(links, known, queue, 3, 100, ["bad.com"]).collect()
    assert sorted(r.url for r in got) == ["https://a.org/1", "https://a.org/3"]
    assert frontier.admit(links, known, queue, 100, 2, ["bad.com"]).count() == 1


def test_dispatch_takes_one_a_host_and_cools(spark):
    queue = spark.createDataFrame([("u1", "a", 5), ("u2", "a", 1), ("u3", "b", 2), ("u4", "c", 3)], "url string, host string, s long").select("url", "host", F.timestamp_seconds("s").alias("queued_at"))
    hosts = spark.createDataFrame([("a", 10), ("b", 99)], "host string, s long").select("host", F.timestamp_seconds("s").alias("next_eligible_at"))
    jobs = frontier.dispatch(queue, hosts, at(10), 10)
    assert [tuple(r) for r in jobs.collect()] == [("u4", "c"), ("u2", "a")]
    assert frontier.dispatch(queue, hosts, at(10), 1).count() == 1
    cooled = {r.host: r.s for r in frontier.cooled(jobs, hosts, at(10), 2).select("host", F.unix_seconds("next_eligible_at").alias("s")).collect()}
    assert cooled == {"a": 12, "b": 99, "c": 12}


def test_failures_back_off(spark):
    assert [r.s for r in spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 9)], "n int").select(frontier.negative_cooldown(F.col("n")).alias("s")).collect()] == [0, 10, 30, 180, 180]
    tries = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("a", 4, False), ("b", 5, True)], "host string, s long, ok boolean").select("host", F.timestamp_seconds("s").alias("at"), "ok")
    failed = frontier.expire_failures(tries)
    assert [tuple(r) for r in failed.select("host", "failures", F.unix_seconds("expires_at")).collect()] == [("a", 2, 34)]
    hosts = spark.createDataFrame([("a",), ("b",)], "host string")
    assert [r.host for r in frontier.still_failed(hosts, failed, at(33)).collect()] == ["a"] and frontier.still_failed(hosts, failed, at(34)).count() == 0


def test_completion_drops_known_links(spark):
    parsed = spark.createDataFrame([("https://a/1?q", "https://a/1x", ["https://a/2", "https://a/1", "https://a/3#f"])], "request_url string, final_url string, links array<string>")
    done, links = frontier.complete(parsed, spark.createDataFrame([("https://a/3",)], "url string"))
    assert sorted(r.url for r in done.collect()) == ["https://a/1", "https://a/1x", "https://a/3"]
    assert [r.url for r in links.collect()] == ["https://a/2"]


def test_statistics_of_an_empty_frontier(spark):
    queue = spark.createDataFrame([], "url string, host string, queued_at timestamp")
    hosts = spark.createDataFrame([], "host string, next_eligible_at timestamp, dispatched long")
    r = frontier.frontier_stats(queue, hosts, at(0)).first()
    assert r.unique_hosts == 0 and r.largest_queue_host is None


def test_lineage_cuts_and_checked_broadcasts(spark):
    df = materialise(spark.range(100))
    assert df.count() == 100 and "Range" not in df._jdf.queryExecution().toString()
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString()
    assert hinted(small_side(df, 8)) and not hinted(small_side(df, 8, 100))
    assert build_session("tests") is not None


def test_hosts_wait_and_queues_are_bounded(spark):
    at = lambda n: F.timestamp_seconds(F.lit(n))
    links = spark.createDataFrame([("https://a.org/1", 5), ("https://b.org/1", 4), ("https://c.org/1", 3), ("https://a.org/2", 6)], "url string, n long").select("url", F.timestamp_seconds("n").alias("queued_at"))
    none = spark.createDataFrame([], "url string")
    queue = spark.createDataFrame([("https://a.org/0", "a.org")], "url string, host string").withColumn("queued_at", at(0))
    got = sorted(r.url for r in frontier.admit(links, none, queue, 10, 100, [], 2).collect())
    assert got == ["https://a.org/1", "https://a.org/2", "https://c.org/1"]
    hosts = spark.createDataFrame([], "host string, next_eligible_at timestamp")
    failed = spark.createDataFrame([("a.org",)], "host string").withColumn("expires_at", at(10))
    assert frontier.dispatch(queue, hosts, at(5), 9, failed).count() == 0 and frontier.dispatch(queue, hosts, at(10), 9, failed).count() == 1


def test_posting_blocks(spark):
    posts = spark.createDataFrame([("a", i * 40_000, 1, False, False) for i in range(5)] + [("b", 1, 2, True, False)], "term string, page_id long, freq long, in_title boolean, in_domain boolean")
    got = {(r.term, r.block): (r.byte_offset, len(r.records)) for r in index.postings_bytes(posts, index.term_dictionary(posts)).collect()}
    assert got == {("a", 0): (0, 20), ("a", 1): (20, 20), ("a", 2): (40, 10), ("b", 0): (50, 10)}
