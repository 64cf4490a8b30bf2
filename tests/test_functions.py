import random

import pytest
import xxhash
from pyspark.sql import functions as F

from loam.functions import bloom, collections, stats, text, urls
from loam.functions.porter2 import stem, stem_terms
from loam.functions.simhash import fingerprint, simhash


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "url,want", [("https://a.com/x/?q=1#f", "https://a.com/x"), ("https://a.com//", "https://a.com/"), ("", ""), (None, None), ("https://A.com/B/", "https://A.com/B"), ("https://a.com/#x?y", "https://a.com")]
)
def test_normalize(spark, url, want):
    assert one(spark, urls.normalize(F.col("u")), u=url) == want


@pytest.mark.parametrize("url,want", [("http://A.com:80/x", "A.com"), ("http://[::1]:8/x", "::1"), ("nonsense", None), (None, None), ("//b.org/x", "b.org")])
def test_host(spark, url, want):
    assert one(spark, urls.host(F.col("u").cast("string")), u=url) == want


@pytest.mark.parametrize(
    "host,want", [("www.a.co.uk", "a.co.uk"), ("x.y.example.com", "example.com"), ("co.uk", ""), ("localhost", ""), ("10.0.0.1", ""), ("", ""), (None, ""), ("A.Com", "a.com"), ("2001:db8::1", "")]
)
def test_registrable_domain(spark, host, want):
    assert one(spark, urls.registrable_domain(F.col("h").cast("string")), h=host) == want


@pytest.mark.parametrize(
    "base,link,want",
    [
        ("https://a.com/x/y", "../z", "https://a.com/z"), ("https://a.com/x", "//b.org/q", "https://b.org/q"), ("https://a.com", "mailto:x@y", None), ("https://a.com/x?q", "#f", "https://a.com/x?q#f"),
        (None, "/x", None), ("https://a.com", None, "https://a.com"), ("https://a.com", "http://[bad", None),
    ],
)
def test_resolve(base, link, want):
    assert urls.resolve_one(base, link) == want


def test_canonical_endings(spark):
    final, c = "https://x.com/", "https://x.com"
    assert one(spark, urls.is_probably_canonical(F.col("f"), F.col("c")), f=final, c=c)
    assert not one(spark, urls.is_probably_canonical(F.col("f"), F.col("c").cast("string")), f=final, c=None)
    assert one(spark, urls.is_canonical_owner(F.col("f"), F.col("c")), f="https://x.com/a", c="https://x.com/a/index.html")


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="Foo-bar_baz 42é") == ["foo", "bar", "baz", "42é"]
    assert one(spark, text.tokens(F.col("t").cast("string")), t=None) == []


def test_collapse_and_blank(spark):
    assert one(spark, text.collapse(F.col("t")), t=" a  b\x85c \n") == "a b c"
    assert one(spark, text.is_blank(F.col("t")), t="　 \t") and not one(spark, text.is_blank(F.col("t")), t=" . ")


def test_snippet(spark):
    words = ["w" * 5] * 39 + ["endd."] + ["x" * 6] * 10
    long = " ".join(words)
    assert len(long) > 300
    assert one(spark, text.snippet(F.col("t")), t=long) == " ".join(words[:40]) + ".."
    ten = " ".join(["y" * 30] * 10)
    assert one(spark, text.snippet(F.col("t")), t=ten) == ten + "..."
    assert one(spark, text.snippet(F.col("t")), t="short") == "short"


def test_title_admission_counts_bytes(spark):
    assert one(spark, text.title_admitted(F.col("t")), t="é" * 50) and not one(spark, text.title_admitted(F.col("t")), t="é" * 50 + "x")


def test_bit_helpers(spark):
    fp = -1234567890123456789
    assert one(spark, text.hamming(F.col("a"), F.col("b")), a=fp, b=fp ^ 0b10110) == 3
    got = [one(spark, text.chunk(F.col("a"), i), a=fp) for i in range(4)]
    assert got == [((fp & (2**64 - 1)) >> (16 * i)) & 0xFFFF for i in range(4)]
    assert one(spark, text.bit_list(F.col("a")), a=fp) == [int(c) for c in f"{fp & (2**64 - 1):064b}"]


def test_shingles(spark):
    n = [len(one(spark, text.shingles(F.col("t")), t="w " * k)) for k in (6, 7, 8)]
    assert n == [0, 1, 2]


def test_fingerprint_goldens(spark):
    seven, eight = "one two three four five six seven ", "one two three four five six seven eight "
    assert fingerprint(seven) == 13653927156704931161 and fingerprint(eight) == 2432542090144801344
    assert fingerprint("one two") == 0 and fingerprint(None) == 0
    assert one(spark, simhash(F.col("t")), t=seven) == -4792816917004620455


def test_fingerprint_is_bitwise_majority():
    r = random.Random(1)
    words = [r.choice("abcdefgh") * r.randint(1, 4) for _ in range(60)]
    h = [xxhash.xxh3_64_intdigest(" ".join(words[i : i + 8])) for i in range(53)]
    want = "".join("1" if 2 * sum(x >> j & 1 for x in h) > len(h) else "0" for j in range(64))
    assert fingerprint(" ".join(words)) == int(want, 2)


@pytest.mark.parametrize(
    "word,want",
    {
        "consign": "consign", "consistency": "consist", "knightly": "knight", "knocks": "knock", "generously": "generous", "skies": "sky", "dying": "die", "cries": "cri", "ties": "tie", "hoping": "hope",
        "hopping": "hop", "running": "run", "happily": "happili", "relational": "relat", "national": "nation", "communism": "communism", "exceed": "exceed", "news": "news", "the": "the", "gas": "gas", "kiwis": "kiwi",
        "authorization": "author", "abilities": "abil", "": "", "a": "a", "knackeries": "knackeri", "by": "by", "say": "say", "cry": "cri",
    }.items(),
)
def test_stems(word, want):
    assert stem(word) == want


def test_stem_terms_keeps_rows(spark):
    df = spark.createDataFrame([(1, "cats"), (1, "cats"), (2, None), (3, "")], "page_id long, term string")
    assert sorted(map(tuple, stem_terms(df).collect()), key=str) == [(1, "cat"), (1, "cat"), (2, None), (3, "")]


def test_bloom_sizes_and_members(spark):
    assert bloom.sizing(40_000, 0.01) == (383_402, 7)
    df = spark.range(500).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("u"))
    f = bloom.build(df, "u", 1000)
    assert df.where(~bloom.maybe_contains(f, F.col("u"))).count() == 0
    others = spark.range(1000, 6000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("u"))
    assert others.where(bloom.maybe_contains(f, F.col("u"))).count() < 0.05 * 5000


def test_box_plot(spark):
    df = spark.createDataFrame([(v,) for v in (9, 1, 5, 3, 7)] + [(None,)], "v long")
    r = stats.box_plot(df, "v").first()
    assert (r.samples, r.smallest, r.q1, r.median, r.q3, r.largest, r.iqr, r.below, r.above) == (5, 1, 2, 5, 8, 9, 6, 2, 2)
    assert stats.box_plot(df.limit(0), "v", []).count() == 0
    assert [tuple(x) for x in stats.as_table(stats.counters(df, big=F.col("v") > 4)).collect()] == [("big", "3")]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 6, 7, 8])
def test_box_plot_is_brute_force_s(spark, n):
    r = random.Random(n)
    vs = sorted(r.randrange(6) for _ in range(n))

    def mid(x):
        return 0 if not x else x[len(x) // 2] if len(x) % 2 else (x[len(x) // 2 - 1] + x[len(x) // 2]) // 2

    got = stats.box_plot(spark.createDataFrame([(None, v) for v in vs] + [("k", 3)], "g string, v long"), "v", ["g"]).collect()
    assert sorted(x.samples for x in got) == ([1, n] if n else [1])
    for x in got:
        if x.g is None:
            m, q1, q3 = mid(vs), mid(vs[: n // 2]), mid(vs[(n + 1) // 2 :])
            assert tuple(x)[1:] == (n, vs[0], q1, m, q3, vs[-1], q3 - q1, sum(v < m for v in vs), sum(v > m for v in vs))


@pytest.mark.parametrize("rows,n", [(0, 3), (2, 5), (10, 4), (1000, 7), (7, 7)])
def test_chunks_are_even_and_in_order(spark, rows, n):
    got = collections.split_into_chunks(spark.range(rows), n, "id").orderBy("id").collect()
    size, more = divmod(rows, n)
    want = [c + 1 for c in range(n) for _ in range(size + (c < more))]
    assert [r.chunk for r in got] == want


def test_chunks(spark):
    sizes = [r["count"] for r in collections.split_into_chunks(spark.range(10), 4, "id").groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [3, 3, 2, 2]


def test_array_helpers(spark):
    a, b = F.array(*map(F.lit, [1, 1, 2])), F.array(*map(F.lit, [1, 3, 3, 4]))
    assert one(spark, collections.intersection(a, b)) == [1, 1] and one(spark, collections.union(a, b)) == [1, 1, 2, 3, 4]
    assert one(spark, collections.filter_map(b, lambda x, i: x * i, lambda x, i: x == 3)) == [3, 6]
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("j", 1, "c")], "key string, n int, v string")
    assert sorted((r.key, r.v) for r in collections.last_wins(rows, "key", "n").collect()) == [("j", "c"), ("k", "b")]


