import math
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from odd_texts import ODD
from pyspark.sql import functions as F

from loam.llm import lm_score
from loam.llm.lm_score import FEW, Filter, _stretches, build_index, score, score_documents, suffix_array
from loam.llm.queries import queries
from loam.llm.words import WORD


def words(t):
    return re.findall(WORD, (t or "").lower())


def brute(corpus, own, query, alpha=1.0):
    """corpus of (id, text); own: (id, text) of what is left out."""
    docs = [words(t) for row in corpus for t in [row[1]] if row != own]
    total = sum(map(len, docs))
    q = words(query)
    if not q or not total:
        return (len(q), None, None, None, None)

    def count(run):
        return total if not run else sum(d[i : i + len(run)] == run for d in docs for i in range(len(d) - len(run) + 1))

    lps, ks, unseen = [], [], 0
    for t, w in enumerate(q):
        k = next(k for k in range(t, -1, -1) if count(q[t - k : t]))
        p = 1 / total
        for n in sorted({0, min(1, k), k}):
            p = (count(q[t - n : t + 1]) + alpha * p) / (count(q[t - n : t]) + alpha)
        lps.append(math.log(p))
        ks.append(k)
        unseen += not count([w])
    return (len(q), sum(lps) / len(q), unseen, sum(ks) / len(q), max(ks))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_sorts_suffixes(tokens):
    got = suffix_array(np.array(tokens, np.int64)).tolist()
    assert got == sorted(range(len(tokens)), key=lambda i: tokens[i:])


def test_suffix_array_of_long_repeats_and_large_numbers():
    t = np.array([5, 2**40, 5] * 300 + [1], np.int64)
    assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


LONG = " ".join(f"w{i % 97} v{i * i % 53}" for i in range(60))
CORPUS = [
    *ODD, "the cat sat on the mat", "the cat sat on the hat and the cat ran", "a dog sat on the mat", "on the mat the dog and the cat sat on the mat", "x y", "y x y x y x",
    LONG, LONG, LONG + " and more", "before " + LONG, LONG[:200] + " turned " + LONG[150:], "z " * 40, "z " * 30, "x y " * 25, "the cat sat on the mat",
]
CORPUS = [t for t in CORPUS if len(t or "") < 4000]


def same(r, want):
    n, lp, unseen, mean, most = want
    assert (r.n_words, r.n_unseen, r.max_context) == (n, unseen, most), (r, want)
    if lp is None:
        assert r.log_prob is r.perplexity is r.mean_context is None
    else:
        assert abs(r.log_prob - lp) < 1e-5 and abs(r.mean_context - mean) < 1e-5 and abs(r.perplexity - math.exp(-lp)) < 1e-3 * math.exp(-lp), (r, want)


@pytest.mark.parametrize("shard_words,block_words,groups,alpha", [(10, 1 << 20, 3, 1.0), (1 << 20, 30, 1, 0.3), (150, 100, 4, 1.0)])
def test_documents_are_scored_by_all_others(docs, shard_words, block_words, groups, alpha):
    rows = [*enumerate(CORPUS), (None, "the cat"), (None, "the cat"), (3, CORPUS[3]), (1, "the dog ran")]
    d = docs([*rows]).repartition(3)
    got = score(build_index(d, "doc_id", shard_words, groups), d, "doc_id", alpha, block_words, groups).collect()
    assert len(got) == len(rows)
    left = list(rows)
    for r in got:
        # rows with one id are told apart by what they should give
        fits = [x for x in left if x[0] == r.doc_id and len(words(x[1])) == r.n_words]
        for x in fits:
            try:
                same(r, brute(rows, x, x[1], alpha))
            except AssertionError:
                if x is fits[-1]:
                    raise
            else:
                left.remove(x)
                break
    assert not left


@settings(deadline=None, max_examples=5, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=8), st.integers(1, 40))
def test_any_documents_of_few_words(spark, docs, texts, shard_words):
    rows = list(enumerate(" ".join(t) for t in texts))
    d = docs(rows)
    for r in score(build_index(d, "doc_id", shard_words, 2), d, groups=2).collect():
        same(r, brute(rows, rows[r.doc_id], rows[r.doc_id][1]))


def test_queries_that_are_no_documents(spark, docs):
    asked = [*enumerate(["the cat sat on the mat", "the dog ran", "zebra", "", None, "x y x y x y x y", "mat. The; cat!", "word zebra word"])]
    q = spark.createDataFrame(asked, "item_id long, text string").repartition(3)
    rows = [(i + 100, t) for i, t in enumerate(CORPUS)]
    got = score(build_index(docs(rows), groups=2), q, "item_id", groups=2).collect()
    assert len(got) == len(asked)
    for r in got:
        same(r, brute(rows, None, dict(asked)[r.item_id]))


def test_shards_hold_what_queries_share_and_no_more(docs, monkeypatch):
    texts = [" ".join(f"d{i}w{j}" for j in range(800)) for i in range(40)]
    shared = " ".join(f"s{j}" for j in range(30))
    d = docs([f"{t} {shared} end{i}" if i in (0, 7, 9) else t for i, t in enumerate(texts)])
    size, drop = [], lm_score.drop_folder

    def weighed(spark, path):
        size.append(sum(p.stat().st_size for p in Path(path.removeprefix("file://")).rglob("*.parquet")))
        drop(spark, path)

    monkeypatch.setattr(lm_score, "drop_folder", weighed)
    got = {r.doc_id: r for r in score_documents(d, d.where("doc_id IN (0, 1)")).collect()}
    assert got[0].max_context == 30 and got[0].n_unseen == 801 and got[1].max_context == 0 and got[1].n_unseen == 800
    # the index of all words would take over 7 bytes a word
    assert sum(size) < 2 * 40 * 800


def test_queries_in_rounds_give_the_same(docs):
    rows = [*enumerate(t for t in CORPUS if len(t or "") < 300), (3, CORPUS[3])]
    d = docs(rows)
    whole, parts = (sorted(map(str, score(build_index(d, groups=3), d, groups=2, round_words=n).collect())) for n in (1 << 20, 250))
    assert whole == parts and len(whole) == len(rows)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_filter_misses_nothing(n):
    h = np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64)
    f = Filter.of(h)
    assert f.has(h).all() and f.has(h + np.uint64(2**60)).mean() < 0.3 if n else not f.has(np.arange(9, dtype=np.uint64)).any()


@given(st.sets(st.integers(0, 40)))
def test_stretches_are_brute_force_s(places):
    at = np.array(sorted(places), np.int64)
    begin, size, place, inner = _stretches(at)
    want, k = [], 0
    while k < len(at):
        e = k
        while e + 1 < len(at) and at[e + 1] == at[e] + 1:
            e += 1
        want.append((at[k], at[e] + FEW - at[k]))
        k = e + 1
    assert list(zip(begin, size)) == want
    assert place.tolist() == [b + i for b, n in want for i in range(n)] and place[inner].tolist() == at.tolist()


def test_a_query_of_twenty_thousand_words_that_the_corpus_has(docs):
    long = " ".join(f"u{i * i % 1013}v{i % 7}" for i in range(20_000))
    d = docs([long, "start " + long, "another one"])
    r = score_documents(d, d.where("doc_id = 0")).first()
    assert r.n_words == 20_000 and r.n_unseen == 0 and r.max_context == 19_999 and r.mean_context == 9_999.5


def test_no_corpus_or_no_queries_and_clashing_columns(spark, docs):
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    (r,) = score(build_index(docs([])), q, "item_id").collect()
    assert (r.n_words, r.log_prob) == (2, None)
    assert score(build_index(docs(["a"])), q.limit(0), "item_id").collect() == []
    d = docs(["a b", "a b c"]).select("*", F.lit(1).alias("q"), F.lit(2).alias("name"), F.lit("x").alias("block.n"))
    assert sorted(r.n_words for r in score_documents(d, d).collect()) == [2, 3]


def test_op4_scores_every_hundredth_document(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = queries()["op4_lm_score"](spark, "/root/testdata/sf0.001")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in d.where("doc_id % 100 = 0").collect())
