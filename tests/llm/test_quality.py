import random
import re

import pytest
from odd_texts import ODD

from loam.llm import quality

LETTER = re.compile(r"[^\W\d_]")


def brute(text):
    t = text or ""
    words = [w for w in re.split("[ \t\n\r]+", t) if w]
    lines = [x for x in t.split("\n") if x.strip(" ")]
    m = {
        "n_chars": len(t), "n_words": len(words), "n_symbols": sum(c in "#%*&$|~^<>{}=\\" for c in t), "n_letters": sum(bool(LETTER.match(c)) for c in t), "n_upper": sum(c.isupper() for c in t),
        "n_digits": sum(c in "0123456789" for c in t), "n_exclaims": t.count("!"), "n_broken": t.count("�"), "n_repeats": sum(a == b for a, b in zip(words, words[1:])), "n_lines": len(lines), "n_distinct_lines": len(set(lines)),
    }
    w, n = m["n_words"], m["n_chars"]
    fails = {
        "no_words": w == 0, "symbols": w >= 5 and m["n_symbols"] > 0.3 * w, "shouting": m["n_letters"] >= 20 and m["n_upper"] > 0.6 * m["n_letters"], "repeated_words": w >= 10 and m["n_repeats"] > 0.3 * w,
        "repeated_lines": m["n_lines"] >= 4 and m["n_distinct_lines"] < 0.5 * m["n_lines"], "exclamations": w >= 10 and m["n_exclaims"] > 0.3 * w, "digits": n >= 20 and m["n_digits"] > 0.4 * n,
        "broken_encoding": m["n_broken"] > 0.01 * n, "tiny_words": w >= 10 and n < 2 * w,
    }
    return m, {k for k, v in fails.items() if v}


def texts():
    r = random.Random(8)
    kinds = ["abc", "ABC", "Straße", "12345", "#", "!!", "\n", "a", "x\n", "�", "ÑÉ", "漢字"]
    return ODD + [" ".join(r.choices(r.sample(kinds, 3), k=r.randint(1, 40))) for _ in range(150)] + ["WE SHOUT ALL OF THIS LOUDLY " * 3, "go " * 30, "same line\n" * 6, "7 " * 40]


def test_ledger_is_brute_force_s(docs):
    all_texts = texts()
    got = {r.doc_id: r for r in quality.quality_ledger(docs(all_texts)).collect()}
    assert len(got) == len(all_texts)
    seen = set()
    for i, t in enumerate(all_texts):
        m, fails = brute(t)
        assert {k: got[i][k] for k in quality.MEASURES} == m, t
        assert {n for n, b in quality.BIT.items() if got[i].failed & b} == fails, t
        for v, rules in quality.POLICIES.items():
            assert got[i][f"keep_{v}"] == (not fails & set(rules))
        seen |= fails
    assert seen == set(quality.BIT)


@pytest.mark.parametrize("version", ["v1", "v2"])
def test_filter_agrees_with_the_ledger(docs, version):
    d = docs(texts())
    kept = sorted(r.doc_id for r in quality.quality_filter(d, version).collect())
    assert kept == sorted(r.doc_id for r in quality.quality_ledger(d).where(f"keep_{version}").collect())


def test_ablation_is_brute_force_s(docs):
    fails = [brute(t)[1] for t in texts()]
    got = {(r.policy, r.rule): (r.n_failed, r.n_only, r.n_kept_without) for r in quality.quality_ablation(quality.quality_ledger(docs(texts()))).collect()}
    want = {}
    for v, rules in quality.POLICIES.items():
        for x in rules:
            of = [f & set(rules) for f in fails]
            want[v, x] = (sum(x in f for f in fails), sum(f == {x} for f in of), sum(not f - {x} for f in of))
    assert got == want


def test_a_new_policy_judges_a_ledger_made_before(spark, docs, tmp_path):
    fails = [brute(t)[1] for t in texts()]
    quality.quality_ledger(docs(texts())).drop("keep_v2").write.parquet(f"{tmp_path}/ledger")
    ledger, new = spark.read.parquet(f"{tmp_path}/ledger"), {"v3": ["digits", "tiny_words", "digits"], "none": []}
    for r in quality.judge(ledger, new).collect():
        assert r.keep_v3 == (not fails[r.doc_id] & set(new["v3"])) and r.keep_none
        assert r.keep_v1 == (not fails[r.doc_id] & set(quality.POLICIES["v1"]))
    got = {(r.policy, r.rule): (r.n_failed, r.n_only, r.n_kept_without) for r in quality.quality_ablation(ledger, new).collect()}
    of = [f & set(new["v3"]) for f in fails]
    assert got == {("v3", x): (sum(x in f for f in fails), sum(f == {x} for f in of), sum(not f - {x} for f in of)) for x in new["v3"]}
    assert set(quality.judge(ledger).columns) == set(ledger.columns) | {"keep_v2"}


def test_clashing_columns_null_ids_and_no_rows(docs):
    d = docs([(None, "plain words here"), (1, "plain words here"), (1, None)]).withColumnRenamed("lang", "failed").withColumnRenamed("source", "n_words")
    out = quality.quality_filter(d)
    assert out.columns == d.columns and sorted((str(r.doc_id), r.n_words) for r in out.collect()) == [("1", "s"), ("None", "s")]
    assert quality.quality_ledger(d).count() == 3
    assert quality.quality_ledger(docs([])).count() == 0 and quality.quality_filter(docs([])).count() == 0
    assert all(r.n_failed in (0, None) for r in quality.quality_ablation(quality.quality_ledger(docs([]))).collect())
