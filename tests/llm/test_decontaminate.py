import math
import random
import re
from collections import Counter

import pytest
from odd_texts import ODD

from loam.llm.decontaminate import drop_leaks, find_leaks
from loam.llm.words import WORD


def runs(text, n):
    w = re.findall(WORD, (text or "").lower())
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def brute(doc, item, n, containment):
    """Shared shingles of the first best window, its place, or None."""
    d, i = runs(doc, n), runs(item, n)
    own, size = set(i), len(i)
    if not own:
        return None
    best, at = 0, 0
    for s in range(len(d)):
        k = len({x for x in d[s : s + size] if x in own})
        if k > best:
            best = k
    return best if best and best >= math.ceil(containment * len(own) - 1e-9) else None


def corpus():
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)]
    text = lambda k: " ".join(r.choices(vocabulary, k=k))
    items = [text(r.randint(6, 25)) for _ in range(12)] + ["too short", "", None, "v1 v1 v1 v1 v1 v1 v1 v1"]
    docs = [text(r.randint(0, 120)) for _ in range(30)]
    for _ in range(40):
        w = r.choice(items[:12]).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        cut = w[: r.randint(len(w) // 2, len(w))]
        docs.append(f"{text(r.randint(0, 40))} {' '.join(cut)} {text(r.randint(0, 40))}")
    return docs + ["v1 " * 40, "v1 V1, v1\nv1 v1 v1 v1 v1 v2"] + ODD, items


@pytest.mark.parametrize("containment,n,item_bytes", [(0.6, 5, 1 << 20), (0.6, 3, 100), (1.0, 5, 1 << 20), (0.3, 2, 1 << 20)])
def test_against_brute_force(spark, docs, containment, n, item_bytes):
    texts, items = corpus()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(d, i): k for d, t in enumerate(texts) for i, x in enumerate(items) if (k := brute(t, x, n, containment))}
    got = find_leaks(docs(texts), bench, containment, n, item_bytes).collect()
    assert {(r.doc_id, r.item_id): r.n_shared for r in got} == want and len(got) == len(want)
    for r in got:
        own = set(runs(items[r.item_id], n))
        there = runs(texts[r.doc_id], n)[r.start_word : r.start_word + len(runs(items[r.item_id], n))]
        assert len({x for x in there if x in own}) == r.n_shared
    kept = sorted(r.doc_id for r in drop_leaks(docs(texts), bench, containment, n, item_bytes).collect())
    assert kept == sorted(set(range(len(texts))) - {d for d, _ in want})


def test_null_ids_repeats_clashing_columns_and_no_rows(spark, docs):
    x = "a b c d e f g h"
    bench = spark.createDataFrame([(None, x), (1, x), (1, x)], "item_id long, text string")
    d = docs([(None, x), (5, x), (5, x), (6, "z")]).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "h")
    assert Counter((r.doc_id, r.item_id) for r in find_leaks(d, bench).collect()) == Counter({(None, None): 1, (None, 1): 2, (5, None): 2, (5, 1): 4})
    out = drop_leaks(d, bench)
    assert out.columns == d.columns and [r.doc_id for r in out.collect()] == [6]
    assert find_leaks(docs([]), bench).collect() == [] and find_leaks(d, bench.limit(0)).collect() == [] and drop_leaks(d, bench.limit(0)).count() == 4
