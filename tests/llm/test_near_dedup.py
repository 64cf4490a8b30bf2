import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from odd_texts import ODD

from loam.llm.near_dedup import band_keys, dedup_pairs, keep_one_of_each, near_groups, signatures, similarity, weighted_shingles
from loam.llm.words import WORD


def bag(text, n=3):
    w = re.findall(WORD, (text or "").lower())
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (Counter([tuple(w)]) if w else Counter())


def exact(a, b):
    a, b = bag(a), bag(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a | b) for d in a if d in b)


def components(texts, threshold):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] and bag(texts[i]) or exact(texts[i], texts[j]) >= threshold:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def corpus(seed=1, n=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(r.choices(words, k=r.randint(30, 80))) for _ in range(n)]
    out = list(base)
    for t in base[:12]:
        for _ in range(r.randint(1, 4)):
            w = t.split()
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    return out + base[:5] + base[:2]


def test_similarity_is_the_formula():
    texts = [*corpus()[:6], *corpus()[40:52], "a b c", "a b", "", None, "a b c a b c a b c", "z z z z z z"]
    pairs = [(x, y) for x in texts for y in texts]
    got = similarity(pa.array([x for x, _ in pairs]), pa.array([y for _, y in pairs]), 3)
    assert np.allclose(got, [exact(x, y) for x, y in pairs])


def test_registers_agree_as_often_as_texts_are_similar():
    a, b = "x y z " * 5 + " ".join(f"p{i}" for i in range(40)), "x y z " * 3 + " ".join(f"p{i}" for i in range(25)) + " q r s"
    texts = pa.array([a, b], pa.large_string())
    row, sh, w = weighted_shingles(texts, 3)
    sig = signatures(row, sh, w, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - exact(a, b)) < 0.04


def test_signature_does_not_depend_on_the_batch():
    texts = corpus()[:20] + ["", "one", "one two"]
    whole = band_keys(pa.array(texts), 3, 8, 2).to_pylist()
    assert whole == [band_keys(pa.array([t]), 3, 8, 2).to_pylist()[0] for t in texts]
    assert whole[20] == [] and len(whole[21]) == 8


def test_groups_are_brute_force_s(docs):
    texts = corpus()
    want = components(texts, 0.5)
    out = dedup_pairs(docs(texts)).collect()
    root = {}
    for r in out:
        root[r.doc_id] = r.doc_id
        if r.near_id is not None:
            root[r.near_id] = r.doc_id
    same = [(i, j) for i in range(len(texts)) for j in range(i) if want[i] == want[j]]
    assert sum(root[i] == root[j] for i, j in same) >= 0.9 * len(same)
    assert all(want[i] == want[j] for i in range(len(texts)) for j in range(i) if root[i] == root[j])
    kept = sorted(r.doc_id for r in keep_one_of_each(docs(texts)).collect())
    assert kept == sorted({min(i for i in root if root[i] == v) for v in root.values()})


def test_a_bucket_of_unlike_documents_is_compared_across(docs):
    # one band of one row puts nearly all together; the exact check must still part and join them rightly
    texts = corpus(3, 14)
    _, roots = near_groups(docs(texts), 0.5, 3, 24, 1)
    by = {}
    for r in roots.collect():
        by.setdefault(r.root, []).append(r.node)
    distinct = sorted(set(texts))
    want = Counter(Counter(components(distinct, 0.5)).values())
    want.pop(1, None)
    assert Counter(len(v) for v in by.values()) == want


def test_odd_texts_all_stay(docs):
    d = docs(ODD)
    assert sorted(r.doc_id for r in keep_one_of_each(d).collect()) == list(range(len(ODD)))
    out = dedup_pairs(d).collect()
    assert len(out) == len(ODD) and all(r.near_id is None for r in out)


def test_null_ids_repeated_rows_clashing_columns_and_no_rows(docs):
    d = docs([(None, "a b c d e"), (3, "a b c d e"), (2, "a b c d f g h"), (2, "a b c d f g h"), (None, "k l m n o"), (None, None), (None, None)])
    d = d.withColumnRenamed("lang", "root").withColumnRenamed("source", "a.b")
    out = keep_one_of_each(d)
    assert out.columns == d.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter({(3, "a b c d e"): 1, (2, "a b c d f g h"): 1, (None, "k l m n o"): 1, (None, None): 2})
    pairs = Counter((r.doc_id, r.near_id) for r in dedup_pairs(d).collect())
    assert pairs == Counter({(3, None): 1, (2, 2): 1, (None, None): 3})
    assert keep_one_of_each(docs([])).collect() == [] and dedup_pairs(docs([])).collect() == []
