import re
from collections import Counter

import numpy as np
import pytest
from odd_texts import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm.line_dedup import PerfectHash, dedup_lines, dedup_lines_in_place


def brute(rows, min_docs, long_words=20, long_chars=100):
    """text, lines, repeated and removed of each (id, text), all by plain loops."""
    lines = [[] if t is None else t.split("\n") for _, t in rows]
    sizes = [sum(len(x) for x in ls if x.strip(" ")) for ls in lines]
    having = {}
    for i, ls in enumerate(lines):
        for k in {x.strip(" ") for x in ls} - {""}:
            having.setdefault(k, []).append(i)
    first = {k: min(((rows[i][0] is not None, rows[i][0] or 0), sizes[i]) for i in at) for k, at in having.items()}
    out = []
    for (own, t), ls, size in zip(rows, lines, sizes):
        me = (own is not None, own or 0)
        keys = [x.strip(" ") for x in ls]
        bad = [bool(k) and (len(having[k]) >= min_docs or len(having[k]) >= 2 and (len(k) >= long_chars or len(re.split("[ \t]+", k)) >= long_words)) for k in keys]
        other = [bool(k) and len(having[k]) >= 2 and first[k][0] != me for k in keys]
        goes = [b and o for b, o in zip(bad, other)]
        for owner in {first[k] for k, o in zip(keys, other) if o}:
            shared = sum(len(x) for x, k, o in zip(ls, keys, other) if o and first[k] == owner)
            third = sum(len(x) for x, k, b, o in zip(ls, keys, bad, other) if b and o and first[k] != owner)
            if 5 * shared >= 3 * (size - third + max(owner[1] - third, shared) - shared):
                goes = [g and first[k] != owner for g, k in zip(goes, keys)]
        out.append((own, t if not any(goes) else "\n".join(x for x, g in zip(ls, goes) if not g), sum(map(bool, keys)), sum(bad), sum(goes)))
    return out


PASSAGE = " ".join(f"w{i}" for i in range(25))
STORY = "\n".join(f"line {i} of a story that is told more than once" for i in range(12))
TEXTS = (
    ODD + [f"own line {i} that is longer than the rest\nshared\n shared \nrare {i // 4}" for i in range(12)] + ["copy one\ncopy two"] * 6
    + [STORY, STORY.replace("line 3", "verse 3"), STORY + "\nshared\n" + PASSAGE, f"mine\n {PASSAGE} ", f"short\n{PASSAGE}\nshared", STORY.replace("line 7", "verse 7") + "\n" + PASSAGE, "字" * 120, "字" * 120 + "\nmore", STORY[:200]]
)


@pytest.mark.parametrize("local_bytes,shard_lines", [(1 << 20, 1 << 20), (0, 1 << 20), (1 << 20, 5), (0, 5)])
def test_against_brute_force_by_both_ways(docs, local_bytes, shard_lines):
    rows = [*enumerate(TEXTS), (None, f"no id\nshared\n{PASSAGE}"), (3, "shared\nagain"), (3, "shared\nagain")]
    got = sorted(map(tuple, dedup_lines(docs(rows), 4, local_bytes, shard_lines).collect()), key=str)
    assert got == sorted(brute(rows, 4), key=str)


def test_in_place_keeps_columns_of_any_name_and_leaves_out_what_is_all_gone(docs):
    d = docs(TEXTS).withColumnRenamed("source", "n_lines").withColumnRenamed("lang", "a.b")
    out = dedup_lines_in_place(d, 4)
    assert out.columns == d.columns
    want = {i: t for i, t, n, _, gone in brute([*enumerate(TEXTS)], 4) if not gone or gone < n}
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.n_lines == "s" for r in got.values())


def test_passages_go_whatever_their_share_and_copies_stay_whole(docs):
    copies = [STORY, STORY, STORY.replace("line 3", "verse 3")]
    own = [f"document {x} says this of its own and nobody else {x}{x}" for x in "abc"]
    texts = [*copies, f"{own[0]}\n{PASSAGE}", f"{own[1]}\n{PASSAGE}", f"{PASSAGE}\n{own[2]}"]
    got = {r.doc_id: r.text for r in dedup_lines(docs(texts)).collect()}
    assert [got[i] for i in range(3)] == copies
    assert got[3] == texts[3] and got[4] == own[1] and got[5] == own[2] and len(PASSAGE) > len(own[1])


def test_repeated_rows_and_null_ids_and_no_rows(docs):
    out = dedup_lines(docs([(None, "own words here\nfoot"), (1, "other own words\nfoot"), (1, "other own words\nfoot")]), 3).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter({(None, "own words here\nfoot"): 1, (1, "other own words"): 2})
    assert dedup_lines(docs([])).collect() == []
    assert dedup_lines_in_place(docs([])).collect() == []


@settings(deadline=None, max_examples=40)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.uint64)
    h = PerfectHash.build(keys)
    assert sorted(h(keys).tolist()) == list(range(len(keys)))


def test_perfect_hash_with_keys_no_level_parts():
    keys = np.arange(5, dtype=np.uint64)
    h = PerfectHash(np.zeros(0, np.int64), np.zeros(0, np.uint64), keys)
    assert h(keys[::-1]).tolist() == [4, 3, 2, 1, 0] and h(np.array([9], np.uint64)).tolist() == [-1]


def test_threshold_must_fit_the_counts(docs):
    with pytest.raises(ValueError):
        dedup_lines(docs(["a"]), 70_000)
