import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_texts import ODD

from loam.llm import packing


def dots(r, n):
    return " ".join("w" for _ in range(n))


def check(texts, rows, capacity):
    """Every word of every text is once in a sequence, pieces don't overlap, sequences don't overflow."""
    want = Counter()
    for i, t in texts:
        n = len((t or "").split())
        want.update((i, k, k * capacity, min(capacity, n - k * capacity)) for k in range(math.ceil(n / capacity)))
    assert Counter((r.doc_id, r.piece, r.start, r.n_tokens) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence, []).append((r.offset, r.n_tokens))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(by) == list(range(len(by)))
    return len(by)


def best(items, size):
    """Fewest bins, by trying all."""
    items = sorted(items, reverse=True)
    least = [len(items)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(items):
            least[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] >= items[i]:
                bins[j] -= items[i]
                go(i + 1, bins)
                bins[j] += items[i]
        go(i + 1, [*bins, size - items[i]])

    go(0, [])
    return least[0]


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_plans_of_small_demands_are_near_the_best(items):
    plan, bound = packing.plan_sequences(Counter(items), 12)
    held = Counter()
    for p, n in plan:
        assert sum(c * k for c, k in p) <= 12 and n > 0
        for c, k in p:
            held[c] += k * n
    assert held == Counter(items)
    used, fewest = sum(n for _, n in plan), best(items, 12)
    assert math.ceil(bound - 1e-6) <= fewest <= used <= fewest + 1


def test_bound_is_the_linear_program_s():
    # 6s and 4s in 10s: pairs; 7s alone with 3s
    plan, bound = packing.plan_sequences({6: 100, 4: 100, 7: 50, 3: 50}, 10)
    assert abs(bound - 150) < 1e-6 and sum(n for _, n in plan) == 150


def test_inverse():
    a = np.random.default_rng(5).integers(0, 4, (60, 60)).astype(float) + np.eye(60)[::-1] * 9
    assert np.allclose(packing._inverse(a) @ a, np.eye(60))


def test_prices_are_the_best_knapsack():
    r = random.Random(3)
    for _ in range(30):
        size = r.randint(1, 12)
        duals = np.array([0.0] + [r.choice([0.0, r.random()]) for _ in range(size)])
        worth, pattern = packing.price(duals, size)
        table = [0.0] * (size + 1)
        for room in range(1, size + 1):
            table[room] = max(table[room - 1], *(duals[c] + table[room - c] for c in range(1, room + 1)))
        assert abs(worth - table[size]) < 1e-9 and abs(sum(duals[c] * k for c, k in pattern.items()) - worth) < 1e-9 and sum(c * k for c, k in pattern.items()) <= size


@pytest.mark.parametrize("seed", [1, 2])
def test_round_trip_and_fill(docs, seed):
    r = random.Random(seed)
    texts = [*enumerate(ODD), *((100 + i, dots(r, min(2000, int(r.lognormvariate(3.5, 1.2)) + 1))) for i in range(400))]
    rows = packing.pack(docs(texts), 256, 8).collect()
    used = check(texts, rows, 256)
    words = sum(len((t or "").split()) for _, t in texts)
    # grain rounds each piece up by 7 at most
    assert words / 256 <= used <= (words + 7 * len(rows)) / 256 + 4


def test_parts_of_a_class_do_not_matter(docs, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    texts = [(i % 50, "one two three") for i in range(80)] + [(None, "a b c d")] * 3
    rows = packing.pack(docs(texts), 16, 4).collect()
    assert len(rows) == 83 and check(texts, rows, 16) == math.ceil(83 / 4)


def test_no_rows_and_clashing_columns(docs):
    d = docs([(1, "a b"), (2, None)]).withColumnRenamed("lang", "sequence").withColumnRenamed("source", "class")
    assert [tuple(r) for r in packing.pack(d).collect()] == [(0, 1, 0, 0, 2, 0)]
    for empty in (docs([]), docs([None, " "])):
        out = packing.pack(empty)
        assert out.columns == ["sequence", "doc_id", "piece", "start", "n_tokens", "offset"] and out.count() == 0
    with pytest.raises(ValueError):
        packing.pack(d, 100, 16)
