import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm.words import WORD, shingles, text_slices, word_hashes


def plain(text):
    return re.findall(WORD, (text or "").lower())


def hashes(texts, limit=2 << 20):
    out = [None] * len(texts)
    for at, to, part in text_slices(pa.array(texts, pa.string()), limit):
        w, r = word_hashes(part)
        for i in range(at, to):
            out[i] = w[r == i - at].tolist()
    return out


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab zA9.-\n«»éÉß漢—、 ñ", max_size=30)), max_size=8))
def test_words_are_the_regex_s(texts):
    got, names = hashes(texts, 16), {}
    for t, hs in zip(texts, got):
        words = plain(t)
        assert len(words) == len(hs)
        for w, h in zip(words, hs):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_a_word_longer_than_a_chunk():
    a, b = hashes(["q" * 3_000_000 + " z", "z " + "q" * 3_000_000])
    assert a == b[::-1]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="ab ", max_size=12), max_size=6), st.integers(1, 4))
def test_shingles(texts, k):
    column = pa.array(texts, pa.large_string())
    w, r = word_hashes(column)
    sh, row, at = shingles(w, r, k)
    names = {}
    want = []
    for i, t in enumerate(texts):
        words = plain(t)
        runs = [tuple(words[j : j + k]) for j in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
        want += [(i, x) for x in runs]
    assert row.tolist() == [i for i, _ in want]
    for (_, x), h in zip(want, sh.tolist()):
        assert names.setdefault(x, h) == h
    assert len(set(names.values())) == len(names)
    assert np.all(np.diff(at) > 0)
