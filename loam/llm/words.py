"""Vectorised words, word hashes and shingles of Arrow string columns.

A word is a longest run of ASCII letters and digits and of other characters outside U+0080-U+00BF,
U+2000-U+2FFF and U+3000-U+303F (the blocks of signs), in lower case.  WORD is the same as a Python regex.
Hashes are 64 bits: a polynomial over a random byte table, finished by splitmix64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = "[0-9a-zÀ-῿぀-\U0010ffff]+"
#: Bytes of text worked on at once; one longer document is worked on alone.
CHUNK = 1 << 18

_U = np.uint64
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int, base: np.uint64, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if len(have) <= CHUNK * 2:
            _powers[name] = have
    return have[:n]


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, row after the last, lower-case texts); nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    n = len(column)
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield at, to, pc.utf8_lower(pc.fill_null(column.slice(at, to - at), ""))
        at = to


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of lower-case large_string texts without nulls: each word's hash, and the row it is in."""
    data, offsets = _bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = _IS_WORD[data]
    if data.max() >= 0xC2:
        for lead, second, length in ((0xC2, None, 2), (0xE2, None, 3), (0xE3, 0x80, 3)):
            at = np.flatnonzero(data == lead)
            if second is not None and len(at):
                at = at[data[at + 1] == second]
            for k in range(length if len(at) else 0):
                word[at + k] = False
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    filled = offsets[:-1] < offsets[1:]
    edge = offsets[:-1][filled]
    first[edge] = word[edge]
    edge = offsets[1:][filled] - 1
    last[edge] = word[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, side="right")))
        a, b = start[at], end[to - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLE[data[a:b]] * _power(b - a, _P, "p"), out=sums[1:])
        s = start[at:to] - a
        out[at:to] = (sums[end[at:to] - a] - sums[s]) * _power(b - a, _P_INV, "inv")[s]
        at = to
    return mix(out + (end - start).astype(np.uint64)), np.searchsorted(offsets, start, side="right") - 1


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k words in turn, their rows and the index of their first word.

    A row of fewer than k words has one shingle, of all its words; a row of none has none.
    """
    if not len(words):
        return words, rows, rows
    whole = np.zeros(len(words), np.uint64)
    m = len(words) - k + 1
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for j in range(k):
            acc = acc * _P + words[j : j + m]
        ok = np.flatnonzero(rows[:m] == rows[k - 1 :])
        full = mix(acc[ok])
    else:
        ok, full = np.zeros(0, np.int64), whole[:0]
    begin = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[begin, len(rows)])
    few = np.flatnonzero(count < k)
    if not len(few):
        return full, rows[ok], ok
    acc = np.zeros(len(few), np.uint64)
    for j in range(k - 1):
        has = count[few] > j
        acc[has] = acc[has] * _P + words[begin[few[has]] + j]
    at = np.r_[ok, begin[few]]
    order = np.argsort(at, kind="stable")
    return np.r_[full, mix(acc + _U(1))][order], rows[at[order]], at[order]
