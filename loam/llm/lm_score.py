"""Unbounded n-gram scores of texts from sharded suffix arrays of a corpus.

Queries are scored by all that *other* documents hold: what a row's own document (same id, same text) holds is never
counted, so documents of the corpus can be queries of it.

1. The queries' runs of up to FEW words are asked for: a filter of one bit a hash of them goes to every task.
2. Each partition of the corpus is read once.  How often it has the runs asked for is summed by run.  Its stretches
   all of whose runs of FEW words are asked for go to suffix-array shards of SHARD_WORDS words (words as numbers, ends
   between stretches, and the suffix array over them, a file in the shared folder): a run of FEW words or more that a
   query and the corpus share lies whole within such a stretch, so the shards hold all that a longer context can meet.
3. For every word of a query whose FEW words others have, the length of the longest run from there on, by binary search
   of the shards' suffix arrays, maxed over shards.  A run's parts occur wherever it does, so a word's longest matching
   context begins at the first word whose run reaches it.
4. How often that context, and that context with the word, occur: the sums of 2 where both are of FEW words at most,
   else ranges of the suffix arrays, summed over shards.

Counts are smoothed from the shortest context to the longest: p = (count(context, word) + ALPHA * p) / (count(context)
+ ALPHA), over the empty context, the word before, and the longest matching context, from p = 1 / N, N the words of
all other documents.  A count includes occurrences at the end of a document, which no word follows.

Work is in proportion to the corpus but for two parts: each ROUND_WORDS words of queries are a round, which reads the
corpus once (the filter's memory is bounded so), and blocks of queries look through all shards: a shard is asked only
for stretches of the queries whose runs of FEW words its own filter has, and the rest costs one look-up of a bit a word.

Defined results: null texts and texts without words have 0 words and null scores; each query row is scored alone and
repeated rows repeat, each scored without any of the rows alike in id and text; null ids are carried; where no other
document has a word all scores are null; an empty corpus or no queries are no error; texts of any length are matched
whole; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.words import mix, text_slices, word_hashes
from loam.runtime import drop_folder, materialise, release, shared_dir, text_batches

SHARD_WORDS, BLOCK_WORDS, GROUPS, ALPHA = 2_000_000, 1 << 19, 8, 1.0
#: Runs of this many words at most are counted by their hashes, and shards hold what has longer ones.
FEW = 6
#: Words of queries for which the corpus is read once; blocks of queries that search the shards together; runs a task sums before it sends them.
ROUND_WORDS, WIDE, SUMMED = 1 << 25, 16, 1 << 22
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_P = _U(_BASE)
#: Set runs of different lengths, and documents' names (the last), apart.
_SALTS = [_U(n * 0xD1B54A32D192ED03 % 2**64) for n in range(FEW + 2)]
#: Stands for the run of no words, which is as often there as words are.
_NONE = _U(0xA24BAED4963EE407)


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Of non-negative integers: first by as many as fit 63 bits, then by doubling, of which only ties are sorted again."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int32)
    bits = max(1, int(tokens.max() + 1).bit_length())
    h = max(1, 62 // bits)
    padded = np.r_[tokens.astype(np.int64) + 1, np.zeros(h, np.int64)]
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = (key << bits) | padded[j : j + n]
    order = np.argsort(key)
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    del key, padded
    starts = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    tied = ~(new & np.r_[new[1:], True])
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        key = rank[at] * (n + 2) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(new)
        rank[at] = np.repeat(slots[starts], np.diff(np.r_[starts, len(slots)]))
        slots = slots[~(new & np.r_[new[1:], True])]
        h *= 2
    return order.astype(np.int32)


@dataclass
class Index:
    """The corpus (name, text), and how its shards are cut and spread over folders; they are made for the queries."""

    corpus: DataFrame
    shard_words: int
    groups: int


def _room(sizes: np.ndarray) -> np.ndarray:
    """Words from each place on to its document's end."""
    return np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum()))


def _grams(words: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to FEW: the places that n words follow, and those words' hashes."""
    acc = np.zeros(len(words), _U)
    for n in range(1, FEW + 1):
        acc = acc[: max(len(words) - n + 1, 0)] * _P + words[n - 1 :]
        at = np.flatnonzero(room[: len(acc)] >= n)
        yield at, mix(acc[at] + _SALTS[n])


def _name_grams(names: np.ndarray) -> np.ndarray:
    return mix(mix(names.astype(np.int64).view(_U)) + _SALTS[FEW + 1])


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of places in turn, from each of which a run of FEW words is held: the first place of each stretch of neighbours, the stretch's
    words, the place of each of its words, and which of them are the places given."""
    head = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1]) if len(at) else at
    count = np.diff(np.r_[head, len(at)])
    begin, size = at[head], count + FEW - 1
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return begin, size, np.repeat(begin, size) + within, within < np.repeat(count, size)


class Filter:
    """One bit for the upper bits of a hash."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, _U(64 - (len(bits) * 8).bit_length() + 1)

    @classmethod
    def of(cls, hashes: np.ndarray) -> Filter:
        log = max(10, int(16 * len(hashes)).bit_length())
        flags = np.zeros(1 << log, bool)
        flags[(hashes >> _U(64 - log)).astype(np.int64)] = True
        return cls(np.packbits(flags, bitorder="little"))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


def _summed(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how many of each there are."""
    by = None if counts is None else np.argsort(hashes)
    hashes = np.sort(hashes) if by is None else hashes[by]
    head = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[head], np.diff(np.r_[head, len(hashes)]) if by is None else np.add.reduceat(counts[by], head) if len(head) else counts


def _by_bucket(hashes: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray]:
    """Of hashes in order: the buckets (their upper bits) that there are, and how many hashes each has."""
    bucket, size = np.unique((hashes >> _U(64 - log)).astype(np.int32), return_counts=True)
    return bucket, size


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def _put(path: str, row: dict) -> None:
    """A task that runs again writes the same; a file appears whole."""
    fs, p = _place(path)
    folder, _, name = p.rpartition("/")
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(part) as f:
        pq.write_table(pa.Table.from_pylist([row]), f, compression="zstd", use_dictionary=False)
    fs.move(part, p)


def _put_bytes(path: str, data: bytes) -> None:
    fs, p = _place(path)
    folder, _, name = p.rpartition("/")
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, p)


_filter_of: tuple[str, Filter] | None = None


def _read_filter(path: str, log: int, buckets: int) -> Filter:
    """The filter of all buckets, kept while a worker works on the same one."""
    global _filter_of
    if _filter_of is None or _filter_of[0] != path:
        _filter_of = None
        fs, p = _place(path)
        bits, each = np.zeros((1 << log) // 8, np.uint8), (1 << log) // 8 // buckets
        for info in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)):
            if info.is_file and info.base_name.isdigit():
                with fs.open_input_file(info.path) as f:
                    k = int(info.base_name) * each
                    bits[k : k + each] = np.frombuffer(f.read(), np.uint8)
        _filter_of = path, Filter(bits)
    return _filter_of[1]


def _shards(folders: list[str], hashes: np.ndarray, places: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
    """The folders' shards that have one of the hashes, one in memory at a time, each with the places whose hashes it has (but for
    one in thousands: the upper bits are looked up in its filter, then the lower 32 among its own)."""
    for path in folders:
        fs, p = _place(path)
        for info in sorted(fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)), key=lambda i: i.base_name):
            if info.is_file and info.extension == "parquet":
                with fs.open_input_file(info.path) as f:
                    file = pq.ParquetFile(f)
                    (seen,) = file.read(columns=["bits", "prints"]).to_pylist()
                    prints = np.frombuffer(seen["prints"], np.uint32)
                    maybe = np.flatnonzero(Filter(np.frombuffer(seen["bits"], np.uint8)).has(hashes))
                    low = hashes[maybe].astype(np.uint32)
                    here = places[maybe[prints[np.minimum(np.searchsorted(prints, low), len(prints) - 1)] == low]]
                    if len(here):
                        (row,) = file.read().to_pylist()
                        yield Shard(row), here


def make_shard(words: list[np.ndarray], sizes: list[np.ndarray], owners: list[np.ndarray]) -> dict:
    """Stretches' words in turn, how many each has, and each one's document's 64-bit name; every stretch gets an end mark of its own."""
    w, size = np.concatenate(words), np.concatenate(sizes).astype(np.int64)
    *_, (_, longest) = _grams(w, _room(size))
    vocabulary, ids = np.unique(w, return_inverse=True)
    n = len(size)
    # end marks differ and come before words, so that no two suffixes agree beyond a document
    tokens = np.insert(ids.astype(np.int64) + n, np.cumsum(size), np.arange(n)).astype(np.int32)
    order = suffix_array(tokens)
    return {"n": len(w), "vocabulary": vocabulary.tobytes(), "sizes": size.astype(np.int32).tobytes(), "owners": np.concatenate(owners).tobytes(), "tokens": tokens.tobytes(), "suffixes": _three(order), "bits": Filter.of(longest).bits.tobytes(), "prints": np.unique(longest.astype(np.uint32)).tobytes()}


def _three(order: np.ndarray) -> bytes:
    """32-bit numbers in three bytes where they fit."""
    raw = order.view(np.uint8).reshape(-1, 4)
    return raw[:, :3].tobytes() if len(order) < 1 << 24 else raw.tobytes()


class Shard:
    """The suffix array of some documents, and the runs of words in it."""

    def __init__(self, row: dict):
        get = lambda c, t: np.frombuffer(row[c], t)
        self.vocabulary, self.tokens = get("vocabulary", _U), get("tokens", np.int32)
        size = get("sizes", np.int32).astype(np.int64)
        self.docs, n = len(size), len(self.tokens)
        packed = get("suffixes", np.uint8)
        raw = np.zeros((n, 4), np.uint8)
        raw[:, : len(packed) // max(n, 1)] = packed.reshape(n, -1) if n else raw
        self.order = raw.view(np.int32).ravel()
        self.owners, inverse = np.unique(get("owners", np.int64), return_inverse=True)
        #: of each suffix in turn, which owner's document it begins in
        self.owner = np.repeat(inverse.astype(np.int32), size + 1)[self.order]
        self.bits = max(1, int(len(self.vocabulary) + self.docs + 1).bit_length())
        self.depth = 62 // self.bits
        padded = np.r_[self.tokens, np.full(self.depth, -1, np.int32)] + np.int32(1)
        self.keys = np.zeros(n, np.int64)
        for j in range(self.depth):
            self.keys <<= self.bits
            self.keys |= padded[j:][self.order]
        self._hash: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = _prefix_hashes(self.tokens.astype(np.int64))
        return self._hash


_powers_of: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _powers_of.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1), base, _U)
        p[0] = 1
        have = _powers_of[base] = np.multiply.accumulate(p)
    return have[:n]


def _prefix_hashes(tokens: np.ndarray) -> np.ndarray:
    return np.r_[_U(0), np.cumsum(mix(tokens.astype(_U) + _U(1)) * _powers(_BASE, len(tokens)), dtype=_U)]


class Search:
    """Query words, document after document, against one shard."""

    def __init__(self, shard: Shard, words: np.ndarray, sizes: np.ndarray, names: np.ndarray):
        self.shard, n = shard, len(words)
        v = shard.vocabulary
        at = np.minimum(np.searchsorted(v, words), max(len(v) - 1, 0))
        known = v[at] == words if len(v) else np.zeros(n, bool)
        self.ids = np.where(known, at + shard.docs, -1)
        ends = np.cumsum(sizes)
        # words from each place on that may match: to the document's end or the next unknown word
        stop = np.where(known, n, np.arange(n))
        stop = np.minimum.accumulate(stop[::-1])[::-1] if n else stop
        self.room = np.minimum(stop, np.repeat(ends, sizes)) - np.arange(n)
        where = np.minimum(np.searchsorted(shard.owners, names), max(len(shard.owners) - 1, 0))
        own = np.where(shard.owners[where] == names, where, -1) if len(shard.owners) else np.full(len(names), -1)
        self.group = np.repeat(own, sizes)
        asked = np.zeros(len(shard.owners), bool)
        asked[own[own >= 0]] = True
        at = np.flatnonzero(asked[shard.owner])
        self._own = np.sort(shard.owner[at].astype(np.int64) * (len(shard.order) + 1) + at)
        padded = np.r_[self.ids, np.zeros(shard.depth, np.int64)] + 1
        self.key = np.zeros(n, np.int64)
        for j in range(shard.depth):
            self.key = (self.key << shard.bits) | padded[j : j + n]
        #: places in order of their first words, and each place's turn in it
        self.by = np.argsort(self.key)
        self._hash: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = _prefix_hashes(self.ids)
        return self._hash

    def own(self, group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many suffixes of [lo, hi) are of the owner group; none for -1."""
        out = np.zeros(len(lo), np.int64)
        some = np.flatnonzero(group >= 0)
        g = group[some] * (len(self.shard.order) + 1)
        out[some] = np.searchsorted(self._own, g + hi[some]) - np.searchsorted(self._own, g + lo[some])
        return out

    def _short(self, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with the k words from each s, k within the keys' depth; quick where s go by their words."""
        shift = self.shard.bits * (self.shard.depth - k)
        low = self.key[s] >> shift << shift
        return np.searchsorted(self.shard.keys, low), np.searchsorted(self.shard.keys, low + (1 << shift))

    def _same(self, s: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the k words from each s are those from the corpus's at on."""
        h, n = self.shard.hashes, len(self.shard.tokens)
        ok = at + k <= n
        end = np.minimum(at + k, n)
        back = _powers(_INVERSE, max(n, len(self.ids)) + 1)
        return ok & ((h[end] - h[at]) * back[at] == (self.hashes[s + k] - self.hashes[s]) * back[s])

    def _agree(self, s: np.ndarray, at: np.ndarray, known: int, most: np.ndarray) -> np.ndarray:
        """How many words from each s on, most at most, agree with the corpus from at on; known do."""
        k, step = np.full(len(s), known), np.full(len(s), 1)
        up, live = np.ones(len(s), bool), np.arange(len(s))
        while len(live):
            want = k[live] + step[live]
            ok = want <= most[live]
            ok[ok] = self._same(s[live[ok]], at[live[ok]], want[ok])
            k[live[ok]] = want[ok]
            up[live] &= ok
            step[live] = np.where(up[live], step[live] * 2, step[live] // 2)
            live = live[step[live] > 0]
        return k

    def _place(self, s: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray, after: bool) -> np.ndarray:
        """Where in [lo, hi), which agree in depth words, the run of k words from s goes: before or after the suffixes that begin with it."""
        depth, tokens, order = self.shard.depth, self.shard.tokens, self.shard.order
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            at, q = order[mid].astype(np.int64), s[live]
            same = self._agree(q, at, depth, k[live])
            whole = same == k[live]
            there = at + same
            ends = there >= len(tokens)
            right = np.where(whole, after, ends | (tokens[np.where(ends, 0, there)] < self.ids[np.minimum(q + same, len(self.ids) - 1)]))
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def longest(self) -> np.ndarray:
        """For each word the longest run from it on that another's document has."""
        n, depth, sh = len(self.ids), self.shard.depth, self.shard
        best = np.zeros(n, np.int64)
        live = self.by[self.room[self.by] > 0]
        lo = hi = np.zeros(0, np.int64)
        for k in range(1, depth + 1):
            live = live[self.room[live] >= k]
            lo, hi = self._short(live, k)
            count = hi - lo - self.own(self.group[live], lo, hi)
            keep = count > 0
            live, lo, hi = live[keep], lo[keep], hi[keep]
            best[live] = k
        more = self.room[live] > depth
        s, lo, hi = live[more], lo[more], hi[more]
        if len(s):
            most, group = self.room[s], self.group[s]
            spot = self._place(s, lo, hi, most, False)
            for side in (-1, 0):
                at = spot + side
                own = np.flatnonzero((at >= lo) & (at < hi) & (group >= 0))
                own = own[sh.owner[at[own]] == group[own]]
                if len(own):
                    # runs of the owner's own suffixes are stepped over at once
                    at[own] = self._edges[0][at[own]] - 1 if side else self._edges[1][at[own]]
                ok = np.flatnonzero((at >= lo) & (at < hi))
                got = self._agree(s[ok], sh.order[at[ok]].astype(np.int64), depth, most[ok])
                best[s[ok]] = np.maximum(best[s[ok]], got)
        return best

    @property
    def _edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each suffix in turn, where the run of neighbours of one owner begins, and where it is over."""
        if not hasattr(self.shard, "edges"):
            o = self.shard.owner
            head = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            run = np.diff(np.r_[head, len(o)])
            self.shard.edges = np.repeat(head, run), np.repeat(head + run, run)
        return self.shard.edges

    def counts(self, s: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How often others' documents have the run of k words from each s."""
        if len(s):
            by = np.argsort(self.key[s])
            out = np.empty(len(s), np.int64)
            out[by] = self._counts(s[by], k[by])
            return out
        return np.zeros(0, np.int64)

    def _counts(self, s: np.ndarray, k: np.ndarray) -> np.ndarray:
        out, depth = np.zeros(len(s), np.int64), self.shard.depth
        can = (k > 0) & (k <= self.room[np.minimum(s, max(len(self.ids) - 1, 0))]) if len(self.ids) else np.zeros(len(s), bool)
        for d in range(1, depth + 1):
            i = np.flatnonzero(can & ((k == d) | ((k > d) & (d == depth))))
            if not len(i):
                continue
            lo, hi = self._short(s[i], d)
            deep = np.flatnonzero(k[i] > d)
            if len(deep):
                args = s[i[deep]], lo[deep], hi[deep], k[i[deep]]
                lo[deep], hi[deep] = self._place(*args, False), self._place(*args, True)
            out[i] = hi - lo - self.own(self.group[s[i]], lo, hi)
        return out


def _name(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"), text)


def build_index(corpus: DataFrame, doc_id: str = "doc_id", shard_words: int = SHARD_WORDS, groups: int = GROUPS) -> Index:
    """The corpus to be searched; shards go into as many folders as groups."""
    return Index(corpus.select("text", _name(F.col(f"`{doc_id}`"), F.col("text")).alias("name")), shard_words, groups)


def _flat(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Binary rows' numbers in one array, and how many each row has."""
    parts = [np.frombuffer(x.as_buffer(), kind) for c in column.chunks for x in c]
    return np.concatenate([*parts, np.zeros(0, kind)]), np.array([len(p) for p in parts], np.int64)


def _rows(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.split(values, np.cumsum(sizes)[:-1])] if len(sizes) else [], pa.binary())


def _over(parts: pa.Table, column: str, kind, sizes: np.ndarray, how) -> np.ndarray:
    """A column of rows in order, of which as many follow each other as there are groups, put together by how."""
    values = np.zeros(int(sizes.sum()), np.int64)
    step = len(parts) // max(len(sizes), 1)
    for k in range(step):
        one, _ = _flat(parts[column].take(np.arange(k, len(parts), step)), kind)
        values = how(values, one.astype(np.int64))
    return values


_COUNTS = [f"c{n}" for n in range(1, FEW + 1)]
_FIRST = f"q long, name long, {', '.join(f'{c} binary' for c in _COUNTS)}, own long, total long, pieces binary, cuts binary"
_CONTEXTS = f"q long, name long, block int, pieces binary, cuts binary, long binary, s binary, k binary, context binary, {', '.join(f'{c} binary' for c in _COUNTS)}, own long, total long"
_DONE = "q long, lp double, n_unseen long, mean_context double, max_context int"


def _asked(words: np.ndarray, sizes: np.ndarray, names: np.ndarray) -> np.ndarray:
    """All that a block of queries wants counted: its runs, its rows' own documents, and the words of the corpus."""
    return np.unique(np.concatenate([*(h for _, h in _grams(words, _room(sizes))), _name_grams(names), np.array([_NONE])]))


def _read_corpus(index: Index, path: str, log_bits: int, log_buckets: int) -> DataFrame:
    """bucket, hashes, counts of what is asked for; writes the shards of the stretches that queries share, into the index's folders."""
    shard_words, groups = index.shard_words, index.groups

    def read(batches):
        asked, part, number = _read_filter(f"{path}/filter", log_bits, 1 << log_buckets), TaskContext.get().partitionId(), 0
        words, sizes, owners, have = [], [], [], 0
        raw, raw_n, held, held_n, total = [], 0, [], 0, 0

        def write():
            _put(f"{path}/{(part + number) % groups}/{part}-{number}.parquet", make_shard(words, sizes, owners))

        def send():
            u, c = _summed(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
            bucket, size = _by_bucket(u, log_buckets)
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "hashes": _rows(u, size), "counts": _rows(c.astype(np.int64), size)})

        for b in batches:
            names = b["name"].to_numpy(zero_copy_only=False)
            for at, to, texts in text_slices(b["text"]):
                w, r = word_hashes(texts)
                total += len(w)
                room, acc = _room(np.bincount(r, minlength=to - at)), np.zeros(len(w), _U)
                live = np.arange(len(w))
                own = _name_grams(names[at:to])
                found = [own[asked.has(own)]]
                for n in range(1, FEW + 1):
                    live = live[room[live] >= n]
                    acc[live] = acc[live] * _P + w[live + n - 1]
                    h = mix(acc[live] + _SALTS[n])
                    hit = asked.has(h)
                    live = live[hit]
                    found.append(h[hit])
                    if n < FEW:  # a longer run's parts are asked for too
                        next_too = np.zeros(len(w) + 1, bool)
                        next_too[live] = True
                        live = live[next_too[live + 1]]
                raw += found
                raw_n += sum(map(len, found))
                if len(live):
                    begin, size, place, _ = _stretches(live)
                    words.append(w[place])
                    sizes.append(size)
                    owners.append(names[at + r[begin]])
                    have += len(place)
                if have >= shard_words:
                    write()
                    words, sizes, owners, have, number = [], [], [], 0, number + 1
                if raw_n >= SUMMED:
                    held.append(_summed(np.concatenate(raw)))
                    held_n += len(held[-1][0])
                    raw, raw_n = [], 0
                    if held_n >= SUMMED:
                        yield send()
                        held, held_n = [], 0
        held += [_summed(np.concatenate([*raw, np.zeros(0, _U)])), (np.array([_NONE]), np.array([total]))]
        yield send()
        if have:
            write()

    return index.corpus.mapInArrow(read, "bucket int, hashes binary, counts binary")


def _query_grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in turn: their pieces' words, each row's words, each piece's words, and where runs of FEW words begin, with their hashes."""
    pieces, sizes = _flat(table["pieces"], _U)
    cuts, _ = _flat(table["cuts"], np.int32)
    *_, (at, hashes) = _grams(pieces, _room(cuts.astype(np.int64)))
    return pieces, sizes, cuts, at, hashes


def _score_round(index: Index, q: DataFrame, n_words: int, alpha: float, block_words: int, groups: int) -> DataFrame:
    """q, lp and the other measures of queries (q, name, words), for which the corpus is read once."""
    spark, folders = q.sparkSession, index.groups
    path = shared_dir(spark)
    blocks = max(1, -(-n_words // block_words))
    log_buckets = max(3, (n_words * FEW >> 18).bit_length())
    log_bits = max(log_buckets + 3, (32 * n_words).bit_length())
    block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block")
    wide = F.pmod(F.col("block"), F.lit(-(-blocks // WIDE))).alias("wide")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")

    def ask(key, table):
        words, sizes = _flat(table["words"], _U)
        u = _asked(words, sizes, table["name"].to_numpy())
        bucket, size = _by_bucket(u, log_buckets)
        return pa.table({"block": pa.array(np.full(len(bucket), key[0].as_py()), pa.int32()), "bucket": pa.array(bucket, pa.int32()), "hashes": _rows(u, size)})

    def write_filter(key, table):
        hashes, _ = _flat(table["hashes"], _U)
        flags = np.zeros(1 << (log_bits - log_buckets), bool)
        flags[(hashes >> _U(64 - log_bits)).astype(np.int64) & (len(flags) - 1)] = True
        _put_bytes(f"{path}/filter/{key[0].as_py()}", np.packbits(flags, bitorder="little").tobytes())
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32())})

    def total(key, left, right):
        asked, sizes = _flat(left["hashes"], _U)
        u = np.unique(asked)
        hashes, _ = _flat(right["hashes"], _U)
        counts, _ = _flat(right["counts"], np.int64)
        at = np.searchsorted(u, hashes)
        ok = u[np.minimum(at, max(len(u) - 1, 0))] == hashes if len(u) else np.zeros(len(hashes), bool)
        sums = np.zeros(len(u), np.int64)
        np.add.at(sums, at[ok], counts[ok])
        return pa.table({"block": left["block"], "bucket": left["bucket"], "counts": _rows(sums[np.searchsorted(u, asked)], sizes)})

    def first(key, table, totals):
        table, names = (t := table.sort_by("q")), t["name"].to_numpy()
        words, sizes = _flat(table["words"], _U)
        u = _asked(words, sizes, names)
        counts, _ = _flat(totals.sort_by("bucket")["counts"], np.int64)
        of = lambda h: counts[np.searchsorted(u, h)]
        copies, corpus_words = of(_name_grams(names)), int(of(np.array([_NONE]))[0])
        row, few = np.repeat(np.arange(len(sizes)), sizes), []
        at = np.zeros(0, np.int64)
        for at, h in _grams(words, _room(sizes)):
            i = np.searchsorted(u, h)
            _, inverse, own = np.unique(row[at] * len(u) + i, return_inverse=True, return_counts=True)
            c = np.zeros(len(words), np.int64)
            c[at] = counts[i] - copies[row[at]] * own[inverse]
            few.append(c)
        begin, size, place, _ = _stretches(np.flatnonzero(few[-1]))
        per = np.bincount(row[begin], minlength=len(sizes))
        return pa.table({
            "q": table["q"], "name": table["name"], **{c: _rows(x, sizes) for c, x in zip(_COUNTS, few)}, "own": copies * sizes, "total": pa.array(np.full(len(sizes), corpus_words), pa.int64()),
            "pieces": _rows(words[place], np.bincount(row[place], minlength=len(sizes))), "cuts": _rows(size.astype(np.int32), per),
        })

    def find(key, table):
        table = table.sort_by("q")
        pieces, sizes, _, at, hashes = _query_grams(table)
        names = np.repeat(table["name"].to_numpy(), sizes)
        best = np.zeros(len(pieces), np.int32)
        for shard, here in _shards([f"{path}/{k}" for k in range(key[1].as_py(), folders, groups)], hashes, at):
            begin, size, place, inner = _stretches(here)
            got = Search(shard, pieces[place], size, names[begin]).longest()
            best[here] = np.maximum(best[here], got[inner])
        return pa.table({"q": table["q"], "best": _rows(best, sizes)})

    def contexts(key, table, parts):
        table, parts = table.sort_by("q"), parts.sort_by("q")
        n = len(table)
        few, sizes = [], np.zeros(0, np.int64)
        for c in _COUNTS:
            x, sizes = _flat(table[c], np.int64)
            few.append(x)
        pieces, per_row = _flat(table["pieces"], _U)
        best = sum((x > 0).astype(np.int64) for x in few)
        places = np.flatnonzero(few[-1])
        *_, inner = _stretches(places)
        best[places] = _over(parts, "best", np.int32, per_row[per_row > 0], np.maximum)[inner]
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        t = np.arange(len(begin))
        # the first place whose run reaches the word: reaches never fall within a document, nor from one to the next
        s = np.maximum(np.minimum(np.searchsorted(t + best, t), t), begin)
        k = t - s
        long = np.flatnonzero(k >= FEW)
        row = np.searchsorted(np.cumsum(sizes), long, side="right")
        per = np.bincount(row, minlength=n)
        in_pieces = np.zeros(len(t), np.int64)
        in_pieces[places] = np.flatnonzero(inner)
        return pa.table({
            "q": table["q"], "name": table["name"], "block": pa.array(np.full(n, key[0].as_py()), pa.int32()), "pieces": table["pieces"], "cuts": table["cuts"], "long": _rows((long - begin[long]).astype(np.int32), per),
            "s": _rows((in_pieces[s[long]] - (np.cumsum(per_row) - per_row)[row]).astype(np.int32), per), "k": _rows(k[long].astype(np.int32), per), "context": _rows(k.astype(np.int32), sizes),
            **{c: table[c] for c in _COUNTS}, "own": table["own"], "total": table["total"],
        })

    def count(key, table):
        table = table.sort_by("q")
        pieces, sizes, _, at, hashes = _query_grams(table)
        names = np.repeat(table["name"].to_numpy(), sizes)
        (s, per), (k, _) = (_flat(table[c], np.int32) for c in ("s", "k"))
        s, k = s + np.repeat(np.cumsum(sizes) - sizes, per), k.astype(np.int64)
        c, cw = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        for shard, here in _shards([f"{path}/{f}" for f in range(key[1].as_py(), folders, groups)], hashes, at):
            begin, size, place, inner = _stretches(here)
            inside = np.full(len(pieces), -1)
            inside[here] = np.flatnonzero(inner)
            some = np.flatnonzero(inside[s] >= 0)
            if not len(some):
                continue
            search = Search(shard, pieces[place], size, names[begin])
            got = search.counts(inside[s[some]], k[some])
            c[some] += got
            some = some[got > 0]
            cw[some] += search.counts(inside[s[some]], k[some] + 1)
        return pa.table({"q": table["q"], "c": _rows(c, per), "cw": _rows(cw, per)})

    def finish(key, left, right):
        left, right = left.sort_by("q"), right.sort_by("q")
        n = len(left)
        k, sizes = _flat(left["context"], np.int32)
        k = k.astype(np.int64)
        own, corpus_words = left["own"].to_numpy(), left["total"].to_numpy()
        few = [np.repeat(corpus_words - own, sizes)] + [_flat(left[c], np.int64)[0] for c in _COUNTS]
        long, per = _flat(left["long"], np.int32)
        long = long + np.repeat(np.cumsum(sizes) - sizes, per)

        def level(p, j, where):
            """Smoothed by the context of j words before: counts of runs are kept at their first word."""
            some = np.flatnonzero(where)
            p[some] = (few[j + 1][some - j] + alpha * p[some]) / (few[j][some - j] + alpha)

        with np.errstate(divide="ignore", invalid="ignore"):
            p = 1 / few[0].astype(float)
            level(p, 0, k >= 0)
            level(p, 1, k >= 1)
            for j in range(2, FEW):
                level(p, j, k == j)
            held = per[per > 0]
            p[long] = (_over(right, "cw", np.int64, held, np.add) + alpha * p[long]) / (_over(right, "c", np.int64, held, np.add) + alpha)
            lp = np.log(p)
        ones = few[1]
        row = np.repeat(np.arange(n), sizes)
        some = (sizes > 0) & (corpus_words > own)
        mean = lambda x: np.bincount(row, x, minlength=n) / np.maximum(sizes, 1)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, row, k)
        column = lambda x, kind: pa.array(x, kind, mask=~some)
        return pa.table({"q": left["q"], "lp": column(mean(np.where(np.isfinite(lp), lp, 0.0)), pa.float64()), "n_unseen": column(np.bincount(row[ones == 0], minlength=n), pa.int64()), "mean_context": column(mean(k.astype(float)), pa.float64()), "max_context": column(most, pa.int32())})

    placed = q.select("q", "name", "words", block)
    asked = materialise(placed.groupBy("block").applyInArrow(ask, "block int, bucket int, hashes binary"))
    asked.groupBy("bucket").applyInArrow(write_filter, "bucket int").count()
    counted = _read_corpus(index, path, log_bits, log_buckets)
    totals = asked.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(total, "block int, bucket int, counts binary")
    begun = materialise(placed.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(first, _FIRST))
    release(asked)
    wanted = begun.where("octet_length(pieces) > 0").select("q", "name", "pieces", "cuts", block, every)
    found = wanted.groupBy(wide, "group").applyInArrow(find, "q long, best binary")
    known = materialise(begun.withColumn("block", block).groupBy("block").cogroup(found.withColumn("block", block).groupBy("block")).applyInArrow(contexts, _CONTEXTS))
    release(begun)
    wanted = known.where("octet_length(long) > 0").select("q", "name", "pieces", "cuts", "s", "k", "block", every)
    ranges = wanted.groupBy(wide, "group").applyInArrow(count, "q long, c binary, cw binary").withColumn("block", block)
    done = materialise(known.groupBy("block").cogroup(ranges.groupBy("block")).applyInArrow(finish, _DONE))
    release(known)
    drop_folder(spark, path)
    return done


def score(index: Index, queries: DataFrame, query_id: str = "doc_id", alpha: float = ALPHA, block_words: int = BLOCK_WORDS, groups: int = GROUPS, round_words: int = ROUND_WORDS) -> DataFrame:
    """query_id, n_words, log_prob (mean, natural), perplexity, n_unseen (words no other document has), mean_context and
    max_context (words of the longest matching context): one row a query."""
    text_batches(queries.sparkSession)
    id_type = queries.select(f"`{query_id}`").schema[0].dataType

    def cut(batches):
        for b in batches:
            words: list[bytes] = []
            for at, to, texts in text_slices(b["text"]):
                w, r = word_hashes(texts)
                words += [x.tobytes() for x in np.split(w, np.searchsorted(r, np.arange(1, to - at)))]
            yield pa.RecordBatch.from_arrays([b["id"], b["name"], pa.array(words, pa.binary()), pa.array([len(w) // 8 for w in words], pa.int64())], ["id", "name", "words", "n"])

    named = queries.select(F.col(f"`{query_id}`").alias("id"), _name(F.col(f"`{query_id}`"), F.col("text")).alias("name"), "text")
    q = materialise(named.mapInArrow(cut, f"id {id_type.simpleString()}, name long, words binary, n long").withColumn("q", F.monotonically_increasing_id()))
    n_words = q.agg(F.sum("n")).first()[0] or 0
    rounds = max(1, -(-n_words // round_words))
    turn = F.pmod(F.xxhash64(F.lit("round"), "q"), F.lit(rounds))
    done = [_score_round(index, q.where(turn == i), n_words // rounds, alpha, block_words, groups) for i in range(rounds)]
    out = q.select("q", F.col("id").alias(query_id), F.col("n").alias("n_words")).join(reduce(DataFrame.unionByName, done), "q")
    out = materialise(out.select(query_id, "n_words", F.round("lp", 6).alias("log_prob"), F.round(F.exp(-F.col("lp")), 4).alias("perplexity"), "n_unseen", F.round("mean_context", 6).alias("mean_context"), "max_context"))
    for x in (q, *done):
        release(x)
    return out


def score_documents(docs: DataFrame, queries: DataFrame, query_id: str = "doc_id") -> DataFrame:
    """The queries, rows of docs, each scored by all other documents."""
    return score(build_index(docs, query_id), queries, query_id)
