"""Benchmark decontamination by a prefix-filtered set join over windows.

An item's set is its distinct shingles of SHINGLE words.  A document holds an item if some window of as
many shingles as the item has, shares at least CONTAINMENT of the item's set.  The item's shingles are
ordered by rarity, counted over all documents; of s shingles, of which o must be shared, any such window
holds one of the s - o + 1 rarest, so only those are joined.  A document of fewer than o shingles is
passed by, an anchor with fewer than o of the item's shingles within an item's length either way is
dropped, and what is left is verified exactly, window by window.

Items travel to the documents, never texts through a shuffle.  Items beyond ITEM_BYTES of text are joined
in as many passes as it takes.

Defined results: an item or document of no words, or null, matches nothing; an item of fewer than SHINGLE
words matches nothing, being too short to be evidence; null ids are carried as null; repeated documents
and repeated items each give their own rows; of windows that share equally many, the first counts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.words import shingles, text_slices, word_hashes
from loam.runtime import text_batches

SHINGLE, CONTAINMENT = 5, 0.6
ITEM_BYTES = 8 << 20
_BITS = 22
_HIT = "array<struct<item: int, n_shared: int, n_item: int, start_word: int>>"


class Items:
    """The shingle sets of some benchmark items, and which shingle is in which items."""

    def __init__(self, ids: list, texts: list, n: int):
        self.n, self.ids, self.sets, self.lengths = n, [], [], []
        column = pa.array(texts, pa.string())
        for at, _, part in text_slices(column):
            words, rows = word_hashes(part)
            count = np.bincount(rows, minlength=len(part))
            sh, row, _ = shingles(words, rows, n)
            for i in np.flatnonzero(count >= n):
                own = sh[row == i]
                self.ids.append(ids[at + i])
                self.sets.append(np.unique(own))
                self.lengths.append(len(own))
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)

    def ordered(self, counts: dict[int, int], containment: float) -> None:
        """Needs and prefixes, once rarity is known."""
        self.need = [max(1, int(np.ceil(containment * len(s) - 1e-9))) for s in self.sets]
        pairs = []
        for i, (s, need) in enumerate(zip(self.sets, self.need)):
            rare = sorted(s.tolist(), key=lambda x: (counts.get(x, 0), x))[: len(s) - need + 1]
            pairs += [(x, i) for x in rare]
        pairs.sort()
        self.prefix = np.array([x for x, _ in pairs], np.uint64)
        self.prefix_item = np.array([i for _, i in pairs], np.int64)


def _sieve(keys: np.ndarray) -> np.ndarray:
    """A bit table that passes all of keys and few others."""
    table = np.zeros(1 << _BITS, bool)
    table[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return table


def _found(sh: np.ndarray, sieve: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sh of members of sorted keys, and the first place in keys of each."""
    at = np.flatnonzero(sieve[(sh >> np.uint64(64 - _BITS)).astype(np.int64)])
    where = np.minimum(np.searchsorted(keys, sh[at]), len(keys) - 1)
    ok = keys[where] == sh[at]
    return at[ok], where[ok]


def _best_window(places: np.ndarray, kinds: np.ndarray, length: int) -> tuple[int, int]:
    """Most distinct kinds among places within a window of that length, and the first such window's first place."""
    held: dict[int, int] = {}
    best = start = tail = 0
    for p, k in zip(places.tolist(), kinds.tolist()):
        held[k] = held.get(k, 0) + 1
        while p - places[tail] >= length:
            old = int(kinds[tail])
            held[old] -= 1
            if not held[old]:
                del held[old]
            tail += 1
        if len(held) > best:
            best, start = len(held), int(places[tail])
    return best, start


def _verify(sh: np.ndarray, anchors: np.ndarray, item: np.ndarray, length: int, need: int) -> tuple[int, int]:
    """Over one document's shingles: the best window that holds an anchor."""
    near = np.zeros(len(sh) + 1, np.int64)
    np.add.at(near, np.maximum(anchors - length + 1, 0), 1)
    np.add.at(near, np.minimum(anchors + length, len(sh)), -1)
    places = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    kinds = np.minimum(np.searchsorted(item, sh[places]), len(item) - 1)
    ok = item[kinds] == sh[places]
    places, kinds = places[ok], kinds[ok]
    if len(places) < need:
        return 0, 0
    return _best_window(places, kinds, length)


def match(texts: pa.Array, items: Items) -> list[list[dict]]:
    """For each text the items it holds."""
    out: list[list[dict]] = []
    sieve = _sieve(items.prefix)
    for at, to, part in text_slices(texts):
        own: list[list[dict]] = [[] for _ in range(to - at)]
        words, rows = word_hashes(part)
        sh, row, word = shingles(words, rows, items.n)
        if len(sh) and len(items.prefix):
            begin = np.searchsorted(row, np.arange(to - at + 1))
            spot, key = _found(sh, sieve, items.prefix)
            anchors: dict[tuple[int, int], list[int]] = {}
            for p, k in zip(spot.tolist(), key.tolist()):
                while k < len(items.prefix) and items.prefix[k] == sh[p]:
                    i = int(items.prefix_item[k])
                    if begin[row[p] + 1] - begin[row[p]] >= items.need[i]:
                        anchors.setdefault((int(row[p]), i), []).append(p)
                    k += 1
            for (r, i), ps in anchors.items():
                a, b = begin[r], begin[r + 1]
                best, start = _verify(sh[a:b], np.array(ps) - a, items.sets[i], items.lengths[i], items.need[i])
                if best >= items.need[i]:
                    own[r].append({"item": i, "n_shared": best, "n_item": len(items.sets[i]), "start_word": int(word[a + start] - word[a])})
        out += own
    return out


def _batches(benchmark: DataFrame, item_bytes: int) -> list[DataFrame]:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // item_bytes))
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    return [items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == i) if passes > 1 else items for i in range(passes)]


def _rarity(docs: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each of the items' shingles is."""
    keys, n = items.all, items.n
    if not len(keys):
        return {}

    def count(batches):
        sieve, total = _sieve(keys), np.zeros(len(keys), np.int64)
        for b in batches:
            for _, _, part in text_slices(b["text"]):
                sh, row, _ = shingles(*word_hashes(part), n)
                spot, key = _found(sh, sieve, keys)
                both = np.unique(row[spot] * len(keys) + key)
                total += np.bincount(both % len(keys), minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"shingle": keys[some].view(np.int64), "n": total[some]})

    counted = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {int(np.int64(r.shingle).view(np.uint64)): r.n for r in counted.collect()}


def _matchers(docs: DataFrame, benchmark: DataFrame, containment: float, n: int, item_bytes: int):
    """For each batch of items a UDF of text, and the batch's items."""
    text_batches(docs.sparkSession)
    for part in _batches(benchmark, item_bytes):
        t = part.toArrow()
        items = Items(t["item_id"].to_pylist(), t["text"].to_pylist(), n)
        items.ordered(_rarity(docs, items), containment)
        kind = pa.list_(pa.struct([("item", pa.int32()), ("n_shared", pa.int32()), ("n_item", pa.int32()), ("start_word", pa.int32())]))
        yield F.arrow_udf(lambda texts, items=items, kind=kind: pa.array(match(texts, items), kind), _HIT), items


def find_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, containment, n_shared, start_word: one row for each item that a document holds."""
    spark, parts = docs.sparkSession, []
    kind = dict(benchmark.dtypes)["item_id"]
    for udf, items in _matchers(docs, benchmark, containment, n, item_bytes):
        ids = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {kind}")
        hits = docs.select("doc_id", F.explode(udf(F.col("text"))).alias("h")).select("doc_id", "h.*")
        parts.append(hits.join(F.broadcast(ids), "item").select("doc_id", "item_id", F.round(F.col("n_shared") / F.col("n_item"), 6).alias("containment"), "n_shared", "start_word"))
    return reduce(DataFrame.unionByName, parts)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, n: int = SHINGLE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs that hold no item, with docs's own columns."""
    out = docs
    for udf, _ in _matchers(docs, benchmark, containment, n, item_bytes):
        out = out.where(F.size(udf(F.coalesce(F.col("text"), F.lit("")))) == 0)
    return out
