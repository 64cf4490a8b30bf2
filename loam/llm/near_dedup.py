"""MinHash near-dedup: ProbMinHash signatures, banding, exact verification, components.

A document is its shingles of SHINGLE words, each weighted by how often it occurs.  Each shingle is a
Poisson process whose rate is its weight: its arrivals fall into random registers, a register keeps the
earliest, and a shingle stops as soon as its next arrival is later than the document's latest register.
Two signatures agree in a register with the probability Jaccard similarity of the two documents.

Texts that are equal count as one from the start.  Documents that agree in all ROWS registers of one of
BANDS bands share a bucket.  In each bucket all are first verified against one of them, by the exact
similarity; then, in buckets that still hold documents of several components, a growing number of further
ones, PIVOTS times as many each round, are verified against those of other components, until none is left.
So every pair of candidates is either verified or already joined, without caps, while large groups of
copies cost as many pairs as they have members; no bucket is ever gathered in one row or task.  Of each
component of verified pairs the document with the least doc_id stays.

Defined results: a null text, or one without words, is near to none and stays; a text of fewer than
SHINGLE words has one shingle, of all its words; texts of any length are sketched and verified whole; null
ids come after all others when the one that stays is chosen; of equal rows of the one that stays one row
stays; empty tables give empty results; columns whose names begin with __loam_ are reserved, others may
have any name.  Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.words import mix, shingles, text_slices, word_hashes
from loam.operators.components import connected_components
from loam.runtime import materialise, release, small_side, text_batches

SHINGLE, BANDS, ROWS, THRESHOLD, PIVOTS = 3, 36, 4, 0.5, 32
_U = np.uint64
_STEP = _U(0xD1342543DE82EF95)


def weighted_shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case texts: row, hash and count of each distinct shingle of a row, in order of row."""
    sh, row, _ = shingles(*word_hashes(texts), n)
    if not len(sh):
        return row, sh, np.zeros(0, np.float64)
    order = np.argsort(sh ^ mix(row.astype(_U) + _U(1)))
    order = order[np.argsort(row[order], kind="stable")]
    sh, row = sh[order], row[order]
    first = np.flatnonzero(np.r_[True, (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])])
    return row[first], sh[first], np.diff(np.r_[first, len(sh)]).astype(np.float64)


def signatures(row: np.ndarray, sh: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """For n rows the shingle that each register keeps; 0 throughout for a row of none."""
    best = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, _U)
    empty = np.ones(n, bool)
    empty[row] = False
    time = np.zeros(len(sh))
    live = np.arange(len(sh))
    step, width = 0, 1
    while len(live):
        k = np.arange(step + 1, step + width + 1, dtype=_U) * _STEP
        r = mix(sh[live][:, None] + k[None, :])
        # 2 uses of one draw: the top 53 bits give the gap, a second mix the register
        gap = -np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live][:, None]
        at = time[live][:, None] + np.cumsum(gap, axis=1)
        latest = best.reshape(n, registers).max(axis=1)
        use = at < latest[row[live]][:, None]
        who = np.nonzero(use)
        x, e = at[use], live[who[0]]
        spot = row[e] * registers + ((mix(r[use] ^ _STEP) >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
        np.minimum.at(best, spot, x)
        won = best[spot] == x
        kept[spot[won]] = sh[e[won]]
        time[live] = at[:, -1]
        latest = best.reshape(n, registers).max(axis=1)
        live = live[at[:, -1] < latest[row[live]]]
        step += width
        width = min(2 * width, 64)
    kept = kept.reshape(n, registers)
    kept[empty] = 0
    return kept


def band_keys(texts: pa.Array, n: int, bands: int, rows: int) -> pa.Array:
    """For each text its bands' keys; none for a text without words."""
    parts, sizes = [], []
    for at, to, part in text_slices(texts):
        row, sh, w = weighted_shingles(part, n)
        sig = signatures(row, sh, w, to - at, bands * rows).reshape(to - at, bands, rows)
        key = np.zeros((to - at, bands), _U)
        for j in range(rows):
            key = mix(key * _STEP + sig[:, :, j])
        key = mix(key + np.arange(bands, dtype=_U)[None, :] * _STEP)
        has = np.zeros(to - at, bool)
        has[row] = True
        parts.append(key[has].view(np.int64).ravel())
        sizes.append(np.where(has, bands, 0))
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else [0], pa.int32()), pa.array(values, pa.int64()))


def similarity(left: pa.Array, right: pa.Array, n: int) -> np.ndarray:
    """Exact probability Jaccard similarity of each pair of texts: the sum, over shingles d that both have,
    of 1 / sum over all shingles e of max(a[e] / a[d], b[e] / b[d]); 0 where either has none."""
    out = np.zeros(len(left))
    for at, to, a, b in _paired(left, right):
        ra, sa, wa = weighted_shingles(a, n)
        rb, sb, wb = weighted_shingles(b, n)
        row, sh = np.r_[ra, rb], np.r_[sa, sb]
        order = np.lexsort((sh, row))
        row, sh = row[order], sh[order]
        first = np.r_[True, (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
        who = np.cumsum(first) - 1
        m = int(first.sum())
        x, y = np.zeros(m), np.zeros(m)
        is_left = order < len(ra)
        x[who[is_left]] = wa[order[is_left]]
        y[who[~is_left]] = wb[order[~is_left] - len(ra)]
        row = row[first]
        with np.errstate(divide="ignore"):
            ratio = x / y
        order = np.lexsort((ratio, row))
        row, x, y = row[order], x[order], y[order]
        begin = np.searchsorted(row, np.arange(to - at + 1))
        cx, cy = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(y)]
        i = np.flatnonzero((x > 0) & (y > 0))
        # e from i on have a larger ratio a / b than d = i, so a[e] / a[d] is the larger of the two
        share = 1.0 / ((cx[begin[row[i] + 1]] - cx[i]) / x[i] + (cy[i] - cy[begin[row[i]]]) / y[i])
        out[at:to] = np.bincount(row[i], share, minlength=to - at)
    return out


def _paired(left: pa.Array, right: pa.Array):
    for at, to, a in text_slices(left):
        for bt, bo, b in text_slices(right.slice(at, to - at)):
            yield at + bt, at + bo, a.slice(bt, bo - bt), b


def _near(threshold: float, n: int):
    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(similarity(a, b, n) >= threshold - 1e-12)

    return near


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """Those of materialised pairs (a, b) of text hashes that are near."""
    wanted = materialise(pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct())
    texts = texts.join(small_side(wanted, 16), "t", "left_semi")
    first = texts.groupBy("t").agg(F.first("text").alias("text"))
    first = materialise(first)
    a, b = first.select(F.col("t").alias("a"), F.col("text").alias("x")), first.select(F.col("t").alias("b"), F.col("text").alias("y"))
    return materialise(pairs.join(a, "a").join(b, "b").where(_near(threshold, n)(F.col("x"), F.col("y"))).select("a", "b"))


def _sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    sketch = F.arrow_udf(lambda t: band_keys(t, n, bands, rows), "array<bigint>")
    return docs.select("doc_id", F.xxhash64("text").alias("t"), sketch(F.col("text")).alias("keys"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t) of all rows of docs that have words, and (node, root) of texts near to another."""
    text_batches(docs.sparkSession)
    # filtered only once written: a filter below the write would have every text sketched twice
    sketch = materialise(_sketch(docs, n, bands, rows)).where(F.size("keys") > 0)
    texts = docs.select(F.xxhash64("text").alias("t"), "text")
    one = materialise(sketch.groupBy("t").agg(F.first("keys").alias("keys")))
    each = one.select("t", F.explode("keys").alias("key"))
    shared = materialise(each.groupBy("key").agg(F.min("t").alias("a"), F.max("t").alias("z")).where("a <> z").select("key", "a"))
    members = materialise(each.join(small_side(shared, 24), "key"))
    stars = materialise(members.where("a <> t").select("a", F.col("t").alias("b")).distinct())
    edges = _verified(stars, texts, threshold, n)
    roots = materialise(connected_components(edges))
    left, pivots = _mixed(members.select("key", "t"), roots), PIVOTS
    while left.take(1):
        turn = F.row_number().over(Window.partitionBy("key").orderBy("t"))
        first = materialise(left.withColumn("turn", turn).where(F.col("turn") <= pivots).select("key", F.col("t").alias("p"), F.col("root").alias("other")))
        across = left.join(first, "key").where("root <> other AND t > p").select(F.col("p").alias("a"), F.col("t").alias("b")).distinct()
        found = _verified(materialise(across.join(stars, ["a", "b"], "left_anti")), texts, threshold, n)
        if found.take(1):
            edges = materialise(edges.union(found))
            roots = materialise(connected_components(edges))
        done = first.groupBy("key").agg(F.max("p").alias("last"))
        left = _mixed(left.join(done, "key").where("t > last").select("key", "t"), roots)
        pivots *= PIVOTS
    return sketch.select("doc_id", "t"), roots


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, t, root) of the members of buckets that hold several components, materialised."""
    rooted = materialise(members.join(roots.select(F.col("node").alias("t"), "root"), "t", "left").select("key", "t", F.coalesce("root", "t").alias("root")))
    keys = materialise(rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key"))
    out = materialise(rooted.join(small_side(keys, 16), "key", "left_semi"))
    release(rooted)
    return out


def _members(docs: DataFrame, threshold: float, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, t, root, and kept: the doc_id and t of the row that stays, n_kept: how many rows are equal to it."""
    ids, roots = near_groups(docs, threshold, n, bands, rows)
    rooted = ids.join(roots.select(F.col("node").alias("t"), "root"), "t", "left").withColumn("root", F.coalesce("root", "t"))
    ranked = rooted.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("null_id"), F.col("doc_id"), F.col("t")))
    best = ranked.groupBy("root").agg(F.min("rank").alias("kept"), F.count("*").alias("n"))
    return materialise(ranked.join(best.where("n > 1"), "root").select("doc_id", "t", "root", "kept"))


def dedup_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, near_id: for each document that stays a row for each other document it stands for, or one with null.

    Every document is in the result once: as the doc_id of its own rows, or as another's near_id.
    """
    members = _members(docs.select("doc_id", "text"), threshold, n, bands, rows)
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("t") == F.col("kept.t"))
    pairs = members.where(~same).select(F.col("kept.doc_id").alias("doc_id"), F.col("doc_id").alias("near_id"))
    # equal rows of the one that stays, beyond the first
    again = members.where(same).groupBy("root", "doc_id").agg((F.count("*") - 1).alias("k")).where("k > 0")
    again = again.select("doc_id", F.explode(F.array_repeat(F.col("doc_id"), F.col("k").cast("int"))).alias("near_id"))
    grouped = members.select(F.col("doc_id").alias("__loam_id"), F.col("t").alias("__loam_t")).distinct()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"))
    alone = keyed.join(small_side(materialise(grouped), 32), F.col("doc_id").eqNullSafe(F.col("__loam_id")) & (F.col("t") == F.col("__loam_t")), "left_anti")
    return pairs.unionByName(again).unionByName(alone.select("doc_id", F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("near_id")))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs that stay, with docs's own columns."""
    members = _members(docs.select("doc_id", "text"), threshold, n, bands, rows)
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("t") == F.col("kept.t"))
    counts = members.groupBy("doc_id", "t").agg(F.max(same).alias("stays"), F.count("*").alias("n"))
    # what goes, and what stays of several equal rows
    marked = materialise(counts.where("NOT stays OR n > 1").select(F.col("doc_id").alias("__loam_id"), F.col("t").alias("__loam_t"), F.col("stays").alias("__loam_stays")))
    keyed = docs.withColumn("__loam_key", F.xxhash64("text"))
    own_columns = [F.col(f"`{c}`") for c in docs.columns]
    match = F.col("doc_id").eqNullSafe(F.col("__loam_id")) & (F.col("__loam_key") == F.col("__loam_t"))
    rest = keyed.join(small_side(marked, 40), match, "left_anti").select(*own_columns)
    twice = marked.where("__loam_stays")
    if not twice.take(1):
        return rest
    own = keyed.join(small_side(twice, 40), match, "inner")
    first = [F.first(F.col(f"`{c}`")).alias(c) for c in docs.columns]
    return rest.unionByName(own.groupBy("__loam_id", "__loam_t").agg(*first).select(*own_columns))
