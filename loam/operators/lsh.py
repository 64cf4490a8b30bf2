"""Near-duplicate fingerprints: exact search within Hamming distance 3 by runs of equal bits.

A fingerprint is cut into blocks; two within the distance differ in at most that many of them, so they agree
in all the others.  Every choice of blocks that may agree is a table of keys to join on.  4 blocks make 4
tables of 16-bit keys; beyond FEW fingerprints, where such keys would repeat too often, 6 blocks make 20
tables of keys of 32 bits.  Both find the same pairs, all of them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.text import hamming
from loam.runtime import materialise

DISTANCE, FEW = 3, 1 << 21


def _block(fp: Column, i: int, blocks: int) -> tuple[Column, int]:
    """The i-th run of bits, from the least, and how many bits it has."""
    low, high = 64 * i // blocks, 64 * (i + 1) // blocks
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long")), high - low


def bands(prints: DataFrame, blocks: int = 4, distance: int = DISTANCE) -> DataFrame:
    """fp, band, chunk of each distinct fingerprint of prints(page_id, fp): a key for each choice of blocks - distance blocks."""
    keys = []
    for n, choice in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(0).cast("long")
        for i in choice:
            bits, width = _block(F.col("fp"), i, blocks)
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(F.struct(F.lit(n).alias("band"), key.alias("chunk")))
    return prints.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.band", "b.chunk")


def near_fingerprints(prints: DataFrame, distance: int = DISTANCE, few: int = FEW) -> DataFrame:
    """a < b: distinct fingerprints within the distance, 3 at most."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("distances up to 3 only")
    fps = materialise(prints.select("fp").where("fp IS NOT NULL").distinct())
    x = bands(fps, 4 if fps.count() <= few else 6)
    y = x.withColumnsRenamed({"fp": "other"})
    pairs = x.join(y, ["band", "chunk"]).where((F.col("fp") < F.col("other")) & (hamming(F.col("fp"), F.col("other")) <= distance))
    return pairs.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def near_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a < b: pages whose fingerprints are within the distance.  As many as there are: meant for small groups."""
    fps = near_fingerprints(prints, distance)
    both = fps.union(fps.select("b", "a")).union(prints.select("fp", "fp").distinct()).toDF("fp", "other")
    left, right = prints.select(F.col("page_id").alias("a"), "fp"), prints.select(F.col("page_id").alias("b"), F.col("fp").alias("other"))
    return left.join(both, "fp").join(right, "other").where("a < b").select("a", "b")


def page_edges(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges that join what near_pairs joins, but of pages with one fingerprint only to its least page."""
    least = prints.groupBy("fp").agg(F.min("page_id").alias("page_id"))
    same = prints.join(least.withColumnRenamed("page_id", "a"), "fp").where("page_id <> a").select("a", F.col("page_id").alias("b"))
    near = near_fingerprints(prints, distance).toDF("x", "y")
    ends = near.join(least.toDF("x", "a"), "x").join(least.toDF("y", "b"), "y").select("a", "b")
    return same.union(ends)


def already_known(new: DataFrame, known: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Rows of new(page_id, fp) with a near fingerprint in known(page_id, fp)."""
    x, y = bands(new), bands(known).withColumnRenamed("fp", "other")
    hit = x.join(y, ["band", "chunk"]).where(hamming(F.col("fp"), F.col("other")) <= distance).select("fp").distinct()
    return new.join(hit, "fp", "left_semi")
