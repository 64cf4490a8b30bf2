"""Connected components of an edge list by alternating large-star and small-star rounds.

Every round is two shuffles by node and is written to the shared folder, so plans stay short and a lost
executor costs one round at most.  The number of rounds grows with the square of the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.runtime import materialise, release

MAX_ROUNDS = 50


def _hooked(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _rounds(edges: DataFrame) -> DataFrame:
    large = _hooked(edges.union(edges.select("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # large-star leaves each node under the least of its neighbourhood; the least itself needs no edge
    large = large.where("u <> v").distinct()
    small = _hooked(large)
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that an edge (a, b) names; root is the component's least node.

    Null ends and self-loops are dropped, repeated edges count once, no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL").where("u <> v").distinct()
    e = materialise(e)
    state = None
    for _ in range(MAX_ROUNDS):
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        last, e = e, materialise(_rounds(e))
        release(last)
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(e.select("v", "v").distinct().join(roots.select(F.col("node").alias("v")), "v", "left_anti").select("v", F.col("v").alias("root")))
