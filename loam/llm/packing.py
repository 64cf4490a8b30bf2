"""Packing documents into sequences by cutting-stock column generation.

A document's length is its number of words (runs of anything but white space).  Documents longer than
CAPACITY are cut into pieces of CAPACITY and a rest.  Piece lengths are rounded up to classes of GRAIN; the
histogram of classes, CAPACITY / GRAIN numbers at any scale, is all that reaches the driver.  There a
linear program over packing patterns is solved by column generation: the simplex's duals are the prices of
classes, a knapsack dynamic program finds the pattern worth most, until none is worth more than one
sequence.  Uses are rounded down and the classes left over are packed first-fit decreasing.  Pieces are then
ranked within their class, ranks are mapped to slots of patterns, and so every piece to its sequence.

Ranks come from counts per (class, part) summed on the driver and a row_number within each part, so no
class is ever sorted in one task.

Defined results: null, empty and blank texts have no words and are in no sequence; pieces are ranked by
doc_id (nulls first), a hash of the text and the piece's number, so equal rows tie harmlessly; an empty
table packs into no sequences; columns but doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.runtime import materialise

CAPACITY, GRAIN = 2048, 16
#: Rows of a class that one part of it holds, about.
PART_ROWS = 200_000

Pattern = tuple[tuple[int, int], ...]  # (class, how many), in order of class from large to small


def price(duals: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """The pattern of classes 1..size worth most within size units, by unbounded knapsack."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, int)
    for room in range(1, size + 1):
        worth = duals[1 : room + 1] + best[room - 1 :: -1][:room]
        c = int(np.argmax(worth))
        if worth[c] > best[room - 1] + 1e-12:
            best[room], took[room] = worth[c], c + 1
        else:
            best[room] = best[room - 1]
    pattern, room = Counter(), size
    while room > 0:
        if took[room]:
            pattern[int(took[room])] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[size]), dict(pattern)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination: threaded linear algebra libraries can hang in a driver that has started a JVM."""
    n = len(matrix)
    a = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        k = i + int(np.argmax(np.abs(a[i:, i])))
        a[[i, k]] = a[[k, i]]
        a[i] /= a[i, i]
        rest = a[:, i].copy()
        rest[i] = 0.0
        a -= np.multiply.outer(rest, a[i])
    return a[:, n:]


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def solve_patterns(demand: dict[int, int], size: int, tolerance: float = 1e-7, rounds: int = 20_000) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Patterns and their fractional uses that meet the demand with the least sequences, and that least number.

    Revised simplex: one basic column a class, first of equal items only; each round prices by knapsack,
    enters the best pattern and leaves by the ratio test, ties by the least row.
    """
    classes = sorted(c for c, d in demand.items() if d > 0)
    if not classes:
        return [], 0.0
    row = {c: i for i, c in enumerate(classes)}
    m = len(classes)
    basis: list[dict[int, int]] = [{c: size // c} for c in classes]
    d = np.array([demand[c] for c in classes], float)
    matrix = np.zeros((m, m))
    for j, p in enumerate(basis):
        for c, k in p.items():
            matrix[row[c], j] = k
    inverse = _inverse(matrix)
    x = _times(inverse, d)
    for turn in range(rounds):
        y = inverse.sum(axis=0)
        duals = np.zeros(size + 1)
        for c in classes:
            duals[c] = max(y[row[c]], 0.0)
        worth, pattern = price(duals, size)
        pattern = {c: k for c, k in pattern.items() if c in row}
        if worth <= 1 + tolerance:
            break
        column = np.zeros(m)
        for c, k in pattern.items():
            column[row[c]] = k
        u = _times(inverse, column)
        can = np.flatnonzero(u > 1e-9)
        ratio = x[can] / u[can]
        out = int(can[np.argmin(ratio)])
        step = max(float(ratio.min()), 0.0)
        x = x - step * u
        x[out] = step
        x = np.maximum(x, 0.0)
        matrix[:, out] = column
        basis[out] = pattern
        if turn % 50 == 49:
            inverse = _inverse(matrix)
            x = np.maximum(_times(inverse, d), 0.0)
        else:
            pivot = inverse[out] / u[out]
            inverse = inverse - np.multiply.outer(u, pivot)
            inverse[out] = pivot
    return [(p, float(v)) for p, v in zip(basis, x) if v > 1e-9], float(x.sum())


def _first_fit(left: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """First-fit decreasing over class counts; equal sequences are found together."""
    out = []
    left = {c: n for c, n in left.items() if n > 0}
    while left:
        room, pattern = size, {}
        for c in sorted(left, reverse=True):
            k = min(left[c], room // c)
            if k:
                pattern[c], room = k, room - k * c
        times = min(left[c] // k for c, k in pattern.items())
        out.append((pattern, times))
        for c, k in pattern.items():
            left[c] -= k * times
            if not left[c]:
                del left[c]
    return out


def plan_sequences(demand: dict[int, int], size: int) -> tuple[list[tuple[Pattern, int]], float]:
    """(pattern, how many sequences) that hold exactly the demand, and the linear program's bound."""
    left = dict(demand)
    plan: list[tuple[dict[int, int], int]] = []
    patterns, bound = solve_patterns(demand, size)
    for p, v in sorted(patterns, key=lambda t: -t[1]):
        times = min([int(v + 1e-9), *(left[c] // k for c, k in p.items())])
        if times > 0:
            plan.append((p, times))
            for c, k in p.items():
                left[c] -= k * times
    plan += _first_fit(left, size)
    return [(tuple(sorted(p.items(), reverse=True)), n) for p, n in plan], bound


def _pieces(docs: DataFrame, capacity: int, grain: int) -> DataFrame:
    """doc_id, key, piece, start, n_tokens, class, part-free: one row a piece."""
    words = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\\s+"), lambda w: w != ""))
    d = docs.select("doc_id", F.xxhash64("text").alias("key"), words.alias("n")).where("n > 0")
    d = d.select("doc_id", "key", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    size = F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity)
    return d.select("doc_id", "key", "piece", (F.col("piece") * capacity).cast("long").alias("start"), size.cast("long").alias("n_tokens"), F.ceil(size / grain).cast("int").alias("class"))


def pack(docs: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """sequence, doc_id, piece, start (the piece's first word), n_tokens, offset (its place in the sequence)."""
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    spark = docs.sparkSession
    pieces = materialise(_pieces(docs, capacity, grain))
    demand = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    schema = "sequence long, doc_id {0}, piece int, start long, n_tokens long, offset long".format(dict(docs.dtypes)["doc_id"])
    if not demand:
        return spark.createDataFrame([], schema)
    plan, _ = plan_sequences(demand, capacity // grain)

    # runs of ranks: of class c, ranks [low, high) go to sequences first + (rank - low) // each, from slot on
    runs, used, first = [], Counter(), 0
    for p, times in plan:
        slot = 0
        for c, k in p:
            runs.append((c, used[c], used[c] + k * times, first, k, slot))
            used[c] += k * times
            slot += k
        first += times
    runs.sort()
    table = spark.createDataFrame(runs, "class int, low long, high long, first long, each long, slot long")

    parts = max(1, -(-max(demand.values()) // PART_ROWS))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "key", "piece"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pieces.groupBy("class", "part").count().select("class", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    turn = Window.partitionBy("class", "part").orderBy("doc_id", "key", "piece")
    ranked = pieces.withColumn("turn", F.row_number().over(turn) - 1).join(sizes, ["class", "part"]).withColumn("rank", F.col("base") + F.col("turn"))
    placed = ranked.join(F.broadcast(table), "class").where("rank >= low AND rank < high")
    placed = placed.withColumn("sequence", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    placed = placed.withColumn("slot", F.col("slot") + F.pmod(F.col("rank") - F.col("low"), F.col("each")))
    fill = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("sequence", "doc_id", "piece", "start", "n_tokens", F.coalesce(F.sum("n_tokens").over(fill), F.lit(0)).cast("long").alias("offset"))
