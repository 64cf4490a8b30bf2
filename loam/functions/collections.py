"""Collection helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.let import let
from loam.runtime import materialise


def filter_map(array: Column, value: Callable[[Column, Column], Column], keep: Callable[[Column, Column], Column]) -> Column:
    """value(x, i) of the elements for which keep(x, i), i from 0."""
    pairs = F.transform(array, lambda x, i: F.struct(value(x, i).alias("v"), keep(x, i).alias("k")))
    return F.transform(F.filter(pairs, lambda p: p["k"]), lambda p: p["v"])


def distinct_keys(array: Column) -> Column:
    return F.array_distinct(array)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order."""
    cols = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("__row"))
    return best.select(key, *[F.col("__row")[c].alias(c) for c in cols])


def _smaller(a: Column, b: Column) -> tuple[Column, Column]:
    first = F.size(a) < F.size(b)
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def intersection(a: Column, b: Column) -> Column:
    """Elements of the smaller array (of two as large, the second) that the other has; repeats stay."""
    small, large = _smaller(a, b)
    return let(large, lambda other: F.filter(small, lambda x: F.array_contains(other, x)))


def union(a: Column, b: Column) -> Column:
    """The smaller array with its repeats, then what only the larger has, once each."""
    small, large = _smaller(a, b)
    return F.concat(small, F.array_except(large, small))


def numbered(df: DataFrame, order: str, name: str) -> tuple[DataFrame, int]:
    """df with a column that numbers its rows from 0 in order, and how many there are.

    Rows are ranged into parts whose sizes are summed first, so no task sees all of them; equal rows of order
    are numbered in any order, nulls first.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = materialise(df.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in df.groupBy("__part").count().collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    base = df.sparkSession.createDataFrame(before, "__part int, __base long")
    turn = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return df.join(F.broadcast(base), "__part").withColumn(name, turn + F.col("__base")).drop("__part", "__base"), total


def split_into_chunks(df: DataFrame, n: int, order: str) -> DataFrame:
    """df with chunk 1..n: the first (rows mod n) chunks have one row more."""
    out, total = numbered(df, order, "__row")
    size, more = divmod(total, n)
    i = F.col("__row")
    late = F.lit(0) if not size else more + F.floor((i - more * (size + 1)) / size)
    chunk = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(late)
    return out.withColumn("chunk", (chunk + 1).cast("int")).drop("__row")
