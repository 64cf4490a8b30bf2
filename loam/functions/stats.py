"""Summaries of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_plot(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """samples, smallest, q1, median, q3, largest, iqr, below, above of an integer column.

    Quartiles are medians of the halves, the middle of an odd number left out; of an even number of values the
    median is the truncated mean of the middle two, of none 0.  Only distinct values and their counts are ordered.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("long").alias("__v")).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"__to": F.sum("__n").over(upto), "__all": F.sum("__n").over(Window.partitionBy(*by))})
    v, n = F.col("__v"), F.col("__all")

    def at(i: Column) -> Column:
        return F.max(F.when((F.col("__to") - F.col("__n") <= i) & (i < F.col("__to")), v))

    def middle(first: Column, size: Column) -> Column:
        low, high = at(first + F.floor((size - 1) / 2)), at(first + F.floor(size / 2))
        return F.coalesce(((low + high) / 2).cast("long"), F.lit(0).cast("long"))

    half = F.floor(n / 2)
    out = counts.groupBy(*by).agg(
        F.sum("__n").alias("samples"), F.min(v).alias("smallest"), middle(F.lit(0), half).alias("q1"), middle(F.lit(0), n).alias("median"), middle(F.floor((n + 1) / 2), half).alias("q3"), F.max(v).alias("largest")
    )
    out = out.where("samples > 0").withColumn("iqr", F.col("q3") - F.col("q1"))
    keys = [F.col(c).alias(f"__{c}") for c in by]
    sides = counts.select(*keys, v.alias("__v"), F.col("__n")).join(out, [F.col(f"__{c}").eqNullSafe(F.col(c)) for c in by]) if by else counts.select("__v", "__n").crossJoin(out)
    return sides.groupBy(*out.columns).agg(*[F.sum(F.when(test, F.col("__n")).otherwise(0)).alias(name) for name, test in (("below", F.col("__v") < F.col("median")), ("above", F.col("__v") > F.col("median")))])


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with, for each name, the number of rows that meet its condition."""
    return df.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])


def as_table(summary: DataFrame) -> DataFrame:
    """A one-row summary as (metric, value) rows, for the console."""
    cols = summary.columns
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in cols])).alias("p")
    return summary.select(pairs).select("p.*")
