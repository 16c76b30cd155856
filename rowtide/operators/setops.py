"""Set operations on key lists, without regard to case, keeping multiplicity.

Results are counted: one row per spelling with ``copies``, the number of times
it occurs. Both sides are grouped before they meet, so a value that fills a
third of a list costs one row per map task, and an intersection of two heavy
values is a product of two counts and not of their rows. ``expand_copies``
writes the copies out where that is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _spellings(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "__k", F.lower("value")
    )


def _same(left: DataFrame, right: DataFrame):
    return left["__k"].eqNullSafe(right["__r"])


def set_union_ci(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Left as it is, plus one copy of each right value that left lacks (of
    several spellings the smallest)."""
    kept = _spellings(left, column)
    keys = kept.select(F.col("__k").alias("__r")).distinct()
    extra = right.groupBy(F.lower(column).alias("__k")).agg(F.min(column).alias("value"))
    extra = extra.join(keys, _same(extra, keys), "left_anti").withColumn("copies", F.lit(1).cast("bigint"))
    return kept.select("value", "copies").unionByName(extra.select("value", "copies"))


def set_intersect_ci(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Left values that right has, once for each matching right item."""
    kept = _spellings(left, column)
    matches = right.groupBy(F.lower(column).alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    return kept.join(matches, _same(kept, matches)).select(
        "value", (F.col("copies") * F.col("__n")).alias("copies")
    )


def set_difference_ci(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Left values that right lacks, multiplicity kept."""
    kept = _spellings(left, column)
    keys = right.select(F.lower(column).alias("__r")).distinct()
    return kept.join(keys, _same(kept, keys), "left_anti").select("value", "copies")


def expand_copies(counted: DataFrame) -> DataFrame:
    """Counted form -> one row per copy."""
    return counted.select("value", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("__i")).select(
        "value"
    )
