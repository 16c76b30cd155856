"""Modulo partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowtide.functions.text import zero_pad
from rowtide.spec import PartitionSpec

UNROUTABLE = "unroutable"


def partition_name(key: Column, spec: PartitionSpec) -> Column:
    """``partition_<key mod n>``, padded to the digits of n; a NULL key has no
    partition. The modulo is never negative, so every key finds a branch."""
    number = F.pmod(key, F.lit(spec.parts))
    return F.when(key.isNull(), F.lit(UNROUTABLE)).otherwise(
        F.concat(F.lit("partition_"), zero_pad(number, spec.parts))
    )


def modulo_partition(df: DataFrame, spec: PartitionSpec, name: str = "part") -> DataFrame:
    return df.withColumn(name, partition_name(F.col(spec.column), spec))


def partition_counts(df: DataFrame, spec: PartitionSpec) -> DataFrame:
    """Rows per partition and their share of the average, empty ones included."""
    counted = modulo_partition(df, spec).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    numbers = df.sparkSession.range(spec.parts).select(
        F.concat(F.lit("partition_"), zero_pad(F.col("id"), spec.parts)).alias("__part")
    )
    total = counted.filter(F.col("part") != UNROUTABLE).agg(F.sum("n").alias("total")).scalar()
    share = F.col("n") * spec.parts / total
    return (
        counted.join(numbers, F.col("part") == F.col("__part"), "full_outer")
        .select(F.coalesce("part", "__part").alias("part"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        .withColumn("skew", F.when(F.col("part") != UNROUTABLE, F.round(share, 6)))
    )


def write_partitioned(df: DataFrame, spec: PartitionSpec, path: str) -> None:
    """Write each partition to its own folder.

    The rebalance hint brings the rows of a partition together; from the
    measured sizes Spark then splits a heavy partition among several tasks and
    joins small ones, so no folder depends on one task.
    """
    routed = modulo_partition(df, spec)
    routed.hint("rebalance", F.col("part")).write.partitionBy("part").parquet(path)


def read_partition(spark: SparkSession, path: str, spec: PartitionSpec, key: int) -> DataFrame:
    """Rows with one key value. The folder filter follows from the key, which
    Spark cannot know by itself, so only that partition's files are read."""
    part = f"partition_{key % spec.parts:0{len(str(spec.parts))}d}"
    return spark.read.parquet(path).filter((F.col("part") == part) & (F.col(spec.column) == key))
