"""Queries of states that are kept on disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.operators import diff, partitions, stored
from rowtide.plans.diff_queries import ORDER_KEY, ORDER_OPS, flat_orders, order_states
from rowtide.plans.fixtures import FIXTURES, frame, oracle
from rowtide.plans.registry import query
from rowtide.session import cut_lineage, scratch_path
from rowtide.spec import PartitionSpec

# A tenth of the keys, all neighbours, differ.
FIXTURES["ORD_LATE"] = """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
        o_totalprice, o_orderdate, o_orderpriority
    FROM orders
    WHERE o_orderkey % 10 <> 4 AND o_orderkey >= (SELECT 9 * max(o_orderkey) / 10 FROM orders)
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders
    WHERE o_orderkey % 10 <> 3 AND o_orderkey < (SELECT 9 * max(o_orderkey) / 10 FROM orders)
"""
CHANGED_ORDERS = f"SELECT * FROM ({ORDER_OPS}) AS c WHERE op <> 'N'"


@query("colocated_change_set", oracle("ORD_OLD ORD_NEW", CHANGED_ORDERS))
def _colocated_change_set(spark, sf_dir):
    sides = []
    for df in order_states(spark, sf_dir):
        path = scratch_path(spark, "colocated")
        stored.write_colocated(df, path, ORDER_KEY, buckets=16)
        sides.append(stored.read_colocated(spark, path))
    return flat_orders(stored.colocated_change_set(*sides, ORDER_KEY))


@query("apply_colocated", oracle("ORD_NEW", "SELECT * FROM ORD_NEW"))
def _apply_colocated(spark, sf_dir):
    old, new = order_states(spark, sf_dir)
    state, changes = scratch_path(spark, "colocated"), scratch_path(spark, "changes")
    stored.write_colocated(old, state, ORDER_KEY, buckets=16)
    stored.write_colocated_changes(diff.change_set(old, new, ORDER_KEY), changes, ORDER_KEY, buckets=16)
    return stored.apply_colocated(stored.read_colocated(spark, state), stored.read_colocated(spark, changes), ORDER_KEY)


@query("incremental_change_set", oracle("ORD_OLD ORD_LATE", CHANGED_ORDERS.replace("ORD_NEW", "ORD_LATE")))
def _incremental_change_set(spark, sf_dir):
    old, new = scratch_path(spark, "digested"), scratch_path(spark, "digested")
    stored.write_digested(frame(spark, sf_dir, "ORD_OLD"), old, ORDER_KEY, ranges=64)
    stored.write_digested(frame(spark, sf_dir, "ORD_LATE"), new, ORDER_KEY, like=old)
    return flat_orders(stored.incremental_change_set(spark, old, new, ORDER_KEY))


PART_SPEC = PartitionSpec("o_custkey", 16)
PART = "concat('partition_', lpad(CAST(((o_custkey % 16) + 16) % 16 AS VARCHAR), 2, '0'))"
MOVED = "CASE WHEN o_custkey % 16 = 3 AND o_orderkey % 5 = 0 THEN o_custkey + 4 ELSE o_custkey END AS o_custkey"


@query(
    "apply_by_partition",
    f"""
    WITH moved AS (SELECT o_orderkey, {MOVED}, o_totalprice FROM orders WHERE o_custkey % 16 <> 11)
    SELECT *, {PART} AS part FROM moved""",
)
def _apply_by_partition(spark, sf_dir):
    """One folder empties, rows move from another to a third; the rest keeps its files."""
    old = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    number = F.col("o_custkey") % 16
    target = F.when((number == 3) & (F.col("o_orderkey") % 5 == 0), F.col("o_custkey") + 4).otherwise(F.col("o_custkey"))
    new = old.filter(number != 11).withColumn("o_custkey", target)
    path = scratch_path(spark, "partitioned")
    partitions.write_partitioned(old, PART_SPEC, path)
    changes = cut_lineage(diff.change_set(old, new, ORDER_KEY))
    stored.apply_by_partition(spark, path, changes, PART_SPEC, ORDER_KEY)
    return spark.read.parquet(path)
