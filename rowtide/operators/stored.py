"""States kept on disk so that later work touches only what changed.

Three layouts, each a plain folder of Parquet files:

co-located   bucketed by the key, so that two states, or a state and a change
             set, meet without moving a row
digested     one folder per key range, with a tree of digests beside it; the
             difference of two such states reads only the ranges whose digests
             differ, and compares those by value
partitioned  what :func:`rowtide.operators.partitions.write_partitioned` wrote;
             a change set rewrites only the folders that hold its keys
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowtide.functions.cells import all_of
from rowtide.operators.diff import DELETE, INSERT, TOMBSTONE, apply_change_set, change_set
from rowtide.operators.pairing import align_names, find_column, require_unique
from rowtide.operators.partitions import partition_name
from rowtide.spec import PartitionSpec

# -- co-located states --------------------------------------------------------

LAYOUT = "_layout"


def _quoted(names: list[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def write_colocated(df: DataFrame, path: str, pk: list[str], buckets: int = 256) -> None:
    """Write a state in ``buckets`` files by the hash of its key, sorted by it.

    The key is proved unique and free of NULLs on the way, so readers need no
    proof. One shuffle, paid once per state. ``path`` must be new or empty.
    """
    spark, name = df.sparkSession, f"rowtide_{uuid.uuid4().hex}"
    df = align_names(df, pk)
    laid = require_unique(df, pk, "state", null_keys=False).repartition(buckets, *[F.col(f"`{k}`") for k in pk])
    # The layout can only be declared through a table; its entry goes, its files stay.
    writer = laid.write.format("parquet").bucketBy(buckets, pk).sortBy(pk)
    writer.option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    layout = spark.createDataFrame([(buckets, pk)], "buckets int, pk array<string>").coalesce(1)
    layout.write.json(os.path.join(path, LAYOUT))


def read_colocated(spark: SparkSession, path: str) -> DataFrame:
    """A state from :func:`write_colocated`, with its layout known to Spark."""
    name = f"rowtide_{hashlib.sha256(path.encode()).hexdigest()[:32]}"
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema("buckets int, pk array<string>").json(os.path.join(path, LAYOUT)).first()
        columns, place = spark.read.parquet(path).schema.toDDL(), path.replace("\\", "\\\\").replace("'", "\\'")
        keys = _quoted(layout["pk"])
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) "
            f"INTO {layout['buckets']} BUCKETS LOCATION '{place}'"
        )
    return spark.table(name)


def colocated_change_set(old: DataFrame, new: DataFrame, pk: list[str], **options) -> DataFrame:
    """The change set of two co-located states with the same number of buckets:
    buckets meet where they are, without a shuffle."""
    return change_set(old, new, pk, on_duplicate="trust", null_keys=False, **options)


def write_colocated_changes(changes: DataFrame, path: str, pk: list[str], buckets: int = 256) -> None:
    """Write a change set in the layout of the state that it is for."""
    keys = [F.col(f"key.`{k}`").alias(k) for k in pk]
    rest = [F.col(c).alias(f"__{c}") for c in ("op", "changed", "after")]
    write_colocated(changes.select(*keys, *rest), path, pk, buckets)


def apply_colocated(state: DataFrame, changes: DataFrame, pk: list[str]) -> DataFrame:
    """The state after changes read by :func:`read_colocated`; one pass over both
    without a shuffle, inserts included.

    An update or delete of a key that the state lacks does nothing; an insert of
    a key that it has replaces the row.
    """
    state = align_names(state, pk)
    columns = [f.name for f in changes.schema["__after"].dataType.fields if f.name != "_"]
    here = state.withColumn("__here", F.lit(True))
    edits = changes.withColumnsRenamed({k: f"__c_{k}" for k in pk})
    same_key = all_of([here[f"`{k}`"] == edits[f"`__c_{k}`"] for k in pk])
    op = F.coalesce("__op", F.lit(""))
    kept = here.join(edits, same_key, "full_outer").filter(
        (op == INSERT) | (F.col("__here").isNotNull() & (op != DELETE))
    )
    values = []
    for c in columns:
        current = find_column(state, c)
        fresh = (op == INSERT) | F.coalesce(F.array_contains("__changed", c), F.lit(False))
        base = F.col(f"`{current}`") if current else F.lit(None)
        values.append(F.when(fresh, F.col("__after")[c]).otherwise(base).alias(c))
    return kept.select(*[F.coalesce(f"`{k}`", f"`__c_{k}`").alias(k) for k in pk], *values)


# -- digested states ----------------------------------------------------------

RANGE = "key_range"
FANOUT = 16
MOST_RANGES = 4096
ABOUT = "bounds array<bigint>, layout string"


def _position(df: DataFrame, pk: list[str]) -> Column:
    """Where a row stands among the ranges: an integer first key in its own
    order, so that neighbours share a range; any other key by its hash."""
    if isinstance(df.schema[pk[0]].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(f"`{pk[0]}`").cast("bigint")
    return F.xxhash64(*[F.col(f"`{k}`") for k in pk])


def _range_of(position: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the position (0 for NULL), found in two
    steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    group = F.size(F.filter(F.array(*[F.lit(g[0]) for g in groups]), lambda b: b <= position))
    inner = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    within = F.size(F.filter(F.element_at(inner, group), lambda b: b <= position))
    return F.when(position.isNull() | (position < bounds[0]), F.lit(0)).otherwise((group - 1) * step + within)


def _row_digests(df: DataFrame, tombstone: str) -> list[Column]:
    """Two hashes of a row with its column names and the places of its NULLs."""
    names = sorted((c for c in df.columns if c not in (RANGE, tombstone)), key=str.lower)
    cells = [F.col(f"`{c}`") for c in names]
    header = F.lit("\x01".join(n.lower() for n in names))
    whole = [header, *[c.isNull() for c in cells], *cells]
    return [F.xxhash64(*whole), F.xxhash64(F.lit(1), *whole)]


def write_digested(
    df: DataFrame, path: str, pk: list[str], ranges: int = 256, like: str | None = None, tombstone: str = TOMBSTONE
) -> None:
    """Write a state by key ranges, with the tree of their digests beside it.

    The ranges are those of the state at ``like``, else ``ranges`` of about
    equal size. A digest is the number of live rows and the sums of two hashes
    of theirs; a parent sums sixteen children. Tombstoned rows are kept and
    count as absent. The key is proved unique on the way. A range that one key
    value fills is written by several tasks.
    """
    if not 1 <= ranges <= MOST_RANGES:
        raise ValueError(f"ranges must lie between 1 and {MOST_RANGES}")
    spark, df = df.sparkSession, align_names(df, pk)
    flag = find_column(df, tombstone)
    if like is None:
        shares = [i / ranges for i in range(1, ranges)]
        found = df.agg(F.percentile_approx(_position(df, pk), shares, 10 * MOST_RANGES)).first()[0] if shares else None
        bounds = sorted(set(found or []))
    else:
        bounds = _about(spark, like)[0]
    proved = require_unique(df, pk, "state").withColumn(RANGE, _range_of(_position(df, pk), bounds))
    rows = os.path.join(path, "rows")
    proved.hint("rebalance", F.col(RANGE)).write.partitionBy(RANGE).parquet(rows)
    about = spark.createDataFrame([(bounds, proved.schema.json())], ABOUT).coalesce(1)
    about.write.parquet(os.path.join(path, "about"))

    stored = spark.read.schema(proved.schema).parquet(rows)
    live = stored.filter(~F.coalesce(F.col(f"`{flag}`"), F.lit(False))) if flag else stored
    first, second = _row_digests(stored, flag or tombstone)
    hashed = live.select(F.col(RANGE).alias("node"), first.alias("a"), second.alias("b"))

    def summed(level: DataFrame, node: Column, n: Column) -> DataFrame:
        total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("a", "b")]
        return level.groupBy(node.alias("node")).agg(n.alias("n"), *total)

    below = os.path.join(path, "digests", "level=0")
    summed(hashed, F.col("node"), F.count(F.lit(1))).coalesce(1).write.parquet(below)
    for level in range(1, _levels(len(bounds) + 1)):
        parents = summed(spark.read.parquet(below), F.floor(F.col("node") / FANOUT).cast("int"), F.sum("n"))
        below = os.path.join(path, "digests", f"level={level}")
        parents.coalesce(1).write.parquet(below)


def _levels(leaves: int) -> int:
    levels = 1
    while leaves > 1:
        leaves, levels = -(-leaves // FANOUT), levels + 1
    return levels


def _about(spark: SparkSession, path: str) -> tuple[list[int], T.StructType]:
    """Bounds of the ranges and schema of the rows, which an empty state has too."""
    row = spark.read.schema(ABOUT).parquet(os.path.join(path, "about")).first()
    return row["bounds"], T.StructType.fromJson(json.loads(row["layout"]))


def read_digested(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The state at ``path``; with ``only``, the rows of those ranges, from their folders alone."""
    df = spark.read.schema(_about(spark, path)[1]).parquet(os.path.join(path, "rows"))
    if only is not None:
        df = df.filter(F.col(RANGE).isin(only) if only else F.lit(False))
    return df.drop(RANGE)


def changed_ranges(spark: SparkSession, old: str, new: str) -> list[int]:
    """Ranges whose digests differ, found from the root down: a level is read
    under unequal parents only. At most one number per range reaches the driver."""
    bounds = _about(spark, old)[0]
    if bounds != _about(spark, new)[0]:
        raise ValueError(f"{new} was not written like {old}: their key ranges differ")
    nodes: list[int] | None = None
    for level in reversed(range(_levels(len(bounds) + 1))):
        sides = []
        for path in (old, new):
            side = spark.read.parquet(os.path.join(path, "digests", f"level={level}"))
            if nodes is not None:
                side = side.filter(F.floor(F.col("node") / FANOUT).isin(nodes))
            sides.append(side)
        o, n = sides[0].alias("o"), sides[1].alias("n")
        same = all_of([F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("n", "a", "b")])
        differ = o.join(n, F.col("o.node") == F.col("n.node"), "full_outer").filter(~same)
        nodes = sorted(r[0] for r in differ.select(F.coalesce("o.node", "n.node")).collect())
        if not nodes:
            return []
    return nodes or []


def incremental_change_set(spark: SparkSession, old: str, new: str, pk: list[str], **options) -> DataFrame:
    """The change set of two digested states, which reads only ranges that differ.

    Rows of those ranges are compared by value. A range that differs is passed
    over only if both 64-bit sums and the count agree by chance.
    """
    only = changed_ranges(spark, old, new)
    return change_set(
        read_digested(spark, old, only), read_digested(spark, new, only), pk, on_duplicate="trust", **options
    )


# -- partitioned states -------------------------------------------------------


def _first_file(spark: SparkSession, folder: str) -> str | None:
    """Least file name of a folder, None if there is no such folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(folder)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return min((s.getPath().getName() for s in store.listStatus(place)), default=None) if store.exists(place) else None


def _remove(spark: SparkSession, folder: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def touched_partitions(changes: DataFrame, spec: PartitionSpec, pk: list[str]) -> DataFrame:
    """Partitions that hold a changed row before or after, one row each.

    The partition column may be a key or a value; an update of it touches two.
    """
    if spec.column.lower() in [k.lower() for k in pk]:
        sides = F.array(partition_name(F.col(f"key.`{spec.column}`"), spec))
    else:
        before = F.when(F.col("op") != INSERT, partition_name(F.col(f"before.`{spec.column}`"), spec))
        after = F.when(F.col("op") != DELETE, partition_name(F.col(f"after.`{spec.column}`"), spec))
        sides = F.array(before, after)
    return changes.select(F.explode(sides).alias("part")).filter("part IS NOT NULL").distinct()


def apply_by_partition(
    spark: SparkSession, path: str, changes: DataFrame, spec: PartitionSpec, pk: list[str]
) -> list[str]:
    """Apply a written change set to a partitioned state in place; returns the
    partitions that were touched.

    Only folders with changed rows are read and written; the others keep their
    files. The new files are complete before any folder is replaced, so a lost
    executor does no harm. A folder that loses its last row goes. The change set
    must keep the columns, and one writer at a time may use the state.
    """
    touched = sorted(r["part"] for r in touched_partitions(changes, spec, pk).collect())  # bounded by the spec
    if not touched:
        return []
    stored = spark.read.parquet(path)
    state = stored.filter(F.col("part").isin(touched)).drop("part")
    after = apply_change_set(state, changes, pk)
    if sorted(after.columns) != sorted(state.columns):
        raise ValueError(f"the change set has other columns than {path}")
    folders = {p: os.path.join(path, f"part={p}") for p in touched}
    held = {p: _first_file(spark, f) for p, f in folders.items()}
    routed = after.select(*state.columns).withColumn("part", partition_name(F.col(f"`{spec.column}`"), spec))
    writer = routed.hint("rebalance", F.col("part")).write.partitionBy("part").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    for p, f in folders.items():
        if held[p] is not None and _first_file(spark, f) == held[p]:  # nothing took its place
            _remove(spark, f)
    spark.catalog.refreshByPath(path)
    return touched
