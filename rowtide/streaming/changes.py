"""The row-change operators over feeds of change rows.

The state of a keyed table is kept as a base and a log: every micro-batch
writes, for each key it touches, the last change only, in a folder named after
its feed and the batch. Several feeds, or one that starts anew, may write to one
state: a feed is known by the id that Spark keeps in its checkpoint. Writing a
batch costs what the batch holds, however large the table is; a repeated batch
overwrites its own folder, so redelivery changes nothing. Reading folds the log
alone and puts it over the base; compaction turns both into a new base.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from rowtide.functions.cells import all_of, texts_present
from rowtide.operators.checks import breaks_check, outside_enum
from rowtide.operators.diff import DELETE
from rowtide.spec import CheckSpec, EnumSpec, ForeignKeySpec

FEED, BATCH = "feed", "batch"
QUERY_ID = "sql.streaming.queryId"


def last_changes(changes: DataFrame, pk: list[str], seq: str) -> DataFrame:
    """The change with the highest sequence number for each key; of equal numbers the
    greatest row, so a replay gives the same. Combined before the shuffle, so a
    key that is touched all the time costs one row per task."""
    others = [c for c in changes.columns if c not in pk]
    row = F.struct(*others)
    maps = any("map<" in changes.schema[c].dataType.simpleString() for c in others)
    order = F.struct(F.col(seq), F.to_json(row) if maps else row)
    last = changes.groupBy(*pk).agg(F.max_by(row, order).alias("__last"))
    return last.select(*pk, "__last.*").select(*changes.columns)


def _log(path: str) -> str:
    return os.path.join(path, "log")


def stream_apply_changes(
    changes: DataFrame, path: str, checkpoint: str, pk: list[str], seq: str = "seq"
) -> DataStreamWriter:
    """Writer that applies a stream of change rows to the table at ``path``.

    Rows hold the key, the values, ``op`` (I, U or D) and a sequence number; the
    highest number of a key wins, whatever order changes arrive in. The caller
    adds a trigger and starts it.
    """

    def write(batch: DataFrame, number: int) -> None:
        feed = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)
        feed = feed or hashlib.sha256(checkpoint.encode()).hexdigest()
        latest = last_changes(batch, pk, seq)
        latest.write.mode("overwrite").parquet(os.path.join(_log(path), f"{FEED}={feed}", f"{BATCH}={number}"))

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _read_log(spark: SparkSession, path: str, after: Mapping[str, int] | None) -> DataFrame | None:
    """Changes of the log, None before the first batch. ``after`` names, for each
    feed, a batch up to which the changes are not wanted."""
    try:
        log = spark.read.option("basePath", _log(path)).parquet(_log(path))
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    for feed, batch in (after or {}).items():
        log = log.filter((F.col(FEED) != feed) | (F.col(BATCH) > batch))
    return log.drop(FEED, BATCH)


def _latest(
    spark: SparkSession, path: str, pk: list[str], seq: str, base: DataFrame | None, after: Mapping[str, int] | None
) -> DataFrame:
    """Last change of each key, deletes included; base rows count as inserts."""
    log = _read_log(spark, path, after)
    if log is None and base is None:
        raise ValueError(f"{path} has no changes yet, and there is no base")
    if base is not None:
        if "op" not in base.columns:
            base = base.withColumn("op", F.lit("I"))
        if seq not in base.columns:
            base = base.withColumn(seq, F.lit(None).cast(log.schema[seq].dataType if log is not None else "bigint"))
    if log is None:
        return base
    latest = last_changes(log, pk, seq)
    if base is None:
        return latest
    columns = log.columns
    newer = latest.select(*[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__met"))
    same = all_of([F.col(k).eqNullSafe(F.col(f"__{k}")) for k in pk])
    # The base stays where it is if the folded log is small. A row without a number yields to every change.
    over = F.col("__met").isNotNull() & (F.col(seq).isNull() | (F.col(f"__{seq}") >= F.col(seq)))
    met = base.join(newer, same, "left").select(
        *[F.when(over, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c not in pk else F.col(c) for c in columns]
    )
    keys = base.select(*[F.col(k).alias(f"__{k}") for k in pk])
    return met.unionByName(latest.join(keys, same, "left_anti"))


def current_state(
    spark: SparkSession,
    path: str,
    pk: list[str],
    seq: str = "seq",
    base: DataFrame | None = None,
    after: Mapping[str, int] | None = None,
) -> DataFrame:
    """Rows of the table now: the base with the last change of each key over it.

    ``base`` has one row per key: the state before any change, or one written by
    :func:`compact`, whose positions are then passed as ``after`` to spare the
    changes it holds. Before the first batch the base is the state.
    """
    state = _latest(spark, path, pk, seq, base, after)
    return state.filter(F.col("op") != DELETE).drop("op")


def positions(spark: SparkSession, path: str) -> dict[str, int]:
    """The last batch of each feed in the log. One row per feed reaches the driver."""
    try:
        log = spark.read.option("basePath", _log(path)).parquet(_log(path))
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return {}
        raise
    last = log.groupBy(F.col(FEED).cast("string").alias(FEED)).agg(F.max(BATCH).cast("bigint").alias(BATCH))
    return {row[FEED]: row[BATCH] for row in last.collect()}


def compact(
    spark: SparkSession,
    path: str,
    target: str,
    pk: list[str],
    seq: str = "seq",
    base: DataFrame | None = None,
    after: Mapping[str, int] | None = None,
) -> dict[str, int]:
    """Write base and log as a new base at ``target``; returns the positions it holds.

    Sequence numbers and deletes are kept in it, so a late change still finds
    its place and cannot bring a deleted row back. Batches that arrive meanwhile
    count as not held, and reading a batch twice does no harm.
    """
    held = positions(spark, path)
    _latest(spark, path, pk, seq, base, after).write.mode("overwrite").parquet(target)
    return held


def retire(spark: SparkSession, path: str, held: Mapping[str, int]) -> int:
    """Removes the log folders whose batches a compacted base holds; returns their number.

    ``held`` is what :func:`compact` returned. To be called once readers use that base and
    those positions; batches that came later stay.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    settings, gone = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for feed, last in held.items():
        folder = hadoop.Path(os.path.join(_log(path), f"{FEED}={feed}"))
        store = folder.getFileSystem(settings)
        for status in store.listStatus(folder) if store.exists(folder) else ():
            name, _, number = status.getPath().getName().partition("=")
            if name == BATCH and number.isdigit() and int(number) <= last:
                gone += bool(store.delete(status.getPath(), True))
    return gone


# -- constraints --------------------------------------------------------------


def constraint_violations(
    rows: DataFrame,
    *,
    not_null: tuple[str, ...] = (),
    checks: tuple[CheckSpec, ...] = (),
    enums: dict[str, EnumSpec] | None = None,
    foreign_keys: tuple[tuple[ForeignKeySpec, DataFrame], ...] = (),
) -> DataFrame:
    """One row per row and broken constraint, for a table or a stream.

    Row rules need no state; foreign keys are a stream-static left join with the
    distinct parent keys.
    """
    broken: list[Column] = [F.when(F.col(c).isNull(), F.lit(f"{c}_not_null")) for c in not_null]
    broken += [F.when(breaks_check(k.predicate), F.lit(k.name)) for k in checks]
    broken += [F.when(outside_enum(F.col(c), e), F.lit(e.name)) for c, e in (enums or {}).items()]
    joined = rows
    for i, (fk, parent) in enumerate(foreign_keys):
        target = [F.col(t).alias(f"__p{i}_{j}") for j, t in enumerate(fk.target_columns)]
        known = parent.select(*target).distinct().withColumn(f"__found{i}", F.lit(True))
        match = all_of([F.col(c) == F.col(f"__p{i}_{j}") for j, c in enumerate(fk.columns)])
        joined = joined.join(known, match, "left_outer")
        complete = all_of([F.col(c).isNotNull() for c in fk.columns])
        broken.append(F.when(complete & F.col(f"__found{i}").isNull(), F.lit(fk.name)))
    return joined.select(*rows.columns, F.explode(texts_present(broken)).alias("constraint_name"))


def stream_constraint_check(rows: DataFrame, path: str, checkpoint: str, **rules) -> DataStreamWriter:
    """Writer that routes violations of a stream to the files at ``path``."""
    found = constraint_violations(rows, **rules)
    return (
        found.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def unreferenced(
    children: DataFrame,
    parents: DataFrame,
    fk: ForeignKeySpec,
    child_time: str,
    parent_time: str,
    *,
    before: str,
    after: str,
    bucket: str,
    delay: str,
) -> DataFrame:
    """Rows of a stream whose parent does not come in another stream, decided by event time.

    A parent counts from ``before`` ahead of the child to ``after`` behind it,
    where its time is taken as the end of the ``bucket`` it lies in, and
    ``after`` begins a bucket later. So a child that comes ahead of its parent
    waits, and is reported once both streams are ``delay`` past that span.
    Parents of one key and bucket are one row in the state, so a child meets a
    few rows at most, however often its key occurs. Keys with a NULL refer to
    nothing and do not move event time on; rows without a time, or later than
    ``delay``, are not judged.
    """
    target = [F.col(f"`{t}`").alias(f"__p{j}") for j, t in enumerate(fk.target_columns)]
    known = parents.select(*target, F.col(f"`{parent_time}`").alias("__at")).withWatermark("__at", delay)
    names = [f"__p{j}" for j in range(len(target))]
    known = known.select(*names, F.window("__at", bucket).alias("__span")).dropDuplicates([*names, "__span"])
    known = known.select(*names, F.window_time("__span").alias("__end"))
    rows = children.filter(all_of([F.col(f"`{c}`").isNotNull() for c in (*fk.columns, child_time)]))
    rows = rows.withWatermark(child_time, delay)
    ahead, behind, width = [F.expr(f"INTERVAL {x}") for x in (before, after, bucket)]
    at = rows[f"`{child_time}`"]
    match = all_of([rows[f"`{c}`"] == known[n] for c, n in zip(fk.columns, names, strict=True)])
    match = match & (known["__end"] >= at - ahead) & (known["__end"] <= at + behind + width)
    missing = rows.join(known, match, "left_outer").filter(F.col("__end").isNull())
    return missing.select(*children.columns, F.lit(fk.name).alias("constraint_name"))


def stream_reference_check(
    children: DataFrame, parents: DataFrame, fk: ForeignKeySpec, path: str, checkpoint: str, **times: str
) -> DataStreamWriter:
    """Writer that appends the rows of :func:`unreferenced` to the files at ``path``."""
    found = unreferenced(children, parents, fk, **times)
    return (
        found.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def run_available(writer: DataStreamWriter) -> None:
    """Process everything that is there and stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
