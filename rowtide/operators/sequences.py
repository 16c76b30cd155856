"""Generated keys and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.session import cut_lineage
from rowtide.spec import SequenceSpec, TableSpec
from rowtide.functions.types import is_serial

# monotonically_increasing_id() is the partition number shifted by this many
# bits, plus the row's position in the partition.
_POSITION_BITS = 33


def assign_serial(
    df: DataFrame, order: list, start: int = 1, name: str = "serial", step: int = 1, partitions: int | None = None
) -> DataFrame:
    """Dense generated key in the stated order, without a global window.

    Rows are range-partitioned and sorted, and that layout is made durable. The
    position of a row is then its place in its partition plus the sizes of the
    partitions before. Only those sizes, one number per partition, reach the
    driver. The order has to be total for the result to be reproducible. The sort
    has ``partitions`` parts, by default as many as the session's shuffles;
    choose them so that a part fits a task.
    """
    width = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(width, *order).sortWithinPartitions(*order)
    return number_as_ordered(ordered, name, start, step)


def number_as_ordered(ordered: DataFrame, name: str = "serial", start: int = 1, step: int = 1) -> DataFrame:
    """Numbers the rows of a sorted DataFrame where they stand.

    The layout is made durable first; its partitions are taken to be in order, as
    a sort leaves them.
    """
    ordered = cut_lineage(ordered)
    place = F.monotonically_increasing_id()
    numbered = ordered.withColumn("__place", place)
    part = F.shiftright("__place", _POSITION_BITS)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    offsets, total = [], 0
    for row in sorted(sizes, key=lambda r: r["part"]):
        offsets.append((row["part"], total))
        total += row["n"]
    if not offsets:
        return numbered.drop("__place").withColumn(name, F.lit(None).cast("bigint"))
    table = ordered.sparkSession.createDataFrame(offsets, "__part bigint, __offset bigint")
    position = F.col("__offset") + F.col("__place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (
        numbered.withColumn("__part", part.cast("bigint"))
        .join(F.broadcast(table), "__part")  # one row per partition of the sort
        .withColumn(name, F.lit(start).cast("bigint") + position * step)
        .drop("__part", "__offset", "__place")
    )


def sequence_position(tables: dict[str, DataFrame], specs: dict[str, TableSpec]) -> DataFrame:
    """Highest generated key per table, from which its sequence goes on.

    Only tables whose key is one serial column, present in the rows and without
    a declared start. Each table is a partial maximum over one column.
    """
    parts = []
    for name, df in tables.items():
        spec = specs[name]
        if len(spec.primary_key) != 1:
            continue
        column = spec.column(spec.primary_key[0])
        if column is None or not is_serial(column.type) or column.serial_start is not None:
            continue
        if column.name.lower() not in {c.lower() for c in df.columns}:
            continue
        parts.append(
            df.agg(F.max(column.name).cast("bigint").alias("position")).select(
                F.lit(name).alias("table"), F.lit(column.name).alias("column_name"), "position"
            )
        )
    if not parts:
        raise ValueError("no table has a single serial key")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def sequence_value(call: Column, spec: SequenceSpec) -> Column:
    """Value of the n-th call (from 1), NULL once the sequence is exhausted.

    The first run goes from ``start``; a cycling sequence goes on from its
    minimum (from its maximum when it descends).
    """
    if spec.increment == 0 or not spec.minimum <= spec.start <= spec.maximum:
        raise ValueError("the start has to lie within the bounds and the increment must not be 0")
    size = abs(spec.increment)
    if spec.increment > 0:
        first_run, full_run, restart = spec.maximum - spec.start, spec.maximum - spec.minimum, spec.minimum
    else:
        first_run, full_run, restart = spec.start - spec.minimum, spec.maximum - spec.minimum, spec.maximum
    first, full = first_run // size + 1, full_run // size + 1
    index = call.cast("bigint") - 1
    value = F.when(index < first, F.lit(spec.start).cast("bigint") + index * spec.increment)
    if spec.cycle:
        value = value.otherwise(F.lit(restart).cast("bigint") + F.pmod(index - first, F.lit(full)) * spec.increment)
    return F.when(index >= 0, value)


def sequence_values(df: DataFrame, call: str, spec: SequenceSpec, name: str = "value") -> DataFrame:
    """Value for each numbered call, and whether the sequence had run out."""
    value = sequence_value(F.col(call), spec)
    return df.withColumn(name, value).withColumn("exhausted", F.col(name).isNull())
