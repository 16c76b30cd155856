"""Tables that inherit from others: scans, effective columns, redundant columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtide.functions.cells import all_of
from rowtide.session import cut_lineage


def inheritance_scan(parent: DataFrame, children: dict[str, DataFrame], name: str, source: str = "source") -> DataFrame:
    """Parent rows and those of its children, cut down to the parent's columns
    (matched without regard to case), with the table each comes from."""
    out = parent.withColumn(source, F.lit(name))
    for child_name, child in children.items():
        spelling = {c.lower(): c for c in child.columns}
        cut = child.select(*[F.col(f"`{spelling[c.lower()]}`").alias(c) for c in parent.columns])
        out = out.unionByName(cut.withColumn(source, F.lit(child_name)))
    return out


def inherited_columns(
    own: DataFrame, parents: DataFrame, keys: list[str], table: str, parent: str, column: str = "column_name"
) -> DataFrame:
    """Effective columns of every table: its own, and of each other name the
    definition of the nearest ancestor. Adds ``defined_in`` and ``depth``.

    A table takes over what its parent holds, then what the ancestor twice as
    far up holds, and so on: one row per table and name throughout, and a forest
    of a thousand levels takes ten rounds. Parents that go round in a circle are
    an error.
    """
    attributes = [c for c in own.columns if c not in keys and c != table]
    name = F.lower(column).alias("__name")
    state = own.select(
        *keys, F.col(table).alias("__table"), name, F.struct(*attributes, F.col(table).alias("defined_in")).alias("__def"), F.lit(0).alias("depth")
    )
    state = cut_lineage(state.groupBy(*keys, "__table", "__name").agg(F.min_by("__def", "depth").alias("__def"), F.min("depth").alias("depth")))
    links = parents.filter(F.col(parent).isNotNull()).select(*keys, F.col(table).alias("__below"), F.col(parent).alias("__above"))
    links = cut_lineage(links.distinct())
    sizes = links.groupBy(*keys).count() if keys else links.agg(F.count(F.lit(1)).alias("count"))
    longest = sizes.agg(F.max("count")).first()[0] or 0
    reach = 1
    while not links.isEmpty():
        if reach > longest:
            raise ValueError(f"no end after {longest} steps: the parents form a cycle")
        up = links.select(*[F.col(k).alias(f"__{k}") for k in keys], "__below", "__above")
        higher = state.join(up, all_of([F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__table") == F.col("__above")]))
        gained = higher.select(*keys, F.col("__below").alias("__table"), "__name", "__def", (F.col("depth") + reach).alias("depth"))
        state = cut_lineage(
            state.unionByName(gained)
            .groupBy(*keys, "__table", "__name")
            .agg(F.min_by("__def", "depth").alias("__def"), F.min("depth").alias("depth"))
        )
        onward = links.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__below").alias("__mid"), F.col("__above").alias("__top"))
        links = cut_lineage(
            links.join(onward, all_of([F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__above") == F.col("__mid")]))
            .select(*keys, "__below", F.col("__top").alias("__above"))
        )
        reach *= 2
    return state.select(*keys, F.col("__table").alias(table), "__def.*", "depth")


def strip_inherited(
    columns: DataFrame, parents: DataFrame, keys: list[str], table: str, parent: str, same: list[str]
) -> DataFrame:
    """Columns without those that repeat the parent's. ``same`` lists the
    attributes that have to agree; foreign key names and descriptions are left
    out of it. Names and types ignore case."""
    link = parents.filter(F.col(parent).isNotNull()).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col(table).alias("__child"), F.col(parent).alias("__parent")
    )
    of_parent = columns.join(
        link, all_of([F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(table) == F.col("__parent")])
    ).select(
        *[F.col(f"__{k}") for k in keys],
        "__child",
        *[_folded(columns, c).alias(f"__same_{c}") for c in same],
    )
    match = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col(table) == F.col("__child")]
    match += [_folded(columns, c).eqNullSafe(F.col(f"__same_{c}")) for c in same]
    return columns.join(of_parent, all_of(match), "left_anti")


def _folded(df: DataFrame, column: str):
    kind = df.schema[column].dataType.typeName()
    return F.lower(column) if kind == "string" else F.col(column)
