"""Reading table states and declared row sets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowtide.functions.cells import resolve_cell, unresolved_expression
from rowtide.functions.types import spark_type
from rowtide.operators.diff import TOMBSTONE
from rowtide.operators.pairing import find_column
from rowtide.sources.markup import row_elements
from rowtide.spec import TableSpec

CELL_TYPE = "struct<null: boolean, empty: boolean, sql: boolean, text: string>"


# -- snapshots ----------------------------------------------------------------


def read_snapshot(spark: SparkSession, directory: str, table: str, columns: list[str] | None = None) -> DataFrame:
    """One table state; only the asked-for columns are read."""
    df = spark.read.parquet(f"{directory}/{table}.parquet")
    return df if columns is None else df.select(*columns)


def read_live_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    bounds: tuple[int, int],
    partitions: int,
    columns: list[str] | None = None,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A live table in one partitioned scan, instead of one query per row."""
    df = spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=partitions,
        properties=properties or {},
    )
    return df if columns is None else df.select(*columns)


# -- delimited rows -----------------------------------------------------------


def real_delimiter(delimiter: str | None) -> str:
    r"""Default tab; ``\t`` and ``\n`` written out stand for the characters."""
    return (delimiter or "\t").replace("\\t", "\t").replace("\\n", "\n")


def tab_cells(line: Column, delimiter: str | None = None) -> Column:
    r"""A delimited line as an array of texts, ``\N`` as NULL."""
    parts = F.split(line, re.escape(real_delimiter(delimiter)), -1)
    return F.transform(parts, lambda p: F.nullif(p, F.lit("\\N")))


def decode_tabrows(df: DataFrame, line: str, columns: list[str], delimiter: str | None = None) -> DataFrame:
    """Delimited text rows as columns; missing fields at the end are NULL."""
    cells = df.select(*[c for c in df.columns if c != line], tab_cells(F.col(line), delimiter).alias("__cells"))
    kept = [c for c in cells.columns if c != "__cells"]
    return cells.select(*kept, *[F.get("__cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])


# -- declared row sets --------------------------------------------------------


def read_declared_rows(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Declared rows: ``columns`` (header), ``cells`` (tagged) and ``_delete``.

    The files hold ``rows`` elements with a header, rows of cells and delimited
    lines, in any number and broken into lines in any way. A file, and a single
    large element, is shared among tasks. Given ``columns`` take the place of the
    headers.
    """
    found = row_elements(spark, path)
    # The delimiter differs by element, so the split pattern is built from it.
    given = F.coalesce(F.nullif("delimiter", F.lit("")), F.lit("\t"))
    given = F.replace(F.replace(given, F.lit("\\t"), F.lit("\t")), F.lit("\\n"), F.lit("\n"))
    pattern = F.concat(F.lit("\\Q"), given, F.lit("\\E"))
    no = F.lit(False)
    split_cells = F.transform(
        F.split(F.col("line"), pattern, -1),
        lambda p: F.struct(
            (p == "\\N").alias("null"), no.alias("empty"), no.alias("sql"), F.when(p == "\\N", F.lit("")).otherwise(p).alias("text")
        ),
    )
    header = F.array(*[F.lit(c) for c in columns]) if columns is not None else F.col("columns")
    return found.select(header.alias("columns"), F.coalesce("cells", split_cells).alias("cells"), F.col("deleted").alias(TOMBSTONE))


def cell_of(name: str) -> Column:
    """Cell of a named column in a declared row; NULL if its header lacks it."""
    place = F.array_position(F.transform("columns", lambda c: F.lower(c)), name.lower())
    return F.when(place > 0, F.get("cells", (place - 1).cast("int")))


def declared_table(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Declared rows as typed columns of the spec, and the tombstone flag."""
    values = []
    for column in spec.columns:
        cell, kind = cell_of(column.name), spark_type(column.type)
        absent = F.lit(None).cast(kind)
        values.append(F.when(cell.isNull(), absent).otherwise(resolve_cell(cell, column, kind)).alias(column.name))
    return rows.select(*values, TOMBSTONE)


# -- cells and headers --------------------------------------------------------


def resolve_cells(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Columns of tagged cells as typed values; others stay as they are.

    For a column with expression texts other than ``default`` a column
    ``<name>_expression`` reports them, as data is never run.
    """
    out = []
    for c in df.columns:
        column = spec.column(c)
        if column is None or df.schema[c].dataType.simpleString() != T._parse_datatype_string(CELL_TYPE).simpleString():
            out.append(F.col(c))
            continue
        out.append(resolve_cell(F.col(c), column, spark_type(column.type)).alias(c))
        out.append(unresolved_expression(F.col(c)).alias(f"{c}_expression"))
    return df.select(*out)


def align_rowset(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Columns in the spec's order and spelling, absent ones as typed NULLs."""
    out = []
    for column in spec.columns:
        found = find_column(df, column.name)
        kind = spark_type(column.type)
        out.append((F.col(f"`{found}`") if found else F.lit(None)).cast(kind).alias(column.name))
    return df.select(*out)


def add_rowset_column(df: DataFrame, name: str, value) -> DataFrame:
    """Add a column with one value for all rows; an existing name is an error."""
    if find_column(df, name):
        raise ValueError(f"the row set already has a column {name!r}")
    return df.withColumn(name, F.lit(value))
