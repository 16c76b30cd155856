"""Equality and resolution of single values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from rowtide.functions.types import value_of
from rowtide.spec import ColumnSpec

TYPED = "typed"
TEXT = "text"


def cell_equal(a: Column, b: Column, mode: str = TYPED) -> Column:
    """``typed``: equal values, NULL only to NULL. ``text``: equal texts, where
    NULL, empty and blank all read as the empty text."""
    if mode == TYPED:
        return a.eqNullSafe(b)
    if mode == TEXT:
        return F.coalesce(a.cast("string"), F.lit("")) == F.coalesce(b.cast("string"), F.lit(""))
    raise ValueError(f"unknown comparison mode {mode!r}")


def tagged_cell_equal(a: Column, b: Column) -> Column:
    """Equality of ``struct<null, empty, sql, text>`` cells."""
    return (
        F.when(a["null"] & b["null"], F.lit(True))
        .when(a["empty"] & b["empty"], F.lit(True))
        .when(a["sql"] != b["sql"], F.lit(False))
        .otherwise(F.coalesce(a["text"], F.lit("")) == F.coalesce(b["text"], F.lit("")))
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions, F.lit(False))


def texts_present(texts: list[Column]) -> Column:
    """The texts that are not NULL, in order, as an array. They have to differ
    from each other. (Unlike a lambda filter this keeps generated code.)"""
    if not texts:
        return F.array().cast("array<string>")
    return F.array_except(F.array(*texts), F.array(F.lit(None).cast("string")))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))


def declared_default(spec: ColumnSpec, spark_type: str) -> Column:
    """The spec's default, NULL where there is none."""
    if spec.default is None or spec.default.strip().lower() in ("", "null"):
        return F.lit(None).cast(spark_type)
    return F.expr(spec.default).cast(spark_type)


def resolve_cell(cell: Column, spec: ColumnSpec, spark_type: str) -> Column:
    """Value of a tagged cell: null flag, empty flag, ``default`` as an
    expression, blank text as default or NULL, otherwise the typed text.

    Any other expression text is data, so it is not run: it resolves to NULL and
    ``unresolved_expression`` reports it.
    """
    default = declared_default(spec, spark_type)
    empty = F.lit("").cast("string").try_cast(spark_type)
    return (
        F.when(cell["null"], F.lit(None).cast(spark_type))
        .when(cell["empty"], empty)
        .when(cell["sql"], F.when(_says_default(cell), default))
        .when(F.coalesce(cell["text"], F.lit("")) == "", default)
        .otherwise(value_of(cell["text"], spec.type))
    )


def unresolved_expression(cell: Column) -> Column:
    """Expression text that only a database could evaluate, else NULL."""
    return F.when(cell["sql"] & ~cell["null"] & ~cell["empty"] & ~_says_default(cell), cell["text"])


def _says_default(cell: Column) -> Column:
    return F.coalesce(F.lower(F.trim(cell["text"])) == "default", F.lit(False))
