"""Declared type names: families, Spark equivalents and literal rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Declared type name -> Spark type.
SPARK_TYPES = {
    "smallint": "smallint",
    "int": "int",
    "integer": "int",
    "serial": "int",
    "bigint": "bigint",
    "bigserial": "bigint",
    "real": "float",
    "double precision": "double",
    "text": "string",
    "uuid": "string",
    "inet": "string",
    "ltree": "string",
    "boolean": "boolean",
    "bool": "boolean",
    "date": "date",
    "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp",
    "bytea": "binary",
}

# A generated type and the plain type that can refer to it.
REFERENCE_TYPES = {"serial": "int", "bigserial": "bigint"}


def spark_type(declared: str) -> str:
    """Spark type for a declared type; one it does not know is passed through."""
    name = declared.strip().lower()
    if re.match(r"(character varying|varchar|character|char)\b", name):
        return "string"
    if name.endswith("[]"):
        return f"array<{spark_type(name[:-2])}>"
    if re.match(r"(numeric|decimal)\b", name):
        return name.replace("numeric", "decimal")
    return SPARK_TYPES.get(name, name)


def length_limit(declared: str) -> int | None:
    found = re.match(r"(?:character varying|varchar|character|char)\s*\((\d+)\)", declared.strip(), re.I)
    return int(found.group(1)) if found else None


def is_serial(declared: str) -> bool:
    return declared.strip().lower() in REFERENCE_TYPES


def is_integer(declared: str) -> bool:
    return "int" in declared.lower()


def reference_type(declared: Column) -> Column:
    """Type a column needs in order to refer to a column of the given type."""
    mapped = F.create_map(*[F.lit(x) for pair in REFERENCE_TYPES.items() for x in pair])
    return F.coalesce(mapped[F.lower(declared)], declared)


def value_of(text: Column, declared: str) -> Column:
    """Text as a value of the declared type, NULL where it does not fit."""
    return text.try_cast(spark_type(declared))
