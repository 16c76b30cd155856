"""Schema evolution of table data.

Each step is a projection; a chain of them, and :func:`evolve_table` as a whole,
collapses into one pass over the table. Structure checks run on the specs before
anything is planned.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.cells import texts_present
from rowtide.functions.types import is_integer, is_serial, spark_type
from rowtide.operators.checks import with_domain_violations
from rowtide.operators.pairing import find_column, new_side, old_side, pair_states
from rowtide.spec import ColumnSpec, DomainSpec, EnumSpec, TableSpec

# Defaults that stand for the moment of the change.
NOW_DEFAULTS = ("now()", "current_timestamp")

HOOKS = ("before_stage1", "after_stage1", "before_stage3", "after_stage3")

Hook = Callable[[DataFrame], DataFrame]


def has_now_default(column: ColumnSpec) -> bool:
    return (column.default or "").strip().lower() in NOW_DEFAULTS


def _default(column: ColumnSpec, run_ts: datetime.datetime | None = None) -> Column:
    kind = spark_type(column.type)
    if not column.default or column.default.strip().lower() == "null":
        return F.lit(None).cast(kind)
    if has_now_default(column):
        if run_ts is None:
            raise ValueError(f"column {column.name!r} defaults to the current time: pass run_ts")
        return F.lit(run_ts.isoformat(sep=" ")).cast(kind)
    return F.expr(column.default).cast(kind)


def _required(value: Column, name: str) -> Column:
    """The value, but the job fails on a NULL."""
    message = F.lit(f"column {name} holds NULL but must not")
    return F.when(value.isNull(), F.raise_error(message)).otherwise(value)


def _replace(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])


# -- adding -------------------------------------------------------------------


def _check_new(df: DataFrame, column: ColumnSpec) -> None:
    if find_column(df, column.name):
        raise ValueError(f"column {column.name!r} exists already")


def add_nullable_column(df: DataFrame, column: ColumnSpec) -> DataFrame:
    """The column is NULL unless it has a default."""
    _check_new(df, column)
    return df.withColumn(column.name, _default(column))


def add_column_default(df: DataFrame, column: ColumnSpec) -> DataFrame:
    """A required column: filled with its default, and the job fails if that
    leaves a NULL."""
    _check_new(df, column)
    value = _default(column)
    return df.withColumn(column.name, value if column.nullable else _required(value, column.name))


def add_column_now(df: DataFrame, column: ColumnSpec, run_ts: datetime.datetime) -> DataFrame:
    """One instant for all rows, given by the caller so that a re-run agrees."""
    _check_new(df, column)
    if not has_now_default(column):
        raise ValueError(f"column {column.name!r} does not default to the current time")
    return df.withColumn(column.name, _default(column, run_ts))


# -- dropping and renaming ----------------------------------------------------


def drop_columns(df: DataFrame, old: TableSpec, new: TableSpec, ignore_old_names: bool = False) -> DataFrame:
    """Drop what the new spec lacks, except columns a new one claims as its
    former self."""
    claimed = set() if ignore_old_names else {c.old_name.lower() for c in new.columns if c.old_name}
    gone = [c.name for c in old.columns if new.column(c.name) is None and c.name.lower() not in claimed]
    return df.drop(*[find_column(df, g) or g for g in gone])


def declared_renames(old: TableSpec, new: TableSpec, case_sensitive: bool = False) -> dict[str, str]:
    """Former name -> new name, after the guards.

    The former name has to exist in the old spec and must be gone from the new
    one. With case-sensitive names a change of case alone is ambiguous unless
    the former name is declared.
    """
    renames = {}
    for column in new.columns:
        if case_sensitive and not column.old_name:
            before = old.column(column.name)
            if before is not None and before.name != column.name:
                raise ValueError(f"ambiguous: column {before.name!r} became {column.name!r} without a declared rename")
        if not column.old_name:
            continue

        def has(spec: TableSpec, name: str) -> bool:
            found = spec.column(name)
            return found is not None and (not case_sensitive or any(c.name == name for c in spec.columns))

        if has(new, column.old_name):
            raise ValueError(f"table {new.name!r} still has a column {column.old_name!r}")
        if not has(old, column.old_name):
            raise ValueError(f"table {old.name!r} had no column {column.old_name!r}")
        renames[old.column(column.old_name).name] = column.name
    return renames


def rename_columns(df: DataFrame, old: TableSpec, new: TableSpec, case_sensitive: bool = False) -> DataFrame:
    renames = declared_renames(old, new, case_sensitive)
    return df.withColumnsRenamed({find_column(df, f) or f: c for f, c in renames.items()})


# -- changing -----------------------------------------------------------------


def converted(column: ColumnSpec, current: Column) -> Column:
    """Value under the new type: the declared conversion, else a cast that gives
    NULL where the value does not fit."""
    kind = spark_type(column.type)
    return F.expr(column.using).try_cast(kind) if column.using else current.try_cast(kind)


def change_column_type(df: DataFrame, column: ColumnSpec) -> DataFrame:
    return _replace(df, column.name, converted(column, F.col(column.name)))


def failed_conversions(df: DataFrame, column: ColumnSpec) -> DataFrame:
    """Rows whose value is lost by the change of type."""
    value = F.col(column.name)
    return df.filter(value.isNotNull() & converted(column, value).isNull())


def set_not_null(df: DataFrame, column: ColumnSpec, enforce: bool = True) -> DataFrame:
    """Fill NULLs with the default; the job fails on a NULL that is left, unless
    ``enforce`` is off."""
    kind = df.schema[column.name].dataType
    value = F.coalesce(F.col(column.name), _default(column).cast(kind)) if column.default else F.col(column.name)
    return _replace(df, column.name, _required(value, column.name) if enforce else value)


def check_serial_change(old: ColumnSpec, new: ColumnSpec) -> None:
    if is_serial(new.type) and not is_serial(old.type):
        raise ValueError(f"column {new.name!r}: a type cannot be changed to {new.type}")


def serial_to_int(df: DataFrame, old: ColumnSpec, new: ColumnSpec) -> DataFrame:
    """The generator goes, the values stay. The way back is refused."""
    check_serial_change(old, new)
    if not (is_serial(old.type) and is_integer(new.type)):
        raise ValueError(f"column {new.name!r} does not go from a generated to an integer type")
    return _replace(df, new.name, F.col(new.name).cast(spark_type(new.type)))


def migrate_enum(df: DataFrame, column: str, new: EnumSpec) -> tuple[DataFrame, DataFrame]:
    """(rows with the column as text, rows whose value the new set lacks)."""
    as_text = _replace(df, column, F.col(column).cast("string"))
    return as_text, as_text.filter(F.col(column).isNotNull() & ~F.col(column).isin(*new.values))


def migrate_domain(df: DataFrame, column: str, old: DomainSpec, new: DomainSpec) -> DataFrame:
    """Rows that break the new domain in a way they did not break the old one,
    one row per newly broken rule."""
    both = with_domain_violations(df, column, old, "__before")
    both = with_domain_violations(both, column, new, "__after")
    newly = F.explode(F.array_except("__after", "__before")).alias("violation")
    return both.select(*df.columns, newly)


def domain_changes(old: DomainSpec, new: DomainSpec) -> list[tuple[str, str]]:
    """(action, subject) steps from one domain to the other, for the report."""
    steps = []
    if old.base_type.lower() != new.base_type.lower():
        steps.append(("recreate", new.base_type))
    if old.default and not new.default:
        steps.append(("drop default", old.default))
    elif old.default != new.default:
        steps.append(("set default", new.default or ""))
    if old.nullable != new.nullable:
        steps.append(("set nullable" if new.nullable else "set not null", new.name))
    before, after = {c.name.lower(): c for c in old.checks}, {c.name.lower(): c for c in new.checks}
    for name, check in after.items():
        if name not in before:
            steps.append(("add check", check.name))
        elif before[name].predicate.strip() != check.predicate.strip():
            steps.append(("change check", check.name))
    steps += [("drop check", c.name) for n, c in before.items() if n not in after]
    return steps


# -- whole tables -------------------------------------------------------------


def evolve_table(
    df: DataFrame,
    old: TableSpec,
    new: TableSpec,
    *,
    hooks: Mapping[str, Hook] | None = None,
    run_ts: datetime.datetime | None = None,
    case_sensitive: bool = False,
) -> DataFrame:
    """The table's rows under the new spec, in one projection.

    Columns are renamed, converted, filled and added, the rest dropped. Hooks
    take and return a DataFrame and run before and after stage 1 (add and
    change) and stage 3 (drop and require); without hooks nothing separates the
    two stages.
    """
    hooks = dict(hooks or {})
    unknown = set(hooks) - set(HOOKS)
    if unknown:
        raise ValueError(f"unknown hooks {sorted(unknown)}")

    def run(name: str, rows: DataFrame) -> DataFrame:
        return hooks[name](rows) if name in hooks else rows

    renames = {f.lower(): c for f, c in declared_renames(old, new, case_sensitive).items()}
    former = {c: f for f, c in renames.items()}
    df = run("before_stage1", df)
    produced, values = [], []
    for column in new.columns:
        before = old.column(former.get(column.name, column.name))
        if before is None:
            value = _default(column, run_ts)
        else:
            check_serial_change(before, column)
            value = F.col(f"`{find_column(df, before.name) or before.name}`")
            if spark_type(before.type) != spark_type(column.type) or column.using:
                value = converted(column, value)
            if before.nullable and not column.nullable and column.default:
                value = F.coalesce(value, _default(column, run_ts))
        produced.append(column.name)
        values.append(value.alias(column.name))
    staying = {n.lower() for n in produced} | set(renames)
    leaving = [c for c in df.columns if c.lower() not in staying]
    stage1 = run("after_stage1", df.select(*values, *[F.col(f"`{c}`") for c in leaving]))
    stage3 = run("before_stage3", stage1)
    final = []
    for column in new.columns:
        value = F.col(f"`{column.name}`")
        final.append((value if column.nullable else _required(value, column.name)).alias(column.name))
    return run("after_stage3", stage3.select(*final))


def evolution_guards(
    old_tables: DataFrame,
    new_tables: DataFrame,
    old_columns: DataFrame,
    new_columns: DataFrame,
    keys: list[str],
) -> DataFrame:
    """Changes that are refused, found over whole catalogs.

    Tables have keys, table_name, part_type, part_column, part_count, inherits
    and (new) old_table_name; columns keys, table_name, column_name, data_type.
    Names ignore case. One row per object and refused change.
    """
    table_key = [*keys, "table_name"]
    pairs = pair_states(
        _lower(old_tables, "table_name"),
        _lower(new_tables, "table_name"),
        table_key,
        old_columns=["part_type", "part_column", "part_count", "inherits"],
        new_columns=["part_type", "part_column", "part_count", "inherits", "old_table_name"],
        how="inner",
    )
    was, now = old_side("part_type").isNotNull(), new_side("part_type").isNotNull()
    both = was & now

    def differs(name: str) -> Column:
        return ~F.lower(old_side(name).cast("string")).eqNullSafe(F.lower(new_side(name).cast("string")))

    rules = [
        (was != now, "partition status changed"),
        (both & new_side("old_table_name").isNotNull(), "partitioned table renamed"),
        (both & differs("part_type"), "partition type changed"),
        (both & differs("part_column"), "partition column changed"),
        (both & differs("part_count"), "partition count changed"),
        (old_side("inherits").isNull() != new_side("inherits").isNull(), "inheritance changed"),
    ]
    refused = F.explode(texts_present([F.when(c, F.lit(t)) for c, t in rules]))
    tables = pairs.select(*table_key, F.lit(None).cast("string").alias("column_name"), refused.alias("violation"))

    serial = F.lower("data_type").isin("serial", "bigserial")
    cut = [*keys, "table_name", "column_name"]
    columns = pair_states(
        _lower(old_columns.select(*cut, serial.alias("serial")), "table_name", "column_name"),
        _lower(new_columns.select(*cut, serial.alias("serial")), "table_name", "column_name"),
        cut,
        how="inner",
    ).filter(~old_side("serial") & new_side("serial"))
    return tables.unionByName(columns.select(*cut, F.lit("type changed to serial").alias("violation")))


def _lower(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.lower(c).alias(c) if c in names else F.col(c) for c in df.columns])
