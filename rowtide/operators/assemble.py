"""Catalog assembly: exported catalog rows become objects.

The lists gathered here are the columns, dimensions or events of one object,
which the source database bounds: a table has at most 1,600 columns, a trigger
four events. Rows outside these bounds are left out of the lists, which so cannot
grow with the data, and :func:`rows_out_of_bounds` and :func:`unknown_events`
report them; one faulty row of one database does not hold up the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.cells import all_of
from rowtide.functions.text import normalise_check

# One-letter rules of a foreign key.
FOREIGN_KEY_RULES = {
    "a": "NO ACTION",
    "r": "RESTRICT",
    "c": "CASCADE",
    "n": "SET NULL",
    "d": "SET DEFAULT",
}

# What can fire a trigger.
TRIGGER_EVENTS = ("INSERT", "UPDATE", "DELETE", "TRUNCATE")

NO_KEY_WARNING = "primary key definition not found"
MAX_COLUMNS = 1600


def ordered(position: str, *values: str) -> list[Column]:
    """The values in order of position, as parallel arrays, without rows out of bounds."""
    rows = F.array_sort(F.collect_set(F.when(~_out_of_bounds(position), F.struct(position, *values))))
    # Taking a field of an array of structs gives the array of that field.
    return [rows[v].alias(v) for v in values]


def _out_of_bounds(position: str) -> Column:
    return F.coalesce((F.col(position) > MAX_COLUMNS) | (F.col(position) < -MAX_COLUMNS), F.lit(False))


def rows_out_of_bounds(rows: DataFrame, position: str = "position") -> DataFrame:
    """Catalog rows whose position no table can have, with an ``error``."""
    text = F.concat(F.lit("position out of bounds: "), F.col(position).cast("string"))
    return rows.filter(_out_of_bounds(position)).withColumn("error", text)


def unknown_events(rows: DataFrame) -> DataFrame:
    """Trigger rows with an event the database does not have, with an ``error``."""
    known = F.coalesce(F.upper("event").isin(*TRIGGER_EVENTS), F.lit(False))
    return rows.filter(~known).withColumn("error", F.concat(F.lit("unknown trigger event: "), F.coalesce("event", F.lit("none"))))


def _rule(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in FOREIGN_KEY_RULES.items() for x in pair])[F.lower(code)]


def assemble_foreign_keys(rows: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(foreign keys, columns that carry one inline).

    Rows have scope, constraint_name, local_table, foreign_table, update_rule,
    delete_rule, position, local_column, foreign_column. A key of one column
    goes onto that column.
    """
    keys = rows.groupBy(*scope, "constraint_name", "local_table", "foreign_table", "update_rule", "delete_rule").agg(
        *ordered("position", "local_column", "foreign_column")
    )
    whole = keys.select(
        *scope,
        "constraint_name",
        "local_table",
        F.col("local_column").alias("local_columns"),
        "foreign_table",
        F.col("foreign_column").alias("foreign_columns"),
        _rule(F.col("update_rule")).alias("on_update"),
        _rule(F.col("delete_rule")).alias("on_delete"),
    )
    inline = whole.filter(F.size("local_columns") == 1).select(
        *scope,
        "local_table",
        F.col("local_columns")[0].alias("local_column"),
        "constraint_name",
        "foreign_table",
        F.col("foreign_columns")[0].alias("foreign_column"),
        "on_update",
        "on_delete",
    )
    return whole.filter(F.size("local_columns") > 1), inline


def assemble_constraints(tables: DataFrame, rows: DataFrame, scope: list[str]) -> DataFrame:
    """Primary keys, unique rules and checks, in their place.

    Rows have scope, table_name, constraint_name, constraint_type (p, u, c),
    check_def, position, column_name. A check over one column goes onto that
    column. A table without a primary key gets a row with a warning. Output:
    scope, table_name, constraint_name, placement (primary key, unique, check,
    column check), columns, definition, warning.
    """
    kind = F.lower("constraint_type")
    gathered = rows.groupBy(*scope, "table_name", "constraint_name", kind.alias("kind"), "check_def").agg(
        *ordered("position", "column_name")
    )
    single = F.size("column_name") == 1
    placement = (
        F.when(F.col("kind") == "p", "primary key")
        .when(F.col("kind") == "u", "unique")
        .when((F.col("kind") == "c") & single, "column check")
        .when(F.col("kind") == "c", "check")
        .otherwise("unknown")
    )
    quoted = F.concat(F.lit('("'), F.array_join("column_name", '", "'), F.lit('")'))
    definition = (
        F.when(placement == "unique", quoted)
        .when(placement == "column check", normalise_check(F.col("check_def")))
        .when(placement == "check", F.col("check_def"))
    )
    found = gathered.select(
        *scope,
        "table_name",
        "constraint_name",
        placement.alias("placement"),
        F.col("column_name").alias("columns"),
        definition.alias("definition"),
        F.lit(None).cast("string").alias("warning"),
    )
    with_key = found.filter(F.col("placement") == "primary key").select(
        *[F.col(s).alias(f"__{s}") for s in scope], F.col("table_name").alias("__table")
    )
    match = all_of([F.col(s) == F.col(f"__{s}") for s in scope] + [F.col("table_name") == F.col("__table")])
    keyless = tables.select(*scope, "table_name").distinct().join(with_key, match, "left_anti").select(
        *scope,
        "table_name",
        F.lit(None).cast("string").alias("constraint_name"),
        F.lit("primary key").alias("placement"),
        F.array().cast("array<string>").alias("columns"),
        F.lit(None).cast("string").alias("definition"),
        F.lit(NO_KEY_WARNING).alias("warning"),
    )
    return found.unionByName(keyless)


def assemble_indexes(rows: DataFrame, constraints: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(indexes, columns that are unique by themselves).

    Rows have scope, table_name, index_name, is_unique, is_primary, method,
    predicate, position, dimension. Indexes of primary keys and those that back
    a constraint (scope, table_name, constraint_name) are left out.
    """
    backed = constraints.select(
        *[F.col(s).alias(f"__{s}") for s in scope],
        F.col("table_name").alias("__table"),
        F.col("constraint_name").alias("__name"),
    ).distinct()
    match = all_of(
        [F.col(s) == F.col(f"__{s}") for s in scope]
        + [F.col("table_name") == F.col("__table"), F.col("index_name") == F.col("__name")]
    )
    free = rows.filter(~F.col("is_primary")).join(backed, match, "left_anti")
    gathered = free.groupBy(
        *scope, "table_name", "index_name", "is_unique", F.lower("method").alias("method"), "predicate"
    ).agg(*ordered("position", "dimension"))
    gathered = gathered.withColumnRenamed("dimension", "dimensions")
    one_unique = (F.size("dimensions") == 1) & F.col("is_unique")
    unique_columns = gathered.filter(one_unique).select(
        *scope, "table_name", F.col("dimensions")[0].alias("column_name")
    )
    return gathered.filter(~one_unique), unique_columns.distinct()


def assemble_triggers(rows: DataFrame, scope: list[str]) -> DataFrame:
    """One trigger with its sorted events from one row per event."""
    statement = F.trim(F.regexp_replace("statement", r"(?i)execute\s+(procedure|function)", ""))
    event = F.upper("event")
    event = F.when(event.isin(*TRIGGER_EVENTS), event)
    return rows.groupBy(
        *scope, "table_name", "trigger_name", "timing", "orientation", statement.alias("function_call")
    ).agg(F.array_sort(F.collect_set(event)).alias("events"))


def collapse_serials(columns: DataFrame, sequences: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(columns, sequences) with generated integers written as serial types.

    A required int or bigint column whose default takes the next value of a
    ``..._seq`` sequence becomes serial or bigserial without a default, and the
    sequences such columns own are left out.
    """
    kind = F.lower("data_type")
    generated = (
        kind.isin("int", "integer", "bigint")
        & ~F.col("nullable")
        & F.coalesce(F.lower("dflt").rlike(r"^nextval\(.*_seq"), F.lit(False))
    )
    serial = F.when(kind == "bigint", "bigserial").otherwise("serial")
    collapsed = columns.select(
        *[
            F.when(generated, serial).otherwise(F.col(c)).alias(c)
            if c == "data_type"
            else F.when(~generated, F.col(c)).alias(c)
            if c == "dflt"
            else F.col(c)
            for c in columns.columns
        ]
    )
    # The sequence stands between quotes in the default, with or without its schema.
    quoted = F.regexp_extract("dflt", r"(?i)nextval\([\s(]*'([^']+)'", 1)
    owned = columns.filter(generated).select(
        *[F.col(s).alias(f"__{s}") for s in scope],
        F.replace(F.regexp_extract(quoted, r'("[^"]+"|[^".]+)$', 1), F.lit('"'), F.lit("")).alias("__sequence"),
    ).distinct()
    match = all_of([F.col(s) == F.col(f"__{s}") for s in scope] + [F.col("sequence_name") == F.col("__sequence")])
    return collapsed, sequences.join(owned, match, "left_anti")


# Types by what their modifier holds.
LENGTH_TYPES = ("varchar", "character varying", "bpchar", "char", "character")
SCALED_TYPES = ("numeric", "decimal")
MODIFIER_HEADER = 4
# An interval's modifier holds its fields above 16 bits and its precision below; these mean all and none.
ALL_FIELDS, NO_PRECISION = 0x7FFF, 0xFFFF
# The fields of an interval by their bits.
INTERVAL_FIELDS = {
    1 << 2: "year",
    1 << 1: "month",
    1 << 3: "day",
    1 << 10: "hour",
    1 << 11: "minute",
    1 << 12: "second",
    1 << 2 | 1 << 1: "year to month",
    1 << 3 | 1 << 10: "day to hour",
    1 << 3 | 1 << 10 | 1 << 11: "day to minute",
    1 << 3 | 1 << 10 | 1 << 11 | 1 << 12: "day to second",
    1 << 10 | 1 << 11: "hour to minute",
    1 << 10 | 1 << 11 | 1 << 12: "hour to second",
    1 << 11 | 1 << 12: "minute to second",
}


def formatted_type(name: Column, modifier: Column) -> Column:
    """A type with its modifier written out, as the catalog packs it.

    Lengths are kept with 4 added, a precision and scale as one number with 4
    added, an interval's fields beside its precision, times and bit strings as
    they are. A negative modifier means none.
    """
    packed = modifier - MODIFIER_HEADER
    scale = packed.bitwiseAND(F.lit(0x7FF))
    # The scale is a signed number of 11 bits.
    scale = F.when(scale >= 1024, scale - 2048).otherwise(scale)
    precision = F.shiftright(packed, 16).bitwiseAND(F.lit(0xFFFF))
    kind = F.lower(name)
    size = (
        F.when(kind.isin(*LENGTH_TYPES), packed.cast("string"))
        .when(kind.isin(*SCALED_TYPES), F.concat_ws(",", precision.cast("string"), scale.cast("string")))
        .otherwise(modifier.cast("string"))
    )
    fields = F.shiftright(modifier, 16).bitwiseAND(F.lit(ALL_FIELDS))
    digits = modifier.bitwiseAND(F.lit(NO_PRECISION))
    known = F.create_map(*[F.lit(x) for bits, text in INTERVAL_FIELDS.items() for x in (bits, f" {text}")])
    interval = F.concat(
        name,
        F.coalesce(known[fields.cast("int")], F.lit("")),
        F.when(digits == NO_PRECISION, "").otherwise(F.concat(F.lit("("), digits.cast("string"), F.lit(")"))),
    )
    sized = F.when(kind == "interval", interval).otherwise(F.concat(name, F.lit("("), size, F.lit(")")))
    return F.when(modifier >= 0, sized).otherwise(name)


def assemble_columns(
    tables: DataFrame, columns: DataFrame, types: DataFrame, defaults: DataFrame, descriptions: DataFrame, scope: list[str]
) -> DataFrame:
    """Columns of all tables in ordinal order, with formatted type, default,
    nullability and description, put together from the catalog's own tables.

    ``tables`` has table_id, table_name; ``columns`` table_id, position,
    column_name, type_id, type_mod, not_null, dropped; ``types`` type_id,
    type_name; ``defaults`` and ``descriptions`` table_id, position and
    ``dflt`` or ``description``.
    """
    present = columns.filter((F.col("position") > 0) & ~F.col("dropped"))
    sized = formatted_type(F.col("type_name"), F.col("type_mod"))
    place = [*scope, "table_id", "position"]
    return (
        present.join(tables, [*scope, "table_id"])
        .join(types, [*scope, "type_id"])
        .join(defaults, place, "left")
        .join(descriptions, place, "left")
        .select(
            *scope,
            "table_name",
            "position",
            "column_name",
            sized.alias("data_type"),
            (~F.col("not_null")).alias("nullable"),
            "dflt",
            "description",
        )
    )
