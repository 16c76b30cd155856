"""Catalog drift: structure compared as table work, over a fleet of databases.

A catalog is a set of DataFrames, one per kind of object, each with leading
scope columns (normally ``db``). All kinds share :func:`catalog_diff`; they
differ in what identifies an object, in what makes two of them equal, and in
the action and upgrade stage that follow.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.cells import all_of, texts_present
from rowtide.functions.text import normalise_check, normalise_query, sorted_lower
from rowtide.operators.pairing import IN_NEW, IN_OLD, NEW_COPIES, OLD_COPIES, new_side, old_side, pair_states

Fold = Callable[[Column], Column]

CREATE, DROP, ALTER, RECREATE, REPLACE = "create", "drop", "alter", "recreate", "replace"
SAME, CHANGED, AMBIGUOUS = "same", "changed", "ambiguous"

NOT_DEFINED = "not defined"


def exact(value: Column) -> Column:
    return value


def fold_case(value: Column) -> Column:
    return F.lower(value)


def trimmed(value: Column) -> Column:
    return F.trim(value)


def lower_items(value: Column) -> Column:
    """Ordered list, without regard to case."""
    return F.transform(value, lambda v: F.lower(v))


def catalog_diff(
    old: DataFrame,
    new: DataFrame,
    scope: list[str],
    identity: Mapping[str, Fold] | list[str],
    compare: Mapping[str, Fold],
) -> DataFrame:
    """Every object of either catalog with ``action`` (create, drop, changed,
    same, ambiguous) and the list of changed attributes.

    Objects match on their folded identity (case is ignored by default) and are
    equal if all folded attributes are. Identity comes back in the new
    spelling; ``old_<attribute>`` and ``new_<attribute>`` hold the raw values.
    An identity that occurs twice on a side is reported once, as ambiguous.
    """
    if not isinstance(identity, Mapping):
        identity = {name: fold_case for name in identity}

    def side(df: DataFrame) -> DataFrame:
        return df.select(
            *scope,
            *[fold(F.col(i)).alias(f"id_{i}") for i, fold in identity.items()],
            *[F.col(i).alias(f"name_{i}") for i in identity],
            *[F.col(c).alias(c) for c in compare],
        )

    pairs = pair_states(side(old), side(new), [*scope, *[f"id_{i}" for i in identity]], on_duplicate="flag")
    differs = {c: ~fold(old_side(c)).eqNullSafe(fold(new_side(c))) for c, fold in compare.items()}
    changed = texts_present([F.when(d, F.lit(c)) for c, d in differs.items()])
    action = (
        F.when((F.col(OLD_COPIES) > 1) | (F.col(NEW_COPIES) > 1), AMBIGUOUS)
        .when(~F.col(IN_OLD), CREATE)
        .when(~F.col(IN_NEW), DROP)
        .when(F.size(changed) > 0, CHANGED)
        .otherwise(SAME)
    )
    out = pairs.withColumn("action", action)
    return out.select(
        *scope,
        *[
            F.when(F.col(IN_NEW), new_side(f"name_{i}")).otherwise(old_side(f"name_{i}")).alias(i)
            for i in identity
        ],
        "action",
        F.when(F.col("action") == CHANGED, changed).otherwise(F.array().cast("array<string>")).alias("changed"),
        *[old_side(c).alias(f"old_{c}") for c in compare],
        *[new_side(c).alias(f"new_{c}") for c in compare],
    )


def _drift(
    pairs: DataFrame, kind: str, scope: list[str], identity: list[str], changed_as: Column | str, stages: dict[str, int]
) -> DataFrame:
    """Drop what stayed the same, name the change and give it its stage."""
    named = F.when(F.col("action") == CHANGED, changed_as).otherwise(F.col("action"))
    stage = F.create_map(*[F.lit(x) for pair in stages.items() for x in pair])
    return pairs.filter(F.col("action") != SAME).select(
        *scope, F.lit(kind).alias("kind"), *identity, named.alias("action"), stage[named].alias("stage"), "changed"
    )


# -- single kinds -------------------------------------------------------------


def drift_simple(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Kinds that are a name and a value: ``schema``, ``language``, ``config``,
    ``statistics``, ``cluster`` and free-standing ``step``.

    Rows have scope, kind, name, value. Schemas are only created and dropped;
    a changed language is recreated; a parameter is set, never unset; a
    statistics target that goes away is set to -1, a cluster index to nothing;
    a step is found by its exact text and only ever added.
    """
    name_of = F.when(F.col("kind") == "step", F.col("name")).otherwise(F.lower("name"))
    prepared = [d.select(*scope, "kind", name_of.alias("id"), "name", "value") for d in (old, new)]
    pairs = pair_states(*prepared, [*scope, "kind", "id"], on_duplicate="flag")
    differs = ~old_side("value").eqNullSafe(new_side("value"))
    kind = F.col("kind")
    both = F.col(IN_OLD) & F.col(IN_NEW)
    action = (
        F.when((F.col(OLD_COPIES) > 1) | (F.col(NEW_COPIES) > 1), AMBIGUOUS)
        .when(~F.col(IN_OLD), F.when(kind.isin("schema", "language", "step"), CREATE).otherwise(ALTER))
        .when(
            ~F.col(IN_NEW),
            F.when(kind.isin("schema", "language"), DROP).when(kind.isin("statistics", "cluster"), ALTER),
        )
        .when(both & differs & (kind == "language"), RECREATE)
        .when(both & differs & kind.isin("config", "statistics", "cluster"), ALTER)
    )
    unset = F.when((kind == "statistics") & ~F.col(IN_NEW), F.lit("-1")).otherwise(new_side("value"))
    stage = F.when((kind == "schema") & (F.col("action") == DROP), 3).when(kind == "step", 2).otherwise(1)
    return (
        pairs.withColumn("action", action)
        .filter(F.col("action").isNotNull())
        .select(
            *scope,
            "kind",
            F.coalesce(new_side("name"), old_side("name")).alias("name"),
            "action",
            stage.alias("stage"),
            F.coalesce(old_side("value"), F.lit(NOT_DEFINED)).alias("old_value"),
            unset.alias("new_value"),
        )
    )


def drift_tables(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Tables created, renamed, moved to another schema or dropped.

    Rows have scope, schema_name, table_name and (new) old_schema_name,
    old_table_name. A declared former name the old catalog lacks, or one the new
    catalog still has, is an ``invalid rename``.
    """
    key = [*scope, "schema_key", "table_key"]
    before = old.select(
        *scope, F.lower("schema_name").alias("schema_key"), F.lower("table_name").alias("table_key"),
        "schema_name", "table_name",
    )
    declared = F.col("old_table_name").isNotNull()
    after = new.select(
        *scope,
        F.lower(F.when(declared, F.coalesce("old_schema_name", "schema_name")).otherwise(F.col("schema_name"))).alias(
            "schema_key"
        ),
        F.lower(F.coalesce("old_table_name", "table_name")).alias("table_key"),
        "schema_name",
        "table_name",
        declared.alias("declared"),
    )
    pairs = pair_states(before, after, key, on_duplicate="flag")
    moved = F.lower(old_side("schema_name")) != F.lower(new_side("schema_name"))
    steps = texts_present(
        [
            F.when((F.col(OLD_COPIES) > 1) | (F.col(NEW_COPIES) > 1), "invalid rename")
            .when(~F.col(IN_OLD) & new_side("declared"), "invalid rename")
            .when(~F.col(IN_OLD), CREATE)
            .when(~F.col(IN_NEW), DROP)
            .when(new_side("declared"), "rename"),
            F.when(F.col(IN_OLD) & F.col(IN_NEW) & (F.col(NEW_COPIES) == 1) & new_side("declared") & moved, "reschema"),
        ]
    )
    return pairs.select(
        *scope,
        F.coalesce(new_side("schema_name"), old_side("schema_name")).alias("schema_name"),
        F.coalesce(new_side("table_name"), old_side("table_name")).alias("table_name"),
        old_side("table_name").alias("old_table_name"),
        F.explode(steps).alias("action"),
    ).withColumn("stage", F.when(F.col("action") == DROP, 3).otherwise(1))


def drift_columns(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Column steps with their stage: add, drop, rename, and changes of type,
    default and nullability.

    Rows have scope, table_name, column_name, data_type, nullable, dflt and
    (new, optional) old_column_name and old_table_name: columns of a renamed
    table are compared with those it had under its former name. A type may be
    NULL (a column that takes that of its reference); with ``resolved_type`` on
    both sides (``graph.terminal_reference``) that one is compared. A renamed
    column also gets its other changes. Required columns are filled in stage 1
    and required in stage 3.
    """
    key = [*scope, "table_key", "column_key"]
    former = F.col("old_column_name") if "old_column_name" in new.columns else F.lit(None).cast("string")
    former_table = F.col("old_table_name") if "old_table_name" in new.columns else F.lit(None).cast("string")
    resolved = "resolved_type" in old.columns and "resolved_type" in new.columns
    kind = F.coalesce("resolved_type", "data_type") if resolved else F.col("data_type")

    def side(df: DataFrame, of_table: Column, name: Column, declared: Column) -> DataFrame:
        return df.select(
            *scope, F.lower(of_table).alias("table_key"), F.lower(name).alias("column_key"), "table_name",
            "column_name", kind.alias("data_type"), "nullable", "dflt", declared.alias("declared"),
        )

    pairs = pair_states(
        side(old, F.col("table_name"), F.col("column_name"), F.lit(False)),
        side(new, F.coalesce(former_table, F.col("table_name")), F.coalesce(former, F.col("column_name")), former.isNotNull()),
        key,
        on_duplicate="flag",
    )
    unclear = (F.col(OLD_COPIES) > 1) | (F.col(NEW_COPIES) > 1)
    both = F.col(IN_OLD) & F.col(IN_NEW) & ~unclear
    default_differs = ~old_side("dflt").eqNullSafe(new_side("dflt"))
    lost_name = ~F.col(IN_OLD) & new_side("declared")

    def step(condition: Column, action: str, stage: int) -> Column:
        return F.when(condition, F.struct(F.lit(action).alias("action"), F.lit(stage).alias("stage")))

    add = ~F.col(IN_OLD) & ~new_side("declared")
    # A column whose nullability is not stated takes NULLs.
    was_free, is_free = F.coalesce(old_side("nullable"), F.lit(True)), F.coalesce(new_side("nullable"), F.lit(True))
    fill = new_side("dflt").isNotNull() & ~is_free
    steps = F.array(
        step(unclear, AMBIGUOUS, 1),
        step(~unclear & add, "add", 1),
        step(~unclear & add & fill, "fill default", 1),
        step(~unclear & add & ~is_free, "set not null", 3),
        step(~unclear & lost_name, "invalid rename", 1),
        step(~unclear & ~F.col(IN_NEW), DROP, 3),
        step(both & new_side("declared"), "rename", 1),
        step(both & ~old_side("data_type").eqNullSafe(new_side("data_type")), "alter type", 1),
        step(both & default_differs & new_side("dflt").isNull(), "drop default", 1),
        step(both & default_differs & new_side("dflt").isNotNull(), "set default", 1),
        step(both & ~was_free & is_free, "drop not null", 1),
        step(both & was_free & fill, "fill default", 1),
        step(both & was_free & ~is_free, "set not null", 3),
    )
    # The steps that do not apply are NULL and go after the explode.
    return (
        pairs.select(
            *scope,
            F.coalesce(new_side("table_name"), old_side("table_name")).alias("table_name"),
            F.coalesce(new_side("column_name"), old_side("column_name")).alias("column_name"),
            F.explode(steps).alias("step"),
        )
        .filter(F.col("step").isNotNull())
        .select(*scope, "table_name", "column_name", "step.action", "step.stage")
    )


def follow_table_renames(old: DataFrame, tables: DataFrame, scope: list[str]) -> DataFrame:
    """Old catalog rows of any kind under the new names of their tables, so that
    what did not change in a renamed table shows no drift. ``tables`` has scope,
    table_name and old_table_name, as :func:`drift_tables` takes them."""
    renamed = tables.filter(F.col("old_table_name").isNotNull()).select(
        *[F.col(s).alias(f"__{s}") for s in scope],
        F.lower("old_table_name").alias("__former"),
        F.col("table_name").alias("__current"),
    )
    match = all_of([F.col(s) == F.col(f"__{s}") for s in scope] + [F.lower("table_name") == F.col("__former")])
    current = F.coalesce("__current", "table_name").alias("table_name")
    return old.join(renamed, match, "left").select(*[current if c == "table_name" else F.col(c) for c in old.columns])


def drift_constraints(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Constraints by table and name: kind, text, foreign key actions, ordered
    columns, referenced table, referenced columns and their types."""
    compare = {
        "constraint_type": fold_case,
        "definition": exact,
        "on_delete": exact,
        "on_update": exact,
        "columns": lower_items,
        "ref_table": fold_case,
        "ref_columns": lower_items,
        "ref_types": lower_items,
    }
    pairs = catalog_diff(old, new, scope, ["table_name", "constraint_name"], compare)
    return _drift(pairs, "constraint", scope, ["table_name", "constraint_name"], F.lit(RECREATE), _STAGE_ONE)


_STAGE_ONE = {CREATE: 1, DROP: 1, ALTER: 1, RECREATE: 1, REPLACE: 1, AMBIGUOUS: 1}


def indexes_with_unique_columns(indexes: DataFrame, columns: DataFrame, scope: list[str]) -> DataFrame:
    """Declared indexes plus one for each column that is unique by itself."""
    own = columns.filter("is_unique").select(
        *scope,
        "table_name",
        F.concat_ws("_", "table_name", "column_name", F.lit("key")).alias("index_name"),
        F.lit(True).alias("is_unique"),
        F.lit(False).alias("concurrently"),
        F.lit("btree").alias("method"),
        F.array("column_name").alias("dimensions"),
        F.lit(None).cast("string").alias("predicate"),
    )
    return indexes.select(*own.columns).unionByName(own)


def drift_indexes(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Indexes by table and name: uniqueness, method, ordered dimensions (by
    value, whatever their names) and predicate."""
    compare = {
        "is_unique": exact,
        "concurrently": exact,
        "method": fold_case,
        "dimensions": exact,
        "predicate": trimmed,
    }
    pairs = catalog_diff(old, new, scope, ["table_name", "index_name"], compare)
    return _drift(pairs, "index", scope, ["table_name", "index_name"], F.lit(RECREATE), _STAGE_ONE)


def drift_views(old: DataFrame, new: DataFrame, scope: list[str], always: bool = False) -> DataFrame:
    """Views by name: owner and query, compared without outer blanks, closing
    semicolon and case. ``always`` recreates every view that stays."""
    pairs = catalog_diff(old, new, scope, ["view_name"], {"owner": fold_case, "query": normalise_query})
    if always:
        pairs = pairs.withColumn("action", F.when(F.col("action") == SAME, CHANGED).otherwise(F.col("action")))
    stages = {**_STAGE_ONE, CREATE: 3, RECREATE: 3}
    return _drift(pairs, "view", scope, ["view_name"], F.lit(RECREATE), stages)


def drift_functions(
    old: DataFrame, new: DataFrame, scope: list[str], changed_types: DataFrame | None = None
) -> DataFrame:
    """Functions by name, ordered parameters and dialect: owner, return type,
    language and body.

    A function marked ``force`` is replaced though it is the same, and so is one
    whose return type is among ``changed_types`` (scope, type_name).
    """
    identity = {"function_name": fold_case, "params": lower_items, "dialect": fold_case}
    compare = {"owner": exact, "returns": exact, "language": fold_case, "body": exact, "force": lambda c: F.lit(0)}
    pairs = catalog_diff(old, new, scope, identity, compare)
    retype = F.lit(False)
    if changed_types is not None:
        types = changed_types.select(
            *[F.col(s).alias(f"__{s}") for s in scope], F.lower("type_name").alias("__type")
        ).distinct()
        match = F.lower("new_returns") == F.col("__type")
        for s in scope:
            match = match & (F.col(s) == F.col(f"__{s}"))
        pairs = pairs.join(types, match, "left")
        retype = F.col("__type").isNotNull()
    again = (F.col("action") == SAME) & (F.coalesce("new_force", F.lit(False)) | retype)
    pairs = pairs.withColumn("action", F.when(again, CHANGED).otherwise(F.col("action")))
    stages = {**_STAGE_ONE, DROP: 3}
    return _drift(pairs, "function", scope, list(identity), F.lit(REPLACE), stages)


def drift_triggers(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Triggers by table and name: function, set of events, row or statement,
    timing and dialect."""
    compare = {
        "function_name": fold_case,
        "events": sorted_lower,
        "for_each": fold_case,
        "timing": fold_case,
        "dialect": fold_case,
    }
    pairs = catalog_diff(old, new, scope, ["table_name", "trigger_name"], compare)
    return _drift(pairs, "trigger", scope, ["table_name", "trigger_name"], F.lit(RECREATE), _STAGE_ONE)


SEQUENCE_ATTRIBUTES = ("increment", "minimum", "maximum", "cache", "cycle")


def drift_sequences(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Sequences by name, with the attributes to alter. The start only matters
    when a sequence is created, so it is not compared."""
    pairs = catalog_diff(old, new, scope, ["sequence_name"], {a: exact for a in SEQUENCE_ATTRIBUTES})
    return _drift(pairs, "sequence", scope, ["sequence_name"], F.lit(ALTER), _STAGE_ONE)


def drift_types(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """User types by name. Rows have type_kind (enum, composite, domain),
    members (ordered), base_type, dflt, nullable and checks (ordered texts).

    Members of an enum are compared exactly, those of a composite without regard
    to case; checks without the word and its parentheses. A domain that keeps
    its base type is altered, any other changed type recreated.
    """

    def with_members(df: DataFrame) -> DataFrame:
        members = F.when(F.col("type_kind") == "enum", F.col("members")).otherwise(lower_items(F.col("members")))
        return df.withColumn("members", members)

    compare = {
        "type_kind": exact,
        "members": exact,
        "base_type": fold_case,
        "dflt": exact,
        "nullable": exact,
        "checks": lambda c: F.transform(c, normalise_check),
    }
    pairs = catalog_diff(with_members(old), with_members(new), scope, ["type_name"], compare)
    altered = (
        (F.col("old_type_kind") == "domain")
        & (F.col("new_type_kind") == "domain")
        & F.lower("old_base_type").eqNullSafe(F.lower("new_base_type"))
    )
    change = F.when(altered, F.lit(ALTER)).otherwise(F.lit(RECREATE))
    return _drift(pairs, "type", scope, ["type_name"], change, _STAGE_ONE)


def drift_report(drifts: Mapping[str, DataFrame], scope: str = "db") -> DataFrame:
    """Steps counted by database, kind and action, with all subtotals (``*``,
    and NULL for the scope)."""
    union = None
    for kind, df in drifts.items():
        part = df.select(F.col(scope), F.lit(kind).alias("kind"), "action")
        union = part if union is None else union.unionByName(part)
    # Counted first: the subtotals are then expanded from one row per combination.
    counted = union.groupBy(scope, "kind", "action").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.rollup(scope, "kind", "action")
        .agg(F.sum("n").alias("n"))
        .select(scope, F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("action", F.lit("*")).alias("action"), "n")
    )
