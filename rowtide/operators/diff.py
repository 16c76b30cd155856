"""Snapshot diff: rows added, removed and changed between two states.

A state is a DataFrame with a key. A new state may carry a boolean tombstone
column: a flagged row is neither inserted nor updated, and the old row with its
key is deleted. A flagged row in the old state counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowtide.functions.cells import TYPED, all_of, any_of, cell_equal, texts_present
from rowtide.operators.graph import dependency_order
from rowtide.operators.pairing import (
    IN_NEW,
    IN_OLD,
    NEW_COPIES,
    OLD_COPIES,
    align_names,
    find_column,
    new_side,
    old_side,
    pair_states,
)
from rowtide.session import cut_lineage
from rowtide.spec import TableSpec

TOMBSTONE = "_delete"
DELETE_STAGE = 2
UPSERT_STAGE = 4

INSERT, UPDATE, DELETE, UNCHANGED, AMBIGUOUS = "I", "U", "D", "N", "X"


# -- tombstones ---------------------------------------------------------------


def live_rows(df: DataFrame, tombstone: str = TOMBSTONE) -> DataFrame:
    """Rows without the tombstone flag, and without its column."""
    flag = find_column(df, tombstone)
    if flag is None:
        return df
    return df.filter(~F.coalesce(F.col(f"`{flag}`"), F.lit(False))).drop(flag)


def _value_columns(df: DataFrame, pk: list[str], tombstone: str) -> list[str]:
    skip = {k.lower() for k in pk} | {tombstone.lower()}
    return [c for c in df.columns if c.lower() not in skip]


def _key_match(left: DataFrame, right: DataFrame, pk: list[str]) -> Column:
    return all_of([left[f"`{k}`"].eqNullSafe(right[f"`__r_{k}`"]) for k in pk])


def _keys_only(df: DataFrame, pk: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{k}`").alias(f"__r_{k}") for k in pk])


# -- presence -----------------------------------------------------------------


def rows_added(old: DataFrame, new: DataFrame, pk: list[str], tombstone: str = TOMBSTONE) -> DataFrame:
    """New rows whose key the old state does not have. Reads only keys of old."""
    old, new = live_rows(align_names(old, pk), tombstone), live_rows(align_names(new, pk), tombstone)
    keys = _keys_only(old, pk)
    return new.join(keys, _key_match(new, keys, pk), "left_anti")


def rows_removed(old: DataFrame, new: DataFrame, pk: list[str], tombstone: str = TOMBSTONE) -> DataFrame:
    """Old rows whose key is absent in the new state, or flagged there."""
    old, new = live_rows(align_names(old, pk), tombstone), live_rows(align_names(new, pk), tombstone)
    keys = _keys_only(new, pk)
    return old.join(keys, _key_match(old, keys, pk), "left_anti")


# -- comparison ---------------------------------------------------------------


def _differences(old_columns: list[str], new_columns: list[str], mode: str) -> dict[str, Column]:
    """For each new column the condition under which it counts as changed; one
    the old state lacks always does."""
    known = {c.lower(): c for c in old_columns}
    return {
        c: ~cell_equal(old_side(known[c.lower()]), new_side(c), mode) if c.lower() in known else F.lit(True)
        for c in new_columns
    }


def compare_rows(
    old: DataFrame,
    new: DataFrame,
    pk: list[str],
    *,
    mode: str = TYPED,
    tombstone: str = TOMBSTONE,
    on_duplicate: str = "fail",
    null_keys: bool = True,
    how: str = "full_outer",
) -> DataFrame:
    """Both sides of every key with ``op`` and the list of changed columns.

    ``op`` is I, U, D or N (unchanged), and X where ``on_duplicate='flag'``
    found copies of a key, for which no single answer exists.
    """
    old, new = live_rows(align_names(old, pk), tombstone), live_rows(align_names(new, pk), tombstone)
    old_columns, new_columns = _value_columns(old, pk, tombstone), _value_columns(new, pk, tombstone)
    pairs = pair_states(
        old,
        new,
        pk,
        old_columns=old_columns,
        new_columns=new_columns,
        on_duplicate=on_duplicate,
        null_keys=null_keys,
        how=how,
    )
    differs = _differences(old_columns, new_columns, mode)
    changed = texts_present([F.when(d, F.lit(c)) for c, d in differs.items()])
    op = (
        F.when(~F.col(IN_OLD), F.lit(INSERT))
        .when(~F.col(IN_NEW), F.lit(DELETE))
        .when(any_of(list(differs.values())), F.lit(UPDATE))
        .otherwise(F.lit(UNCHANGED))
    )
    if on_duplicate == "flag":
        op = F.when((F.col(OLD_COPIES) > 1) | (F.col(NEW_COPIES) > 1), F.lit(AMBIGUOUS)).otherwise(op)
    return pairs.withColumn("op", op).withColumn(
        "changed", F.when(F.col("op") == UPDATE, changed).otherwise(F.array().cast("array<string>"))
    )


def _changed_pairs(old: DataFrame, new: DataFrame, pk: list[str], mode: str, options: dict) -> DataFrame:
    """Pairs that differ. A repeated key has no single pair, and a result without
    an op column has no place to say so: ``change_set`` reports such keys."""
    if options.get("on_duplicate") == "flag":
        raise ValueError("repeated keys can only be flagged in a change set (change_set with on_duplicate='flag')")
    return compare_rows(old, new, pk, mode=mode, how="inner", **options).filter(F.col("op") == UPDATE)


def rows_changed(old: DataFrame, new: DataFrame, pk: list[str], mode: str = TYPED, **options) -> DataFrame:
    """New rows that match an old key and differ in at least one new column."""
    pairs = _changed_pairs(old, new, pk, mode, options)
    columns = _value_columns(new, pk, options.get("tombstone", TOMBSTONE))
    return pairs.select(*pk, *[new_side(c).alias(c) for c in columns])


def row_equal(old: DataFrame, new: DataFrame, pk: list[str], mode: str = TYPED, tombstone: str = TOMBSTONE) -> DataFrame:
    """Whole-row equality of matched rows, whatever the column order: false if
    the column sets or the tombstones differ."""
    old, new = align_names(old, pk), align_names(new, pk)
    flag = F.lit(False)
    old = old if find_column(old, tombstone) else old.withColumn(tombstone, flag)
    new = new if find_column(new, tombstone) else new.withColumn(tombstone, flag)
    old = align_names(old, new.columns)
    values_old, values_new = _value_columns(old, pk, tombstone), _value_columns(new, pk, tombstone)
    same_header = {c.lower() for c in values_old} == {c.lower() for c in values_new}
    pairs = pair_states(old, new, pk, how="inner")
    conditions = [cell_equal(old_side(c), new_side(c), mode) for c in values_new] if same_header else [F.lit(False)]
    conditions.append(old_side(tombstone).eqNullSafe(new_side(tombstone)))
    return pairs.select(*pk, all_of(conditions).alias("equal"))


def changed_columns(old: DataFrame, new: DataFrame, pk: list[str], mode: str = TYPED, **options) -> DataFrame:
    """Key, changed column names, and new values of the changed columns only."""
    pairs = _changed_pairs(old, new, pk, mode, options)
    columns = _value_columns(new, pk, options.get("tombstone", TOMBSTONE))
    values = [F.when(F.array_contains("changed", c), new_side(c)).alias(c) for c in columns]
    return pairs.select(*pk, "changed", *values)


def cell_changes(old: DataFrame, new: DataFrame, pk: list[str], mode: str = TYPED, **options) -> DataFrame:
    """One row per changed cell: key, column name, old text, new text."""
    pairs = _changed_pairs(old, new, pk, mode, options)
    known = {c[len("__old_") :].lower(): c for c in pairs.columns if c.startswith("__old_")}
    cells = []  # one struct per column, NULL where the cell did not change
    for c in _value_columns(new, pk, options.get("tombstone", TOMBSTONE)):
        before = F.col(f"`{known[c.lower()]}`").cast("string") if c.lower() in known else F.lit(None).cast("string")
        cell = F.struct(
            F.lit(c).alias("column_name"), before.alias("old_value"), new_side(c).cast("string").alias("new_value")
        )
        cells.append(F.when(F.array_contains("changed", c), cell))
    long = pairs.select(*pk, F.explode(F.array(*cells)).alias("cell"))
    return long.filter(F.col("cell").isNotNull()).select(*pk, "cell.*")


# -- change sets --------------------------------------------------------------


def change_set(
    old: DataFrame,
    new: DataFrame,
    pk: list[str],
    *,
    table: str = "",
    dep_rank: int = 0,
    mode: str = TYPED,
    tombstone: str = TOMBSTONE,
    on_duplicate: str = "fail",
    null_keys: bool = True,
    keep_unchanged: bool = False,
) -> DataFrame:
    """All inserts, updates and deletes in one pass.

    Columns: ``table, stage, dep_rank, op, key, changed, before, after`` where
    stage 2 holds deletes and stage 4 updates and inserts.
    """
    pairs = compare_rows(
        old, new, pk, mode=mode, tombstone=tombstone, on_duplicate=on_duplicate, null_keys=null_keys
    )
    if not keep_unchanged:
        pairs = pairs.filter(F.col("op") != UNCHANGED)
    before = F.struct(*[old_side(c).alias(c) for c in _value_columns(old, pk, tombstone)] or [F.lit(True).alias("_")])
    after = F.struct(*[new_side(c).alias(c) for c in _value_columns(new, pk, tombstone)] or [F.lit(True).alias("_")])
    columns = [
        F.lit(table).alias("table"),
        F.when(F.col("op") == DELETE, F.lit(DELETE_STAGE)).otherwise(F.lit(UPSERT_STAGE)).alias("stage"),
        F.lit(dep_rank).alias("dep_rank"),
        "op",
        F.struct(*pk).alias("key"),
        "changed",
        F.when(F.col(IN_OLD), before).alias("before"),
        F.when(F.col(IN_NEW), after).alias("after"),
    ]
    if on_duplicate == "flag":
        columns += [F.col(OLD_COPIES).alias("old_copies"), F.col(NEW_COPIES).alias("new_copies")]
    return pairs.select(*columns)


def tombstones(old: DataFrame, new: DataFrame, pk: list[str], flag: str = TOMBSTONE) -> DataFrame:
    """What the flags of the new state make of each key.

    ``op`` as in a change set; a flagged key that the old state lacks is N, as
    there is nothing to delete.
    """
    old = live_rows(align_names(old, pk), flag)
    new = align_names(new, pk)
    new = align_names(new, [flag])
    old_columns, new_columns = _value_columns(old, pk, flag), _value_columns(new, pk, flag)
    pairs = pair_states(old, new, pk, old_columns=old_columns, new_columns=[*new_columns, flag])
    dead = F.coalesce(new_side(flag), F.lit(False))
    differs = any_of(list(_differences(old_columns, new_columns, TYPED).values()))
    op = (
        F.when(dead & F.col(IN_OLD), F.lit(DELETE))
        .when(dead, F.lit(UNCHANGED))
        .when(~F.col(IN_OLD), F.lit(INSERT))
        .when(~F.col(IN_NEW), F.lit(DELETE))
        .when(differs, F.lit(UPDATE))
        .otherwise(F.lit(UNCHANGED))
    )
    return pairs.select(*pk, dead.alias("flagged"), op.alias("op"))


def diff_column_renames(
    old: DataFrame, new: DataFrame, pk: list[str], renames: dict[str, str], **options
) -> DataFrame:
    """Change set where new columns declare their former names.

    ``renames`` maps former name to new name. Values are compared under the new
    name, so a bare rename is no change while a changed value still is.
    """
    for former, current in renames.items():
        if find_column(old, former) is None:
            raise ValueError(f"former name {former!r} is not in the old state")
        if find_column(new, former) is not None:
            raise ValueError(f"the new state still has a column {former!r}")
        if find_column(new, current) is None:
            raise ValueError(f"renamed column {current!r} is not in the new state")
    renamed = old.withColumnsRenamed({find_column(old, f): c for f, c in renames.items()})
    return change_set(renamed, new, pk, **options)


def diff_key_change(old: DataFrame, new: DataFrame, new_pk: list[str], **options) -> DataFrame:
    """Change set when the key differs between versions: rows match on the new
    key, without those of its columns that the old state lacks."""
    shared = [k for k in new_pk if find_column(old, k) is not None]
    if not shared:
        raise ValueError("no column of the new key exists in the old state")
    return change_set(old, new, shared, **options)


def _former_name(spec: TableSpec) -> str:
    return f"{spec.old_schema or spec.schema}.{spec.old_name}"


def match_tables(old: dict, new: dict, specs: dict[str, TableSpec]) -> list[tuple[str, str | None, str | None]]:
    """(reported name, old name, new name) for the union of both states' tables,
    following declared former names. Names are ``schema.table``."""
    former = {}
    for name, spec in specs.items():
        if not spec.old_name or name not in new:
            continue
        source = _former_name(spec)
        if source not in old:
            raise ValueError(f"{name}: the old state has no table {source}")
        if f"{spec.schema}.{spec.old_name}" in new:
            raise ValueError(f"{name}: the new state still has a table {spec.old_name}")
        former[name] = source
    matched = [(name, former.get(name, name if name in old else None), name) for name in new]
    taken = {o for _, o, _ in matched if o}
    return matched + [(name, name, None) for name in old if name not in taken]


def diff_table_renames(old: dict, new: dict, specs: dict[str, TableSpec], **options) -> DataFrame:
    """Change set over tables, renamed ones compared with their former selves."""
    renamed = {n: s for n, s in specs.items() if s.old_name and n in new}
    pairs = [p for p in match_tables(old, new, specs) if p[0] in renamed]
    return diff_many_tables(
        {o: old[o] for _, o, _ in pairs}, {n: new[n] for _, _, n in pairs}, {n: specs[n] for n in renamed}, **options
    )


# Times keep their microseconds, and NULL fields stay in the text.
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
SORT_KEY = "sort_key"


def sortable_text(value: Column, kind: T.DataType) -> Column:
    """Text that sorts as the value does; NULL sorts first."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text = F.lpad((value.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    elif isinstance(kind, T.DecimalType):
        wide = T.DecimalType(38, kind.scale)
        shifted = value.cast(wide) + F.lit("1" + "0" * (kind.precision - kind.scale)).cast(wide)
        text = F.lpad(shifted.cast("string"), kind.precision + 2, "0")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return sortable_text(F.unix_micros(value.cast("timestamp")), T.LongType())
    elif isinstance(kind, T.DateType):
        return sortable_text(F.unix_date(value), T.IntegerType())
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        # Sign, exponent and digits: as many digits as tell any two values apart. 0 stands below all exponents.
        wide = value.cast("double")
        written = F.format_string("%.17e", F.abs(wide))
        exponent = F.when(wide == 0, F.lit(0)).otherwise(F.substring(written, 21, 5).cast("int") + 400)
        size = F.concat(F.lpad(exponent.cast("string"), 3, "0"), F.substring(written, 1, 19))
        flipped = F.translate(size, "0123456789", "9876543210")
        text = F.when(wide < 0, F.concat(F.lit("0"), flipped)).otherwise(F.concat(F.lit("1"), size))
        far = F.lit(float("inf"))
        text = F.when(F.isnan(value), F.lit("2")).when(value == far, F.lit("1~")).when(value == -far, F.lit("0")).otherwise(text)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), text))


def sort_key(key: Column, kind: T.StructType) -> Column:
    """The fields of a key as an array that sorts as the key does, whatever its type."""
    return F.array(*[sortable_text(key[f.name], f.dataType) for f in kind.fields])


def foreign_key_ranks(specs: dict[str, TableSpec]) -> dict[str, int]:
    """Rank of each table: 0 if it refers to no other, else one above the highest
    it refers to. Tables that refer to each other in a circle are an error."""
    refers = {}
    for name, spec in specs.items():
        targets = {fk.ref_table if "." in fk.ref_table else f"{spec.schema}.{fk.ref_table}" for fk in spec.foreign_keys}
        refers[name] = {t for t in targets if t in specs and t != name}
    ranks: dict[str, int] = {}
    for name in dependency_order(refers):
        ranks[name] = max((ranks[t] + 1 for t in refers[name]), default=0)
    return ranks


def diff_many_tables(
    old: dict[str, DataFrame],
    new: dict[str, DataFrame],
    specs: dict[str, TableSpec],
    *,
    ranks: dict[str, int] | None = None,
    tables: list[str] | None = None,
    table_options: dict[str, dict] | None = None,
    **options,
) -> DataFrame:
    """One change set for the union of both states' tables.

    Row contents become JSON text, NULL fields included, so that tables of any
    shape share one schema; ``sort_key`` holds the key in its own order, and
    :func:`table_changes` gives back one table's typed changes. Without ``ranks``
    they follow from the specs' foreign keys. ``tables`` restricts the work; a table left out is never read. A table in
    only one state yields all its rows as inserts or deletes. ``options`` go to
    every comparison, ``table_options`` to that of one table.
    """
    wanted = None if tables is None else {t if "." in t else f"public.{t}" for t in tables}
    ranks = foreign_key_ranks(specs) if ranks is None else ranks
    parts = []
    for name, old_name, new_name in match_tables(old, new, specs):
        if wanted is not None and name not in wanted:
            continue
        spec = specs[name]
        pk = list(spec.primary_key)
        rank = ranks.get(name, 0)
        if old_name is None:
            part = fresh_rows(new[new_name], pk, table=name, dep_rank=rank)
        elif new_name is None:
            part = reverse_change_set(fresh_rows(old[old_name], pk, table=name, dep_rank=rank))
        else:
            chosen = {**options, **(table_options or {}).get(name, {})}
            part = change_set(old[old_name], new[new_name], pk, table=name, dep_rank=rank, **chosen)
        parts.append(
            part.select(
                "table",
                "stage",
                "dep_rank",
                "op",
                F.to_json("key", JSON_OPTIONS).alias("key"),
                "changed",
                F.to_json("before", JSON_OPTIONS).alias("before"),
                F.to_json("after", JSON_OPTIONS).alias("after"),
                sort_key(F.col("key"), part.schema["key"].dataType).alias(SORT_KEY),
            )
        )
    if not parts:
        raise ValueError("no table to compare")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def _json_type(state: DataFrame | None, names: list[str]) -> T.StructType:
    fields = {} if state is None else {f.name.lower(): f for f in state.schema.fields}
    return T.StructType([T.StructField(n, fields[n.lower()].dataType) for n in names if n.lower() in fields])


def table_changes(
    changes: DataFrame, table: str, pk: list[str], old: DataFrame | None, new: DataFrame | None, tombstone: str = TOMBSTONE
) -> DataFrame:
    """Typed change set of one table out of that of many.

    ``old`` and ``new`` only lend their schemas; either may be missing. The
    result is what :func:`change_set` gives for the table.
    """
    if old is None and new is None:
        raise ValueError("the schema of a state is needed")
    kinds = {"key": _json_type(new if new is not None else old, pk)}
    for side, state in (("before", old), ("after", new)):
        names = [] if state is None else _value_columns(align_names(state, pk), pk, tombstone)
        kinds[side] = _json_type(state, names) if names else T.StructType([T.StructField("_", T.BooleanType())])
    own = changes.filter(F.col("table") == table)
    typed = [F.from_json(c, kind, JSON_OPTIONS).alias(c) if (kind := kinds.get(c)) else F.col(c) for c in own.columns]
    return own.select(*[c for c, name in zip(typed, own.columns) if name != SORT_KEY])


def fresh_rows(state: DataFrame, pk: list[str], *, table: str = "", dep_rank: int = 0, tombstone: str = TOMBSTONE) -> DataFrame:
    """Change set from nothing to a state: every live row is an insert. A plain
    projection; nothing is joined or moved."""
    live = live_rows(align_names(state, pk), tombstone)
    columns = _value_columns(live, pk, tombstone)
    row = F.struct(*[F.col(f"`{c}`") for c in columns] or [F.lit(True).alias("_")])
    kind = T.StructType([live.schema[c] for c in columns] or [T.StructField("_", T.BooleanType())])
    return live.select(
        F.lit(table).alias("table"),
        F.lit(UPSERT_STAGE).alias("stage"),
        F.lit(dep_rank).alias("dep_rank"),
        F.lit(INSERT).alias("op"),
        F.struct(*pk).alias("key"),
        F.array().cast("array<string>").alias("changed"),
        F.lit(None).cast(kind).alias("before"),
        row.alias("after"),
    )


# -- order, summary, application ----------------------------------------------


def order_columns(ranks: dict[str, int] | None = None, key: str = "key") -> list[Column]:
    """Sort order of a change set: deletes against dependency order, then
    updates before inserts along it, each table by ``key``."""
    rank = F.col("dep_rank")
    if ranks:
        known = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
        rank = F.coalesce(known[F.col("table")], rank)
    op_rank = F.when(F.col("op") == DELETE, 0).when(F.col("op") == UPDATE, 1).otherwise(2)
    return [
        F.col("stage"),
        F.when(F.col("op") == DELETE, -rank).otherwise(rank),
        F.col("table"),
        op_rank,
        F.col(key),
    ]


def run_order(changes: DataFrame, ranks: dict[str, int] | None = None) -> list[Column]:
    """Sort order of a change set of one table or of many."""
    return order_columns(ranks, SORT_KEY if SORT_KEY in changes.columns else "key")


def ordered_change_set(changes: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """Change set in the order in which it has to be run (a range sort)."""
    return changes.orderBy(*run_order(changes, ranks))


def diff_summary(changes: DataFrame, per_column: bool = False) -> DataFrame:
    """Counts per table and op, with totals; or per table and changed column."""
    if per_column:
        return (
            changes.select("table", F.explode("changed").alias("column_name"))
            .groupBy("table", "column_name")
            .agg(F.count(F.lit(1)).alias("n"))
        )
    return (
        changes.rollup("table", "op")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.coalesce("table", F.lit("*")).alias("table"), F.coalesce("op", F.lit("*")).alias("op"), "n")
    )


def apply_change_set(state: DataFrame, changes: DataFrame, pk: list[str], tombstone: str = TOMBSTONE) -> DataFrame:
    """The state after the changes.

    Deletes and updates meet the state in one left join, in which Spark
    broadcasts the changes if they are measured to be small, so the state need
    not move for a small patch. Inserts are appended. The changes are read
    twice, so hand over a written change set rather than a diff yet to be run.
    """
    state = live_rows(align_names(state, pk), tombstone)
    after = next(f.dataType for f in changes.schema.fields if f.name == "after")
    columns = [f.name for f in after.fields if f.name != "_"]
    edits = changes.filter(F.col("op").isin(UPDATE, DELETE)).select(
        *[F.col(f"key.`{k}`").alias(f"__c_{k}") for k in pk],
        F.col("op").alias("__op"),
        F.col("changed").alias("__changed"),
        F.col("after").alias("__after"),
    )
    same_key = all_of([state[f"`{k}`"].eqNullSafe(edits[f"`__c_{k}`"]) for k in pk])
    touched = state.join(edits, same_key, "left").filter(~F.col("__op").eqNullSafe(F.lit(DELETE)))
    kept = []
    for c in columns:
        current = find_column(state, c)
        base = F.col(f"`{current}`") if current else F.lit(None)
        update = F.coalesce(F.array_contains("__changed", c), F.lit(False))
        kept.append(F.when(update, F.col("__after")[c]).otherwise(base).alias(c))
    inserts = changes.filter(F.col("op") == INSERT).select(
        *[F.col(f"key.`{k}`").alias(k) for k in pk], *[F.col("after")[c].alias(c) for c in columns]
    )
    return touched.select(*[F.col(f"`{k}`") for k in pk], *kept).unionByName(inserts)


def apply_many(
    states: dict[str, DataFrame], changes: DataFrame, specs: dict[str, TableSpec], new: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """Every table after a change set of many tables, under its new name.

    ``new`` lends the schemas of the tables there are afterwards; tables without
    one are gone. Renamed tables start from their former selves.
    """
    out = {}
    for name, old_name, new_name in match_tables(states, new, specs):
        if new_name is None:
            continue
        pk = list(specs[name].primary_key)
        start = states[old_name] if old_name else align_names(new[new_name], pk).limit(0)
        own = table_changes(changes, name, pk, states.get(old_name) if old_name else None, new[new_name])
        out[new_name] = apply_change_set(start, own, pk)
    return out


def multiset_gap(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, with the surplus (negative where
    ``actual`` has more). One grouped pass, combined before its shuffle."""
    columns = expected.columns
    both = expected.select(*columns, F.lit(1).alias("__n")).unionByName(
        actual.select(*columns, F.lit(-1).alias("__n"))
    )
    return both.groupBy(*columns).agg(F.sum("__n").alias("surplus")).filter(F.col("surplus") != 0)


def round_trip_check(old: DataFrame, new: DataFrame, pk: list[str], **options) -> DataFrame:
    """Apply the diff to the old state and compare with the new one: numbers of
    missing and of unexpected rows, both 0 when the round trip holds.

    Rows meet on their key, so only keys decide where they go. A row whose
    values differ is missing in one form and unexpected in the other.
    """
    # Written down once: the application reads it twice.
    changes = cut_lineage(change_set(old, new, pk, **options))
    expected = live_rows(align_names(new, pk), options.get("tombstone", TOMBSTONE))
    actual = align_names(apply_change_set(old, changes, pk), expected.columns).select(*expected.columns)
    pairs = pair_states(actual, expected, pk, on_duplicate="trust")  # the change set has proved both unique
    values = [c for c in expected.columns if c not in pk]
    same = all_of([old_side(c).eqNullSafe(new_side(c)) for c in values])
    missing = F.col(IN_NEW) & (~F.col(IN_OLD) | ~same)
    unexpected = F.col(IN_OLD) & (~F.col(IN_NEW) | ~same)
    return pairs.agg(F.count_if(missing).alias("missing_rows"), F.count_if(unexpected).alias("unexpected_rows"))


def reverse_change_set(changes: DataFrame) -> DataFrame:
    """The change set that takes the new state back to the old one."""
    op = (
        F.when(F.col("op") == INSERT, F.lit(DELETE)).when(F.col("op") == DELETE, F.lit(INSERT)).otherwise(F.col("op"))
    )
    return changes.select(
        "table",
        F.when(op == DELETE, F.lit(DELETE_STAGE)).otherwise(F.lit(UPSERT_STAGE)).alias("stage"),
        "dep_rank",
        op.alias("op"),
        "key",
        "changed",
        F.col("after").alias("before"),
        F.col("before").alias("after"),
    )
