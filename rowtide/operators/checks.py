"""Constraint checks: find the rows that break a declared rule.

Key rules group on the key before anything moves, so a value that fills a third
of the table arrives as one row per map task. Row rules are filters; many of
them over one table share one scan in :func:`constraint_report`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowtide.functions.cells import all_of, any_of, texts_present
from rowtide.functions.text import strip_check
from rowtide.functions.types import length_limit, spark_type
from rowtide.operators.diff import JSON_OPTIONS
from rowtide.operators.graph import reachable
from rowtide.operators.pairing import align_names
from rowtide.session import cut_lineage
from rowtide.spec import DomainSpec, EnumSpec, ForeignKeySpec, TableSpec, UniqueSpec

PRIMARY, FOREIGN, OTHER = "primary", "foreign", "other"
KINDS = (PRIMARY, FOREIGN, OTHER)


# -- keys ---------------------------------------------------------------------


def check_primary_key(df: DataFrame, pk: list[str], name: str = "primary_key") -> DataFrame:
    """Keys that hold a NULL or occur more than once, with their row count."""
    groups = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("n"))
    violation = F.when(any_of([F.col(k).isNull() for k in pk]), "null").when(F.col("n") > 1, "duplicate")
    return groups.select(F.lit(name).alias("constraint_name"), *pk, violation.alias("violation"), "n").filter(
        F.col("violation").isNotNull()
    )


def check_unique(df: DataFrame, columns: list[str], name: str = "unique") -> DataFrame:
    """Values that occur more than once; a NULL differs from every value."""
    return check_partial_unique(df, UniqueSpec(name, tuple(columns)))


def check_partial_unique(df: DataFrame, rule: UniqueSpec) -> DataFrame:
    """Unique over columns and expressions, within the rows of a predicate."""
    if rule.where:
        df = df.filter(F.expr(strip_check(rule.where)))
    terms = [F.col(c).alias(c) for c in rule.columns]
    terms += [F.expr(e).alias(f"expression_{i + 1}") for i, e in enumerate(rule.expressions)]
    keys = df.select(*terms)
    whole = keys.filter(all_of([F.col(c).isNotNull() for c in keys.columns]))
    return (
        whole.groupBy(*keys.columns)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select(F.lit(rule.name).alias("constraint_name"), *keys.columns, "n")
    )


def orphan_keys(child: DataFrame, parent: DataFrame, columns: list[str], ref_columns: list[str]) -> DataFrame:
    """Key values of the child that the parent lacks, with their row count. Any
    NULL in the key passes."""
    child, parent = align_names(child, columns), align_names(parent, ref_columns)
    used = (
        child.select(*columns)
        .filter(all_of([F.col(c).isNotNull() for c in columns]))
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = parent.select(*[F.col(r).alias(f"__r{i}") for i, r in enumerate(ref_columns)])
    return used.join(known, all_of([F.col(c) == F.col(f"__r{i}") for i, c in enumerate(columns)]), "left_anti")


def check_foreign_key(child: DataFrame, parent: DataFrame, fk: ForeignKeySpec, detail: str = "keys") -> DataFrame:
    """Orphans of a foreign key: ``keys`` gives each missing key with its number
    of rows, ``rows`` the child rows themselves."""
    columns = list(fk.columns)
    orphans = orphan_keys(child, parent, columns, list(fk.target_columns))
    name = F.lit(fk.name).alias("constraint_name")
    if detail == "keys":
        return orphans.select(name, *columns, "n")
    if detail != "rows":
        raise ValueError(f"unknown detail {detail!r}")
    missing = orphans.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(columns)])
    match = all_of([F.col(c) == F.col(f"__o{i}") for i, c in enumerate(columns)])
    return child.join(missing, match, "left_semi").select(name, *child.columns)


# -- rows ---------------------------------------------------------------------


def _violating(df: DataFrame, condition: Column, name: str) -> DataFrame:
    return df.filter(condition).select(F.lit(name).alias("constraint_name"), *df.columns)


def _counts(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(constraint_name, kind, violations) of many row rules in one pass."""
    once = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"__{i}") for i, (_, _, c) in enumerate(rules)])
    rows = [
        F.struct(F.lit(n).alias("constraint_name"), F.lit(k).alias("kind"), F.col(f"__{i}").alias("violations"))
        for i, (n, k, _) in enumerate(rules)
    ]
    return once.select(F.inline(F.array(*rows)))


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of NULLs in each column that must not hold any, in one pass."""
    counts = _counts(df, [(c, OTHER, F.col(c).isNull()) for c in columns])
    return counts.filter(F.col("violations") > 0).select(
        F.concat(F.col("constraint_name"), F.lit("_not_null")).alias("constraint_name"),
        F.col("constraint_name").alias("column_name"),
        F.col("violations").alias("n"),
    )


def breaks_check(predicate: str) -> Column:
    """True where the predicate is false; one that is NULL passes."""
    return F.expr(strip_check(predicate)) == F.lit(False)


def check_expression(df: DataFrame, name: str, predicate: str) -> DataFrame:
    return _violating(df, breaks_check(predicate), name)


def outside_enum(value: Column, enum: EnumSpec) -> Column:
    return value.isNotNull() & ~value.isin(*enum.values)


def check_enum(df: DataFrame, column: str, enum: EnumSpec) -> DataFrame:
    return _violating(df, outside_enum(F.col(column), enum), enum.name)


def misfit(text: Column, declared: str) -> Column:
    """True where a text does not fit the declared type or its length."""
    limit = length_limit(declared)
    if limit is not None:
        return F.length(text) > limit
    return text.isNotNull() & text.try_cast(spark_type(declared)).isNull()


def check_type_fit(df: DataFrame, column: str, declared: str, name: str | None = None) -> DataFrame:
    return _violating(df, misfit(F.col(column), declared), name or f"{column}_type")


def _about(predicate: str, value: str) -> str:
    """The predicate with ``VALUE`` put as the given name, outside quoted texts."""
    pieces = re.split(r"('(?:[^']|'')*')", strip_check(predicate))
    return "".join(p if i % 2 else re.sub(r"\bvalue\b", value, p, flags=re.I) for i, p in enumerate(pieces))


def with_domain_violations(df: DataFrame, column: str, domain: DomainSpec, name: str = "violations") -> DataFrame:
    """Adds the names of the domain rules each value breaks: ``type``,
    ``not_null`` and the named checks, in which ``VALUE`` stands for the value."""
    value = F.col(column)
    rules = [F.when(misfit(value.cast("string"), domain.base_type), F.lit("type"))]
    if not domain.nullable:
        rules.append(F.when(value.isNull(), F.lit("not_null")))
    for check in domain.checks:
        broken = F.expr(_about(check.predicate, "__value")) == F.lit(False)
        rules.append(F.when(broken, F.lit(check.name)))
    typed = df.withColumn("__value", value.try_cast(spark_type(domain.base_type)))
    return typed.withColumn(name, texts_present(rules)).drop("__value")


def check_domain(df: DataFrame, column: str, domain: DomainSpec) -> DataFrame:
    """One row per row and broken rule of the domain."""
    broken = with_domain_violations(df, column, domain, "__broken")
    return broken.select(
        F.lit(domain.name).alias("constraint_name"), *df.columns, F.explode("__broken").alias("violation")
    )


def check_partition_rule(df: DataFrame, key: str, part: str, parts: int, name: str = "partition_rule") -> DataFrame:
    """Rows that lie in another partition than ``key % parts`` says."""
    expected = F.pmod(F.col(key), F.lit(parts))
    return _violating(df, ~F.col(part).eqNullSafe(expected.cast("bigint")), name)


def check_declared_columns(references: DataFrame, columns: DataFrame, on: list[str], column: str) -> DataFrame:
    """Referenced columns that the resolved columns of their table lack.

    ``columns`` are the effective columns, own and inherited; names ignore case.
    """
    known = columns.select(
        *[F.lower(F.col(c).cast("string")).alias(f"__{c}") for c in on], F.lower(column).alias("__column")
    )
    match = [F.lower(references[c].cast("string")) == known[f"__{c}"] for c in on]
    match.append(F.lower(references[column]) == known["__column"])
    return references.join(known, all_of(match), "left_anti")


# -- report -------------------------------------------------------------------


def _row_rules(spec: TableSpec) -> list[tuple[str, str, Column]]:
    rules = []
    for c in spec.columns:
        value = F.col(c.name)
        if not c.nullable:
            rules.append((f"{c.name}_not_null", OTHER, value.isNull()))
        if c.check:
            rules.append((f"{c.name}_check", OTHER, breaks_check(c.check)))
        if c.enum:
            rules.append((c.enum.name, OTHER, outside_enum(value, c.enum)))
        if c.type:
            rules.append((f"{c.name}_type", OTHER, misfit(value.cast("string"), c.type)))
    rules += [(k.name, OTHER, breaks_check(k.predicate)) for k in spec.checks]
    return rules


def _report_rows(found: DataFrame, name: str, kind: str) -> DataFrame:
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    return found.agg(total.alias("violations")).select(
        F.lit(name).alias("constraint_name"), F.lit(kind).alias("kind"), "violations"
    )


def constraint_report(
    tables: dict[str, DataFrame], specs: dict[str, TableSpec], kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """Violating rows per table and constraint, 0 where a constraint holds.

    All row rules of a table share one scan; each key rule is one aggregate over
    its key columns.
    """
    parts = []
    for name, df in tables.items():
        spec = specs[name]
        found = []
        if PRIMARY in kinds and spec.primary_key:
            keys = check_primary_key(df, list(spec.primary_key))
            found.append(_report_rows(keys, f"{spec.name}_pkey", PRIMARY))
        if OTHER in kinds:
            rules = _row_rules(spec)
            if rules:
                found.append(_counts(df, rules))
            found += [_report_rows(check_partial_unique(df, u), u.name, OTHER) for u in spec.uniques]
            for c in spec.columns:
                if c.domain:
                    broken = with_domain_violations(df, c.name, c.domain, "__broken")
                    count = broken.select(F.size("__broken").cast("bigint").alias("n"))
                    found.append(_report_rows(count, c.domain.name, OTHER))
        if FOREIGN in kinds:
            for fk in spec.foreign_keys:
                found.append(_report_rows(check_foreign_key(df, tables[fk.ref_table], fk), fk.name, FOREIGN))
        parts += [f.withColumn("table", F.lit(name)) for f in found]
    if not parts:
        raise ValueError("no constraint to check")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.select("table", "constraint_name", "kind", "violations")


# -- effects of changes on children -------------------------------------------

BLOCKED = "B"


def _new_key(action: str, current: Column, changed_to: Column, default: Column) -> Column:
    return {"CASCADE": changed_to, "SET NULL": F.lit(None), "SET DEFAULT": default}.get(action.upper(), current)


def _check_action(action: str) -> str:
    action = action.upper()
    if action not in ("CASCADE", "SET NULL", "SET DEFAULT", "RESTRICT", "NO ACTION"):
        raise ValueError(f"unknown foreign key action {action!r}")
    return action


def propagate_delete(
    deletes: DataFrame, child: DataFrame, fk: ForeignKeySpec, child_pk: list[str], defaults: dict | None = None
) -> DataFrame:
    """What deleting parent rows does to a child table.

    One row per affected child row: ``op`` D (cascade), U (key set to NULL or to
    its default) or B (restrict and no action: the delete is blocked), with the
    key columns before (``old_*``) and after (``new_*``).
    """
    action = _check_action(fk.on_delete)
    columns, target = list(fk.columns), list(fk.target_columns)
    gone = deletes.select(*[F.col(t).alias(f"__p{i}") for i, t in enumerate(target)]).distinct()
    match = all_of([F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)])
    hit = child.join(gone, match, "left_semi")
    op = {"CASCADE": "D", "SET NULL": "U", "SET DEFAULT": "U"}.get(action, BLOCKED)
    after = []
    for c in columns:
        kind = child.schema[c].dataType
        default = F.lit((defaults or {}).get(c)).cast(kind)
        after.append(_new_key(action, F.col(c), F.lit(None), default).cast(kind).alias(f"new_{c}"))
    return hit.select(
        F.lit(fk.name).alias("constraint_name"),
        *child_pk,
        F.lit(op).alias("op"),
        *[F.col(c).alias(f"old_{c}") for c in columns],
        *after,
    )


def propagate_update(
    updates: DataFrame, child: DataFrame, fk: ForeignKeySpec, child_pk: list[str], defaults: dict | None = None
) -> DataFrame:
    """The same for changed parent keys. ``updates`` has ``old_<column>`` and
    ``new_<column>`` for each referenced column."""
    action = _check_action(fk.on_update)
    columns, target = list(fk.columns), list(fk.target_columns)
    moved = updates.select(
        *[F.col(f"old_{t}").alias(f"__p{i}") for i, t in enumerate(target)],
        *[F.col(f"new_{t}").alias(f"__q{i}") for i, t in enumerate(target)],
    ).distinct()
    match = all_of([F.col(c) == F.col(f"__p{i}") for i, c in enumerate(columns)])
    op = BLOCKED if action in ("RESTRICT", "NO ACTION") else "U"
    after = []
    for i, c in enumerate(columns):
        kind = child.schema[c].dataType
        default = F.lit((defaults or {}).get(c)).cast(kind)
        after.append(_new_key(action, F.col(c), F.col(f"__q{i}"), default).cast(kind).alias(f"new_{c}"))
    return child.join(moved, match).select(
        F.lit(fk.name).alias("constraint_name"),
        *child_pk,
        F.lit(op).alias("op"),
        *[F.col(c).alias(f"old_{c}") for c in columns],
        *after,
    )


@dataclass(frozen=True)
class DeleteEffects:
    """What deleting rows does to all tables, by table name.

    ``deleted`` holds the keys that go, ``blocked`` the keys that would have gone
    but have to stay (with ``seed`` true where the delete was asked for), and
    ``updated`` the remaining rows whose reference is set to NULL or to its
    default, as :func:`propagate_delete` gives them.
    """

    deleted: dict[str, DataFrame]
    blocked: dict[str, DataFrame]
    updated: dict[str, DataFrame]


def _union(parts: list[DataFrame]) -> DataFrame:
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def delete_effects(
    seeds: dict[str, DataFrame],
    tables: dict[str, DataFrame],
    specs: dict[str, TableSpec],
    defaults: dict[str, dict] | None = None,
) -> DeleteEffects:
    """Carries deletes through cascading keys of any shape: chains, trees that
    refer to themselves, tables that refer to each other.

    A row that a key with RESTRICT still refers to stays; so does one that a row
    that stays refers to with NO ACTION. What stays keeps every row above it
    whose delete would have taken it along, and what only these would have taken
    along stays too. The links of cascading keys are made once, from one scan of each child table,
    and folded (see :func:`graph.reachable`), so rounds follow the logarithm of a
    chain's length.
    """
    pks = {n: list(specs[n].primary_key) for n in tables}

    def key(columns: list[Column], name: str) -> Column:
        """A row of a table by its key, whose values may come from elsewhere."""
        typed = [c.cast(tables[name].schema[k].dataType).alias(k) for c, k in zip(columns, pks[name], strict=True)]
        return F.struct(F.lit(name).alias("tbl"), F.to_json(F.struct(*typed), JSON_OPTIONS).alias("node"))

    def own_key(name: str) -> Column:
        return key([F.col(k) for k in pks[name]], name)

    def keys_of(found: DataFrame, name: str) -> DataFrame:
        kind = T.StructType([tables[name].schema[k] for k in pks[name]])
        return found.filter(F.col("id.tbl") == name).select(F.from_json("id.node", kind, JSON_OPTIONS).alias("k")).select("k.*")

    def rows_of(found: DataFrame, name: str) -> DataFrame:
        wanted = keys_of(found, name).select(*[F.col(k).alias(f"__k_{k}") for k in pks[name]])
        return tables[name].join(wanted, all_of([F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in pks[name]]), "left_semi")

    def references(actions: tuple[str, ...], found: DataFrame | None = None) -> DataFrame | None:
        """(id, foot): rows that refer to others by such keys, or to found ones alone, and the rows they refer to."""
        parts = []
        for child, spec in specs.items():
            for fk in spec.foreign_keys if child in tables else ():
                if fk.ref_table not in tables or _check_action(fk.on_delete) not in actions:
                    continue
                columns = [F.col(c) for c in fk.columns]
                if found is None and sorted(fk.target_columns) == sorted(pks[fk.ref_table]):
                    # The key of the parent stands in the child.
                    of = dict(zip(fk.target_columns, columns, strict=True))
                    named = all_of([c.isNotNull() for c in columns])
                    parent = key([of[k] for k in pks[fk.ref_table]], fk.ref_table)
                    parts.append(tables[child].filter(named).select(own_key(child).alias("id"), parent.alias("foot")))
                    continue
                above = tables[fk.ref_table] if found is None else rows_of(found, fk.ref_table)
                above = above.select(own_key(fk.ref_table).alias("foot"), *[F.col(t).alias(f"__p{i}") for i, t in enumerate(fk.target_columns)])
                hit = tables[child].join(above, all_of([c == F.col(f"__p{i}") for i, c in enumerate(columns)]))
                parts.append(hit.select(own_key(child).alias("id"), "foot"))
        return _union(parts).distinct() if parts else None

    start = [rows.select(own_key(n).alias("id")) for n, rows in seeds.items()]
    if not start:
        return DeleteEffects({}, {}, {})
    asked = cut_lineage(_union(start).distinct())
    links = references(("CASCADE",))
    reached, down = asked, None
    if links is not None:
        links = cut_lineage(links)
        reached = cut_lineage(reachable(asked, links))
        down = cut_lineage(links.join(reached.withColumnRenamed("id", "foot"), "foot", "left_semi"))

    hard = references(("RESTRICT",), reached)
    held = cut_lineage(hard.select(F.col("foot").alias("id")).distinct()) if hard is not None else reached.limit(0)
    soft = references(("NO ACTION",), reached)
    soft = cut_lineage(soft) if soft is not None else None
    gone = reached
    while True:
        if soft is not None:
            stays = soft.join(gone, "id", "left_anti").select(F.col("foot").alias("id"))
            held = cut_lineage(held.unionByName(stays).distinct())
        if down is not None and not held.isEmpty():
            up = down.select(F.col("foot").alias("id"), F.col("id").alias("foot"))
            held = cut_lineage(reachable(held, up))
        left = asked.join(held, "id", "left_anti")
        if down is not None and not held.isEmpty():
            left = reachable(left, down.join(held, "id", "left_anti"))
        elif down is not None:
            left = reached
        left = cut_lineage(left)
        before, gone = gone, left
        if soft is None or before.join(gone, "id", "left_anti").isEmpty():
            break

    stuck = cut_lineage(reached.join(gone, "id", "left_anti"))
    deleted = {n: keys_of(gone, n) for n in tables}
    blocked = {}
    for n in tables:
        wanted = keys_of(asked, n).select(*[F.col(k).alias(f"__a_{k}") for k in pks[n]], F.lit(True).alias("__asked"))
        match = all_of([F.col(k).eqNullSafe(F.col(f"__a_{k}")) for k in pks[n]])
        blocked[n] = keys_of(stuck, n).join(wanted, match, "left").select(*pks[n], F.coalesce("__asked", F.lit(False)).alias("seed"))
    updated = {}
    for child, spec in specs.items():
        for fk in spec.foreign_keys if child in tables else ():
            if fk.ref_table in tables and _check_action(fk.on_delete) in ("SET NULL", "SET DEFAULT"):
                pk = pks[child]
                rest = tables[child].join(
                    deleted[child].select(*[F.col(k).alias(f"__k_{k}") for k in pk]),
                    all_of([F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in pk]),
                    "left_anti",
                )
                effect = propagate_delete(rows_of(gone, fk.ref_table), rest, fk, pk, (defaults or {}).get(child))
                updated[child] = updated[child].unionByName(effect, allowMissingColumns=True) if child in updated else effect
    return DeleteEffects(deleted, blocked, updated)


def propagate_deletes(
    seeds: dict[str, DataFrame], tables: dict[str, DataFrame], specs: dict[str, TableSpec]
) -> dict[str, DataFrame]:
    """Keys that disappear from each table once cascades have run their course
    (see :func:`delete_effects`, which also tells what is blocked)."""
    return delete_effects(seeds, tables, specs).deleted
