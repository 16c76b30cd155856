"""Dependency ordering and lineage. Many graphs per job, one per group.

Work is done in rounds of joins whose inputs shrink. Between rounds the state is
checkpointed on reliable storage, so a round never re-runs its predecessors and
a lost executor costs one round. The driver sees only row counts.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.cells import all_of
from rowtide.functions.lexing import statement_tables
from rowtide.functions.text import name_object, name_schema
from rowtide.functions.types import reference_type
from rowtide.session import cut_lineage


def dependency_order(depends_on: dict[str, set[str]]) -> list[str]:
    """Names after what they depend on. For the handful of tables of a spec."""
    order: list[str] = []
    pending = {n: {d for d in ds if d in depends_on} for n, ds in depends_on.items()}
    while pending:
        ready = sorted(n for n, ds in pending.items() if ds <= set(order))
        if not ready:
            raise ValueError(f"dependency cycle among {sorted(pending)}")
        order += ready
        for n in ready:
            del pending[n]
    return order


# -- pointers: at most one successor per node ---------------------------------


def follow_pointers(links: DataFrame, keys: list[str], node: str, target: str) -> DataFrame:
    """Last node of the chain that starts at each node, and the steps to it.

    ``links`` holds keys, node and target with one row per node; a target that
    is nobody's node ends a chain. Every round doubles the length covered, so a
    chain of a thousand nodes takes ten rounds, and only nodes still on their
    way take part. Returns keys, node, ``last``, ``steps``, with NULLs for a
    node whose chain runs into a cycle.
    """
    moving = cut_lineage(
        links.select(*keys, F.col(node).alias("node"), F.col(target).alias("last"), F.lit(1).alias("steps"))
    )
    # No chain is longer than the largest group.
    sizes = moving.groupBy(*keys).count() if keys else moving.agg(F.count(F.lit(1)).alias("count"))
    longest = sizes.agg(F.max("count")).first()[0] or 0
    arrived = moving.limit(0)
    reach = 1
    while True:
        every = arrived.unionByName(moving)
        jump = every.select(
            *[F.col(k).alias(f"__{k}") for k in keys],
            F.col("node").alias("__node"),
            F.col("last").alias("__last"),
            F.col("steps").alias("__steps"),
        )
        same = all_of([F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("last") == F.col("__node")])
        state = cut_lineage(
            moving.join(jump, same, "left").select(
                *keys,
                "node",
                F.coalesce("__last", "last").alias("last"),
                (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"),
                F.col("__node").isNotNull().alias("__moved"),
            )
        )
        arrived = arrived.unionByName(state.filter(~F.col("__moved")).drop("__moved"))
        moving = state.filter("__moved").drop("__moved")
        if moving.isEmpty():
            return arrived
        # Before this round every pointer already covered the longest possible
        # chain, so what still moves goes round in a circle.
        if reach >= longest:
            endless = moving.select(
                *keys, "node", F.lit(None).cast(moving.schema["last"].dataType).alias("last"),
                F.lit(None).cast("int").alias("steps"),
            )
            return arrived.unionByName(endless)
        reach *= 2


# -- levels of a general graph ------------------------------------------------

# Levels carried up between two checkpoints; most graphs are shallow.
LEVELS_PER_ROUND = (3, 3, 4, 8)
# No path weighs as much; weights that go round a circle stop here.
_MOST = 1 << 40


def _same_keys(keys: list[str], *extra: Column) -> Column:
    return all_of([F.col(k) == F.col(f"__{k}") for k in keys] + list(extra))


def _renamed(df: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in columns])


def _raked(open_: DataFrame, keys: list[str], levels: int) -> DataFrame:
    """keys, node, level of all open nodes, after carrying levels up so many times; NULL
    until all that a node depends on is placed. A foot that is not open is ground."""
    state = open_.select(*keys, "node").distinct().withColumn("level", F.lit(None).cast("bigint"))
    for _ in range(levels):
        below = _renamed(state, keys, "node", "level")
        ground = F.col("foot").isNull() | F.col("__node").isNull()
        asks = F.col("weight") + F.when(ground, F.lit(0)).otherwise(F.col("__level"))
        state = (
            open_.join(below, _same_keys(keys, F.col("foot") == F.col("__node")), "left")
            .groupBy(*keys, "node")
            .agg(F.max(asks).alias("top"), F.bool_and(asks.isNotNull()).alias("all"))
            .select(*keys, "node", F.when(F.col("all"), F.col("top")).alias("level"))
        )
    return state


def _compressed(open_: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Open edges after one step: an edge to a placed node becomes the level it asks for, an edge
    to a node with a single open edge goes on along that one, and placed nodes leave."""
    foot, weight = F.col("foot"), F.col("weight")
    none = F.lit(None).cast(open_.schema["foot"].dataType)
    gone = _renamed(state.filter("level is not null"), keys, "node")
    below = _renamed(state, keys, "node", "level")
    still = F.col("__node").isNotNull() & F.col("__level").isNull()
    lean = (
        open_.join(gone, _same_keys(keys, F.col("node") == F.col("__node")), "left_anti")
        .join(below, _same_keys(keys, foot == F.col("__node")), "left")
        .groupBy(*keys, "node", F.when(still, foot).otherwise(none).alias("foot"))
        .agg(F.max(weight + F.coalesce("__level", F.lit(0))).alias("weight"))
    )
    single = (
        lean.groupBy(*keys, "node")
        .agg(
            F.count("foot").alias("fan"),
            F.max("foot").alias("next"),
            F.max(F.when(foot.isNotNull(), weight)).alias("step"),
            F.max(F.when(foot.isNull(), weight)).alias("asked"),
        )
        .filter("fan = 1")
    )
    passed = F.col("__node").isNotNull()

    def on(far: Column) -> Column:
        return F.when(far.isNotNull(), F.least(weight + far, F.lit(_MOST)))

    # Past a node with a single open edge: along that edge, and what the node asks for besides.
    ways = F.when(
        passed,
        F.array(F.struct(F.col("__next").alias("foot"), on(F.col("__step")).alias("weight")), F.struct(none.alias("foot"), on(F.col("__asked")).alias("weight"))),
    ).otherwise(F.array(F.struct(foot.alias("foot"), weight.alias("weight"))))
    moved = lean.join(_renamed(single, keys, "node", "next", "step", "asked"), _same_keys(keys, foot == F.col("__node")), "left")
    moved = moved.select(*keys, "node", F.explode(ways).alias("way")).filter("way.weight is not null")
    return moved.groupBy(*keys, "node", F.col("way.foot").alias("foot")).agg(F.max("way.weight").alias("weight"))


def _levels(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, level; the level is NULL for a node that cannot be placed.

    Every round rakes and compresses. Levels are carried up a few steps through
    the open edges; then edges to placed nodes turn into the level they ask for, so nodes
    may be left with a single open edge, and every edge into such a node goes on
    along it. Chains halve in each round, also those that appear only when the
    branches beside them are placed, so rounds follow the logarithm of a tree's size and
    not its depth. A round in which nothing can be placed leaves circles and what stands on
    them. A checkpoint holds open nodes only.
    """
    links = edges.filter(F.col("child") != F.col("parent"))
    open_ = cut_lineage(
        links.select(*keys, F.col("child").alias("node"), F.col("parent").alias("foot")).distinct().withColumn("weight", F.lit(1).cast("bigint"))
    )
    # Nodes without dependencies stand on level 0.
    any_ = _renamed(open_.select(*keys, "node").distinct(), keys, "node")
    ground = nodes.select(*keys, "node").distinct().join(any_, _same_keys(keys, F.col("node") == F.col("__node")), "left_anti")
    placed = ground.withColumn("level", F.lit(0).cast("bigint"))
    for turn in itertools.count():
        state = cut_lineage(_raked(open_, keys, LEVELS_PER_ROUND[min(turn, len(LEVELS_PER_ROUND) - 1)]))
        every, newly = state.agg(F.count(F.lit(1)), F.count("level")).first()
        if newly in (0, every):
            placed = placed.unionByName(state)
            return placed.withColumn("level", F.col("level").cast("int"))
        placed = placed.unionByName(state.filter("level is not null"))
        open_ = cut_lineage(_compressed(open_, state, keys))


# -- what can be reached ------------------------------------------------------

# Rounds that only go on to the next nodes; most cascades end before chains are folded.
PLAIN_ROUNDS = 1


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """``id`` of every node of ``start`` (id) and every node that leads to one of them along
    ``edges`` (id, foot).

    Every round settles the nodes whose edge ends at a node found in the last one. Then edges to
    nodes that lead nowhere are dropped, and an edge to an open node with a
    single edge goes on along that one, so chains halve each time. The edges are
    rewritten, never joined with the tables they come from; only nodes that are still
    open stay in a checkpoint. Circles end with the others, as a round that finds nothing is the last.
    """
    newly = cut_lineage(start.select("id").distinct())
    found = newly
    open_ = edges.select("id", "foot").filter("id <> foot").join(newly, "id", "left_anti").distinct()
    for turn in itertools.count():
        known = newly.select(F.col("id").alias("__id"))
        marked = open_.join(known, F.col("foot") == F.col("__id"), "left").select("id", "foot", F.col("__id").isNotNull().alias("hit"))
        marked = cut_lineage(marked)
        newly = cut_lineage(marked.filter("hit").select("id").distinct())
        if newly.isEmpty():
            return found
        found = found.unionByName(newly)
        open_ = marked.filter("not hit").select("id", "foot").join(newly, "id", "left_anti")
        if turn < PLAIN_ROUNDS:
            continue
        way = open_.groupBy("id").agg(F.count(F.lit(1)).alias("fan"), F.first("foot").alias("next")).withColumn("hit", F.lit(False))
        ends = way.unionByName(newly.select("id", F.lit(0).cast("bigint").alias("fan"), F.lit(None).cast(way.schema["next"].dataType).alias("next"), F.lit(True).alias("hit")))
        ends = ends.withColumnRenamed("id", "__id")
        passed = F.when((F.col("fan") == 1) & ~F.col("hit"), F.col("next")).otherwise(F.col("foot"))
        open_ = open_.join(ends, F.col("foot") == F.col("__id")).select("id", passed.alias("foot")).filter("id <> foot").distinct()


def _graph(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str, child: str, parent: str):
    edges = edges.select(*keys, F.col(child).alias("child"), F.col(parent).alias("parent"))
    ends = edges.select(*keys, F.col("child").alias("node")).unionByName(
        edges.select(*keys, F.col("parent").alias("node"))
    )
    return nodes.select(*keys, F.col(node).alias("node")).unionByName(ends), edges


def dependency_levels(
    nodes: DataFrame, edges: DataFrame, keys: list[str], node: str, child: str = "child", parent: str = "parent"
) -> DataFrame:
    """keys, node, ``level``: 0 without dependencies, else one more than the
    highest dependency. NULL for nodes on or above a cycle. An edge from a node
    to itself is left aside."""
    every, links = _graph(nodes, edges, keys, node, child, parent)
    return _levels(every, links, keys).withColumnRenamed("node", node)


def dependency_cycles(
    nodes: DataFrame, edges: DataFrame, keys: list[str], node: str, child: str = "child", parent: str = "parent"
) -> DataFrame:
    """Nodes that cannot be ordered (``cycle``), and nodes that refer to
    themselves (``self``), which is harmless."""
    every, links = _graph(nodes, edges, keys, node, child, parent)
    stuck = _levels(every, links, keys).filter(F.col("level").isNull())
    own = links.filter(F.col("child") == F.col("parent")).select(*keys, F.col("child").alias("node")).distinct()
    found = stuck.select(*keys, "node", F.lit("cycle").alias("reason")).unionByName(
        own.select(*keys, "node", F.lit("self").alias("reason"))
    )
    return found.withColumnRenamed("node", node)


def drop_order(levels: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Order in which to drop: dependents first."""
    top = levels.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max("level").alias("__top"))
    match = all_of([F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return levels.join(top, match).select(*keys, node, (F.col("__top") - F.col("level")).alias("drop_order"))


def view_order(views: DataFrame, dependencies: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(order, errors) of views.

    ``views`` has keys, schema_name, view_name; ``dependencies`` also the named
    view, bare (own schema) or ``schema.view``. A name that is no view is an
    error row; the others are placed after what they name.
    """
    full = F.concat_ws(".", F.lower("schema_name"), F.lower("view_name"))
    known = views.select(*keys, full.alias("view"))
    named = dependencies.select(
        *keys,
        full.alias("child"),
        F.concat_ws(
            ".", F.lower(name_schema(F.col("depends_on"), F.col("schema_name"))), F.lower(name_object(F.col("depends_on")))
        ).alias("parent"),
    )
    target = known.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("view").alias("__view")).distinct()
    match = all_of([F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("parent") == F.col("__view")])
    errors = named.join(target, match, "left_anti").select(
        *keys, F.col("child").alias("view"), F.col("parent").alias("unknown_view")
    )
    resolved = named.join(target, match, "left_semi")
    return dependency_levels(known, resolved, keys, "view"), errors


# -- references ---------------------------------------------------------------


def terminal_reference(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Type of each column, found by following references to a typed column.

    ``columns`` has keys, ``column_id``, ``data_type`` (NULL where the type
    comes from the reference) and ``references_id``. A generated type becomes
    the plain type that can refer to it. Returns keys, column_id, terminal_id,
    resolved_type and steps; the type is NULL where no typed column is reached.
    """
    links = columns.filter(F.col("data_type").isNull() & F.col("references_id").isNotNull())
    ends = follow_pointers(links, keys, "column_id", "references_id")
    typed = columns.filter(F.col("data_type").isNotNull()).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("column_id").alias("__id"), F.col("data_type").alias("__type")
    )
    match = all_of([F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("last") == F.col("__id")])
    found = ends.join(typed, match, "left").select(
        *keys,
        F.col("node").alias("column_id"),
        F.col("last").alias("terminal_id"),
        reference_type(F.col("__type")).alias("resolved_type"),
        "steps",
    )
    own = columns.filter(F.col("data_type").isNotNull() | F.col("references_id").isNull()).select(
        *keys,
        "column_id",
        F.col("column_id").alias("terminal_id"),
        F.col("data_type").alias("resolved_type"),
        F.lit(0).alias("steps"),
    )
    return own.unionByName(found)


def type_dependents(types: DataFrame, users: DataFrame, keys: list[str]) -> DataFrame:
    """Columns and functions that use a type, by bare or qualified name and as
    array element.

    ``types`` has keys, schema_name, type_name; ``users`` keys, kind, object and
    used_type. One equi-join serves both spellings.
    """
    spellings = types.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        "schema_name",
        "type_name",
        F.explode(
            F.array(F.lower("type_name"), F.concat_ws(".", F.lower("schema_name"), F.lower("type_name")))
        ).alias("__spelling"),
    )
    bare = F.lower(F.regexp_replace("used_type", r"[\[\] ]+$", ""))
    match = all_of([F.col(k) == F.col(f"__{k}") for k in keys] + [bare == F.col("__spelling")])
    return users.join(spellings, match).select(*keys, "schema_name", "type_name", "kind", "object").distinct()


_NAME = r'((?:"[^"]+"|[\w$]+)(?:\s*\.\s*(?:"[^"]+"|[\w$]+))*)'

def _bare(name: Column) -> Column:
    """A name without quotes and without blanks around its dots."""
    return F.nullif(F.regexp_replace(F.regexp_replace(name, r"\s*\.\s*", "."), '"', ""), F.lit(""))


# What names the table of a statement, in order of priority, and what only reads it.
_FIRST = ("from", "insert", "delete", "update", "merge", "truncate")
_READS = ("from", "join", "using")


def _comes_by(via: str):
    return lambda table: table["via"] == via


def statement_lineage(df: DataFrame, text: str) -> DataFrame:
    """Adds schema and table of the first table each statement names."""
    named = df.withColumn("__tables", statement_tables(F.col(text)))
    firsts = [F.get(F.filter("__tables", _comes_by(via)), F.lit(0))["name"] for via in _FIRST]
    named = named.withColumn("__name", F.coalesce(*firsts))
    name = F.col("__name")
    schema = F.when(name.isNotNull(), name_schema(name))
    return named.withColumn("table_schema", schema).withColumn("table_name", name_object(name)).drop("__name", "__tables")


def lineage(df: DataFrame, text: str) -> DataFrame:
    """One row for each table a statement reads or writes: the other columns,
    ``table_schema``, ``table_name``, and ``role``, which is ``read`` or ``write``."""
    role = F.when(F.col("t.via").isin(*_READS), "read").otherwise("write")
    found = df.withColumn("t", F.explode(statement_tables(F.col(text))))
    name = F.col("t.name")
    return found.select(*df.columns, name_schema(name).alias("table_schema"), name_object(name).alias("table_name"), role.alias("role")).distinct()


# A textual foreign key: the table it refers to, with or without a schema and
# columns; actions may follow.
REFERENCES_PATTERN = rf"\bREFERENCES\s+(?:ONLY\s+)?{_NAME}"


def referenced_name(definition: Column) -> Column:
    """Table named after REFERENCES as ``schema.table`` or bare, NULL if there is none."""
    return _bare(F.regexp_extract(definition, "(?is)" + REFERENCES_PATTERN, 1))


def affected_by_rename(
    constraints: DataFrame, renames: DataFrame, keys: list[str], default_schema: str = "public", reason: str | None = None
) -> DataFrame:
    """Constraints that refer to a renamed table and have to be rebuilt.

    ``constraints`` has keys, constraint_name, ref_schema, ref_table (typed) and
    definition (text form); ``renames`` keys, schema_name, table_name of the
    tables under their new names. A bare name means the default schema. Given a
    name for ``reason``, that column is added, and constraints whose text names no
    table come back too, as ``unreadable``, beside those that are ``renamed``.
    """
    name = referenced_name(F.col("definition"))
    schema = F.coalesce("ref_schema", F.when(F.col("ref_table").isNull(), name_schema(name, F.lit(default_schema))), F.lit(default_schema))
    table = F.coalesce("ref_table", name_object(name))
    named = constraints.withColumn("__schema", F.lower(schema)).withColumn("__table", F.lower(table))
    target = renames.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.lower("schema_name").alias("__to_schema"),
        F.lower("table_name").alias("__to_table"),
    )
    match = all_of(
        [F.col(k) == F.col(f"__{k}") for k in keys]
        + [F.col("__schema") == F.col("__to_schema"), F.col("__table") == F.col("__to_table")]
    )
    found = named.join(target, match, "left_semi")
    if reason:
        unread = named.filter(F.col("__table").isNull()).withColumn(reason, F.lit("unreadable"))
        found = found.withColumn(reason, F.lit("renamed")).unionByName(unread)
    return found.drop("__schema", "__table")
