"""Grants and roles, as aggregation jobs over exported permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.cells import all_of
from rowtide.functions.text import parse_array_literal

# Permission letters of an access list.
ACL_CODES = {
    "a": "INSERT",
    "r": "SELECT",
    "w": "UPDATE",
    "d": "DELETE",
    "D": "TRUNCATE",
    "x": "REFERENCES",
    "t": "TRIGGER",
    "C": "CREATE",
    "c": "CONNECT",
    "T": "TEMPORARY",
    "X": "EXECUTE",
    "U": "USAGE",
    "s": "SET",
    "A": "ALTER SYSTEM",
}

# Permissions the database knows, and those each kind of object takes.
PERMISSIONS = (
    "ALL",
    "SELECT",
    "INSERT",
    "UPDATE",
    "DELETE",
    "TRUNCATE",
    "REFERENCES",
    "TRIGGER",
    "CREATE",
    "CONNECT",
    "TEMPORARY",
    "EXECUTE",
    "USAGE",
)
VALID_PERMISSIONS = {
    "schema": ("ALL", "USAGE", "CREATE"),
    "table": (
        "ALL",
        "SELECT",
        "INSERT",
        "UPDATE",
        "DELETE",
        "TRUNCATE",
        "REFERENCES",
        "TRIGGER",
        "CREATE TABLE",
        "ALTER",
    ),
    "view": ("ALL", "SELECT"),
    "sequence": ("ALL", "USAGE", "SELECT", "UPDATE"),
    "function": ("ALL", "EXECUTE"),
}

# Roles the database defines itself.
BUILTIN_ROLES = (
    "pg_read_all_data",
    "pg_write_all_data",
    "pg_read_all_settings",
    "pg_read_all_stats",
    "pg_stat_scan_tables",
    "pg_monitor",
    "pg_database_owner",
    "pg_signal_backend",
    "pg_read_server_files",
    "pg_write_server_files",
    "pg_execute_server_program",
    "pg_checkpoint",
    "pg_use_reserved_connections",
    "pg_create_subscription",
)

# Role macros.
PUBLIC, PGSQL = "PUBLIC", "PGSQL"
ROLE_MACROS = {
    "ROLE_APPLICATION": "application",
    "ROLE_OWNER": "owner",
    "ROLE_READONLY": "read_only",
    "ROLE_SLONY": "replication",
}

READ_ONLY_SUFFIXES = ("_ro", "_readonly")


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _on(scope: list[str], *extra: Column) -> Column:
    return all_of([F.col(s).eqNullSafe(F.col(f"__{s}")) for s in scope] + list(extra))


def _scoped(scope: list[str]) -> list[Column]:
    return [F.col(s).alias(f"__{s}") for s in scope]


# -- access lists -------------------------------------------------------------


def explode_acl(df: DataFrame, scope: list[str], acl: str) -> DataFrame:
    """One row per user and permission of ``user=codes/grantor`` entries.

    Entries stand on lines of their own or in an array literal. No user means
    public, an entry without ``=`` grants nothing, and an unknown letter gives a
    row with an ``error`` in place of a permission.
    """
    text = F.col(acl)
    entries = F.when(text.startswith("{"), parse_array_literal(text)).otherwise(F.split(text, "\n"))
    entry = df.select(*scope, F.explode(entries).alias("entry")).filter(F.contains("entry", F.lit("=")))
    parts = F.split("entry", "=", 2)
    codes = F.split(parts[1], "/", 2)[0]
    letters = entry.select(
        *scope,
        F.coalesce(F.nullif(parts[0], F.lit("")), F.lit("public")).alias("grantee"),
        F.explode(F.filter(F.split(codes, ""), lambda c: c != "")).alias("code"),
    )
    permission = _lookup(ACL_CODES)[F.col("code")]
    return letters.select(
        *scope,
        "grantee",
        permission.alias("permission"),
        F.when(permission.isNull(), F.concat(F.lit("unknown code "), "code")).alias("error"),
    )


def _known_permission() -> Column:
    known = {*PERMISSIONS, *ACL_CODES.values(), *[p for ps in VALID_PERMISSIONS.values() for p in ps]}
    return F.coalesce(F.upper("permission").isin(*sorted(known)), F.lit(False))


def unknown_permissions(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Grants whose permission the database does not know, with an ``error``: one
    row per object, role and permission. What :func:`effective_permissions` sets aside."""
    text = F.concat(F.lit("unknown permission "), F.coalesce("permission", F.lit("(none)")))
    error = F.coalesce("error", text) if "error" in rows.columns else text
    return rows.filter(~_known_permission()).select(
        *scope, F.lower("grantee").alias("grantee"), F.upper("permission").alias("permission"), error.alias("error")
    ).distinct()


def effective_permissions(rows: DataFrame, owners: DataFrame, scope: list[str]) -> DataFrame:
    """One grant per object and role: sorted permissions and grant option.

    The owner's own permissions come with ownership and are left out. Roles
    ignore case. The permissions gathered for a grant come from a fixed list, so
    a grant stays small; :func:`unknown_permissions` reports any other, among
    them the error rows of :func:`explode_acl`.
    """
    name = F.when(_known_permission(), F.upper("permission"))
    owner = owners.select(*_scoped(scope), F.lower("owner").alias("__owner")).distinct()
    granted = rows.join(owner, _on(scope, F.lower("grantee") == F.col("__owner")), "left_anti")
    return granted.groupBy(*scope, F.lower("grantee").alias("grantee")).agg(
        F.array_sort(F.collect_set(name)).alias("permissions"),
        F.coalesce(F.bool_or("grantable"), F.lit(False)).alias("grantable"),
    )


GRANT_OPTION = "GRANT OPTION"


def missing_grants(target: DataFrame, existing: DataFrame, scope: list[str]) -> DataFrame:
    """What the target grants and the existing grants of the object do not cover.

    Both have scope, role, permission and grantable. Permissions that cannot be
    compared, as the database does not know them, are no missing grants;
    :func:`incomparable_grants` lists them. A missing grant option is a row of
    its own.
    """
    role, permission = F.lower("role").alias("role"), F.upper("permission").alias("permission")
    wanted = target.select(*scope, role, permission, "grantable")
    present = existing.select(*scope, role, permission, "grantable")

    def flat(df: DataFrame) -> DataFrame:
        plain = df.select(*scope, "role", "permission")
        return plain.unionByName(
            df.filter("grantable").select(*scope, "role", F.lit(GRANT_OPTION).alias("permission"))
        ).distinct()

    known = F.col("permission").isin(*PERMISSIONS, GRANT_OPTION)
    have = flat(present).select(*_scoped(scope), F.col("role").alias("__role"), F.col("permission").alias("__perm"))
    match = _on(scope, F.col("role") == F.col("__role"), F.col("permission") == F.col("__perm"))
    return flat(wanted).filter(known).join(have, match, "left_anti")


def incomparable_grants(target: DataFrame, scope: list[str]) -> DataFrame:
    """The grants of a target that :func:`missing_grants` sets aside, with an ``error``."""
    permission = F.upper("permission")
    known = F.coalesce(permission.isin(*PERMISSIONS, GRANT_OPTION), F.lit(False))
    text = F.concat(F.lit("not compared: "), F.coalesce(permission, F.lit("no permission")))
    return target.filter(~known).select(
        *scope, F.lower("role").alias("role"), permission.alias("permission"), text.alias("error")
    ).distinct()


# -- roles --------------------------------------------------------------------


def infer_roles(owners: DataFrame, grants: DataFrame, scope: list[str]) -> DataFrame:
    """Purpose of each role: the most frequent owner, the most frequent grantee
    (application) and the most frequent ``_ro`` / ``_readonly`` grantee
    (read_only); every other role is custom.

    ``owners`` and ``grants`` have scope and ``role``, one row per use. Ties go
    to the first name. Roles of the database itself do not count.
    """
    name = F.lower("role")
    read_only = F.lit(False)
    for suffix in READ_ONLY_SUFFIXES:
        read_only = read_only | name.endswith(suffix)
    uses = owners.select(*scope, name.alias("role"), F.lit("owner").alias("purpose")).unionByName(
        grants.select(
            *scope, name.alias("role"), F.when(read_only, F.lit("read_only")).otherwise("application").alias("purpose")
        )
    )
    counted = (
        uses.filter(~F.col("role").isin(*BUILTIN_ROLES))
        .groupBy(*scope, "purpose", "role")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counted.groupBy(*scope, "purpose").agg(F.min(F.struct(-F.col("n"), "role")).alias("best"))
    chosen = best.select(*scope, "purpose", F.col("best.role").alias("role"))
    taken = chosen.select(*_scoped(scope), F.col("role").alias("__role")).distinct()
    custom = (
        counted.select(*scope, "role")
        .distinct()
        .join(taken, _on(scope, F.col("role") == F.col("__role")), "left_anti")
        .select(*scope, F.lit("custom").alias("purpose"), "role")
    )
    return chosen.unionByName(custom)


def resolve_macros(
    df: DataFrame,
    role: str,
    assignments: DataFrame,
    custom: DataFrame,
    scope: list[str],
    ignore_custom: bool = False,
) -> DataFrame:
    """Adds ``resolved`` and ``error`` for each role name.

    ``assignments`` has one row per scope with application, owner, read_only,
    replication and database_owner; ``custom`` one row per custom role. Macros
    and the roles of the database are replaced, assigned and custom names stand
    for themselves; others are an error, or the owner with ``ignore_custom``.
    """
    purposes = ("application", "owner", "read_only", "replication")
    assigned = assignments.select(
        *_scoped(scope), *[F.col(p).alias(f"__p_{p}") for p in purposes], F.col("database_owner").alias("__p_db")
    )
    confirmed = custom.select(
        *[F.col(s).alias(f"__c_{s}") for s in scope], F.lower("role").alias("__custom")
    ).distinct()
    same_custom = all_of([F.col(s).eqNullSafe(F.col(f"__c_{s}")) for s in scope] + [F.lower(role) == F.col("__custom")])
    joined = df.join(assigned, _on(scope), "left").join(confirmed, same_custom, "left")

    name = F.col(role)
    resolved = F.when(name.isin(PUBLIC, PGSQL), name)
    for macro, purpose in ROLE_MACROS.items():
        resolved = resolved.when(name == macro, F.col(f"__p_{purpose}"))
    resolved = resolved.when(name == "pg_database_owner", F.col("__p_db"))
    resolved = resolved.when(name == "pg_read_all_data", F.col("__p_read_only"))
    stands = F.col("__custom").isNotNull()
    for purpose in purposes:
        stands = stands | F.coalesce(F.lower(name) == F.lower(f"__p_{purpose}"), F.lit(False))
    resolved = resolved.when(stands, name)
    if ignore_custom:
        resolved = resolved.otherwise(F.col("__p_owner"))
    return joined.select(
        *df.columns,
        resolved.alias("resolved"),
        F.when(resolved.isNull(), F.concat(F.lit("unknown role "), name)).alias("error"),
    )


def implicit_grants(grants: DataFrame, serials: DataFrame, read_only: DataFrame, scope: list[str]) -> DataFrame:
    """Explicit grants and those that follow from them, with their ``origin``.

    ``grants`` has scope, kind, object, role, permission, grantable; ``serials``
    scope, table_name, sequence_name; ``read_only`` scope and role. The
    read-only role may select from a granted table and use a granted schema.
    Who may select, insert or update may select from the table's sequences, who
    may insert or update may update them, except the owner, who owns them.
    """
    columns = [*scope, "kind", "object", "role", "permission", "grantable", "origin"]
    explicit = grants.withColumn("origin", F.lit("explicit")).select(*columns)
    reader = read_only.select(*_scoped(scope), F.col("role").alias("__reader"))
    sequences = serials.select(
        *_scoped(scope), F.col("table_name").alias("__table"), F.col("sequence_name").alias("__sequence")
    ).distinct()

    granted = grants.filter(F.col("kind").isin("table", "schema")).select(*scope, "kind", "object").distinct()
    by_reader = granted.join(reader, _on(scope)).select(
        *scope,
        "kind",
        "object",
        F.col("__reader").alias("role"),
        F.when(F.col("kind") == "table", F.lit("SELECT")).otherwise("USAGE").alias("permission"),
        F.lit(False).alias("grantable"),
        F.lit("read only").alias("origin"),
    )
    on_tables = grants.filter(F.col("kind") == "table")
    follows = F.when(F.col("permission").isin("INSERT", "UPDATE"), F.array(F.lit("SELECT"), F.lit("UPDATE"))).when(
        F.col("permission") == "SELECT", F.array(F.lit("SELECT"))
    )
    sequence_grants = (
        on_tables.filter(F.col("role") != "ROLE_OWNER")
        .withColumn("__follows", F.explode(follows))
        .groupBy(*scope, "object", "role", F.col("__follows").alias("permission"))
        .agg(F.bool_or("grantable").alias("grantable"))
        .join(sequences, _on(scope, F.col("object") == F.col("__table")))
        .select(
            *scope,
            F.lit("sequence").alias("kind"),
            F.col("__sequence").alias("object"),
            "role",
            "permission",
            "grantable",
            F.lit("serial column").alias("origin"),
        )
    )
    reader_sequences = (
        granted.filter(F.col("kind") == "table")
        .join(sequences, _on(scope, F.col("object") == F.col("__table")))
        .select(*scope, F.col("__sequence").alias("object"))
        .join(reader, _on(scope))
        .select(
            *scope,
            F.lit("sequence").alias("kind"),
            "object",
            F.col("__reader").alias("role"),
            F.lit("SELECT").alias("permission"),
            F.lit(False).alias("grantable"),
            F.lit("read only").alias("origin"),
        )
    )
    return explicit.unionByName(by_reader).unionByName(sequence_grants).unionByName(reader_sequences)


def invalid_permissions(grants: DataFrame) -> DataFrame:
    """Grants whose permission the database does not know (``unknown``) or does
    not take for that kind of object (``invalid``)."""
    permission, kind = F.upper("permission"), F.lower("kind")
    valid = F.create_map(
        *[x for k, ps in VALID_PERMISSIONS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in ps]))]
    )
    taken = F.coalesce(F.array_contains(valid[kind], permission), F.lit(False))
    reason = F.when(~permission.isin(*PERMISSIONS), "unknown").when(~taken, "invalid")
    return grants.withColumn("reason", reason).filter(F.col("reason").isNotNull())
