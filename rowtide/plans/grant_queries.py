"""Queries of grants, roles and declared-versus-live verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.functions.cells import TYPED
from rowtide.operators import grants, verify
from rowtide.plans.fixtures import FIXTURES, frame, oracle
from rowtide.plans.registry import query

OBJECT = ["object"]

# -- access lists -------------------------------------------------------------

FIXTURES["ACL_TEXTS"] = f"""
    SELECT object, grantee AS who, CASE WHEN length(codes) % 2 = 0
        THEN concat('{{', grantee, '=', codes, '/owner,"reader one=rz/owner"}}')
        ELSE concat(grantee, '=', codes, '/owner', chr(10), 'nobody', chr(10), 'reader one=rz/owner') END AS acl
    FROM ({FIXTURES["ACL"]}) AS a
"""
CODE_NAMES = """CASE code WHEN 'a' THEN 'INSERT' WHEN 'r' THEN 'SELECT' WHEN 'w' THEN 'UPDATE' WHEN 'd' THEN 'DELETE'
    WHEN 'U' THEN 'USAGE' END"""
EXPLODED = f"""
    SELECT object, CASE WHEN grantee = '' THEN 'public' ELSE grantee END AS grantee, {CODE_NAMES} AS permission
    FROM (SELECT object, grantee, unnest(string_split(codes, '')) AS code FROM ACL) AS c
"""


@query(
    "explode_acl",
    oracle(
        "ACL",
        f"""SELECT object, who, grantee, permission, error FROM (
            SELECT object, grantee AS who, CASE WHEN grantee = '' THEN 'public' ELSE grantee END AS grantee,
                {CODE_NAMES} AS permission, CAST(NULL AS VARCHAR) AS error
            FROM (SELECT object, grantee, unnest(string_split(codes, '')) AS code FROM ACL) AS c
            UNION ALL SELECT object, grantee, 'reader one', 'SELECT', NULL FROM ACL
            UNION ALL SELECT object, grantee, 'reader one', NULL, 'unknown code z' FROM ACL) AS d""",
    ),
)
def _explode_acl(spark, sf_dir):
    return grants.explode_acl(frame(spark, sf_dir, "ACL_TEXTS"), ["object", "who"], "acl")


def granted(spark, sf_dir):
    """ACL as (object, grantee, permission, grantable)."""
    acl = frame(spark, sf_dir, "ACL").select("object", F.concat_ws("", "grantee", F.lit("="), "codes").alias("acl"))
    rows = grants.explode_acl(acl, OBJECT, "acl").drop("error")
    return rows.withColumn("grantable", F.col("grantee").endswith("3"))


@query(
    "effective_permissions",
    oracle(
        "ACL",
        f"""SELECT object, lower(grantee) AS grantee, string_agg(DISTINCT permission, ',' ORDER BY permission)
                AS permissions, bool_or(grantee LIKE '%3') AS grantable
        FROM ({EXPLODED}) AS e WHERE NOT (object = 'click' AND grantee = 'u12') AND NOT (object = 'view' AND grantee = 'u10_ro')
        GROUP BY object, lower(grantee)""",
    ),
)
def _effective_permissions(spark, sf_dir):
    rows = granted(spark, sf_dir)
    owner = F.when(F.col("object") == "click", "U12").when(F.col("object") == "view", "u10_RO").otherwise("nobody")
    owners = rows.select("object").distinct().withColumn("owner", owner)
    # Some of the grants twice, and in another case.
    rows = rows.unionByName(rows.filter(F.col("permission") == "SELECT").withColumn("grantee", F.upper("grantee")))
    return grants.effective_permissions(rows, owners, OBJECT).withColumn("permissions", F.array_join("permissions", ","))


FIXTURES["TARGET_GRANTS"] = """
    SELECT DISTINCT event_type AS object, concat('U', CAST(user_id AS VARCHAR(20))) AS role,
        CASE user_id % 4 WHEN 0 THEN 'rw' WHEN 1 THEN 'arwd' WHEN 2 THEN 'U' ELSE 'r' END AS codes,
        user_id % 6 = 2 AS grantable
    FROM events
    WHERE user_id % 10 > 1
"""


@query(
    "missing_grants",
    oracle(
        "TARGET_GRANTS ACL",
        f"""
        , wanted AS (SELECT DISTINCT object, lower(role) AS role, {CODE_NAMES} AS permission FROM (
            SELECT object, role, unnest(string_split(codes, '')) AS code FROM TARGET_GRANTS) AS t
            UNION SELECT object, lower(role), 'GRANT OPTION' FROM TARGET_GRANTS WHERE grantable),
        present AS (SELECT object, lower(grantee) AS role, permission FROM ({EXPLODED}) AS e
            UNION SELECT object, lower(grantee), 'GRANT OPTION' FROM ({EXPLODED}) AS f WHERE grantee LIKE '%3'
                OR grantee LIKE '%8')
        SELECT * FROM wanted EXCEPT SELECT * FROM present""",
    ),
)
def _missing_grants(spark, sf_dir):
    target = frame(spark, sf_dir, "TARGET_GRANTS")
    wanted = grants.explode_acl(
        target.withColumn("acl", F.concat_ws("=", "role", "codes")), ["object", "role", "grantable"], "acl"
    ).select("object", "role", "permission", "grantable")
    option = F.col("grantable") | F.col("grantee").endswith("8")
    existing = granted(spark, sf_dir).select("object", F.col("grantee").alias("role"), "permission", option.alias("grantable"))
    return grants.missing_grants(wanted, existing, OBJECT)


# -- roles --------------------------------------------------------------------

FIXTURES["ROLE_OWNERS"] = """
    SELECT event_type AS db, CASE WHEN user_id % 5 = 0 THEN 'pg_monitor' WHEN user_id % 7 = 1
        THEN concat('Own', CAST(user_id % 3 AS VARCHAR(20)), '_ro') ELSE concat('own', CAST(user_id % 4 AS VARCHAR(20))) END
        AS role
    FROM events
    WHERE event_id % 3 = 0
"""
FIXTURES["ROLE_GRANTS"] = """
    SELECT event_type AS db, CASE WHEN user_id % 10 = 0 THEN concat('u', CAST(user_id % 30 AS VARCHAR(20)), '_RO')
        WHEN user_id % 10 = 1 THEN 'own1' ELSE concat('U', CAST(user_id % 30 AS VARCHAR(20))) END AS role
    FROM events
"""
ROLES = """
    counted AS (SELECT db, purpose, role, count(*) AS n FROM (
        SELECT db, 'owner' AS purpose, lower(role) AS role FROM ROLE_OWNERS
        UNION ALL SELECT db, CASE WHEN lower(role) LIKE '%\\_ro' ESCAPE '\\' THEN 'read_only' ELSE 'application' END,
            lower(role) FROM ROLE_GRANTS) AS u
        WHERE role <> 'pg_monitor' GROUP BY db, purpose, role),
    chosen AS (SELECT db, purpose, role FROM (SELECT *, row_number() OVER (PARTITION BY db, purpose ORDER BY n DESC, role)
        AS rn FROM counted) AS r WHERE rn = 1)
"""


@query(
    "infer_roles",
    oracle(
        "ROLE_OWNERS ROLE_GRANTS",
        f""", {ROLES}
        SELECT db, purpose, role FROM chosen
        UNION ALL SELECT DISTINCT db, 'custom', role FROM counted c WHERE NOT EXISTS (
            SELECT 1 FROM chosen x WHERE x.db = c.db AND x.role = c.role)""",
    ),
)
def _infer_roles(spark, sf_dir):
    return grants.infer_roles(frame(spark, sf_dir, "ROLE_OWNERS"), frame(spark, sf_dir, "ROLE_GRANTS"), ["db"])


FIXTURES["ROLE_NAMES"] = """
    SELECT event_id, event_type AS db, CASE user_id % 9 WHEN 0 THEN 'ROLE_OWNER' WHEN 1 THEN 'ROLE_APPLICATION'
        WHEN 2 THEN 'ROLE_READONLY' WHEN 3 THEN 'PUBLIC' WHEN 4 THEN 'pg_database_owner' WHEN 5 THEN 'pg_read_all_data'
        WHEN 6 THEN concat('APP_', event_type) WHEN 7 THEN 'Custom' ELSE 'stranger' END AS role
    FROM events
"""


@query(
    "resolve_macros",
    oracle(
        "ROLE_NAMES",
        """SELECT event_id, db, role, CASE role WHEN 'ROLE_OWNER' THEN concat('owner_', db)
                WHEN 'ROLE_APPLICATION' THEN concat('app_', db) WHEN 'ROLE_READONLY' THEN concat('ro_', db)
                WHEN 'PUBLIC' THEN 'PUBLIC' WHEN 'pg_database_owner' THEN concat('dba_', db)
                WHEN 'pg_read_all_data' THEN concat('ro_', db) WHEN 'Custom' THEN CASE WHEN db <> 'view' THEN 'Custom' END
                WHEN 'stranger' THEN NULL ELSE role END AS resolved,
            CASE WHEN role = 'stranger' OR (role = 'Custom' AND db = 'view') THEN concat('unknown role ', role) END AS error,
            CASE role WHEN 'ROLE_OWNER' THEN concat('owner_', db)
                WHEN 'ROLE_APPLICATION' THEN concat('app_', db) WHEN 'ROLE_READONLY' THEN concat('ro_', db)
                WHEN 'PUBLIC' THEN 'PUBLIC' WHEN 'pg_database_owner' THEN concat('dba_', db)
                WHEN 'pg_read_all_data' THEN concat('ro_', db) WHEN 'Custom' THEN CASE WHEN db <> 'view' THEN 'Custom'
                    ELSE concat('owner_', db) END
                WHEN 'stranger' THEN concat('owner_', db) ELSE role END AS overridden
        FROM ROLE_NAMES""",
    ),
)
def _resolve_macros(spark, sf_dir):
    names = frame(spark, sf_dir, "ROLE_NAMES")
    dbs = names.select("db").distinct()
    assignments = dbs.select(
        "db",
        F.concat(F.lit("app_"), "db").alias("application"),
        F.concat(F.lit("owner_"), "db").alias("owner"),
        F.concat(F.lit("ro_"), "db").alias("read_only"),
        F.lit("replica").alias("replication"),
        F.concat(F.lit("dba_"), "db").alias("database_owner"),
    )
    custom = dbs.filter("db <> 'view'").withColumn("role", F.lit("custom"))
    strict = grants.resolve_macros(names, "role", assignments, custom, ["db"])
    relaxed = grants.resolve_macros(names, "role", assignments, custom, ["db"], ignore_custom=True)
    return strict.join(relaxed.select("event_id", F.col("resolved").alias("overridden")), "event_id")


FIXTURES["KIND_GRANTS"] = """
    SELECT DISTINCT event_type AS object, CASE event_type WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'table'
        WHEN 'click' THEN 'sequence' WHEN 'signup' THEN 'schema' ELSE 'function' END AS kind,
        user_id % 7 AS db, CASE user_id % 4 WHEN 0 THEN 'ROLE_OWNER' WHEN 1 THEN 'app' WHEN 2 THEN 'batch' ELSE 'web' END
            AS role,
        CASE user_id % 6 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'USAGE'
            WHEN 4 THEN 'EXECUTE' ELSE 'JUGGLE' END AS permission,
        user_id % 5 = 0 AS grantable
    FROM events
"""


@query(
    "implicit_grants",
    oracle(
        "KIND_GRANTS",
        """
        SELECT db, kind, object, role, permission, grantable, 'explicit' AS origin FROM KIND_GRANTS
        UNION ALL SELECT DISTINCT db, kind, object, 'readers', CASE kind WHEN 'table' THEN 'SELECT' ELSE 'USAGE' END, FALSE,
            'read only' FROM KIND_GRANTS WHERE kind IN ('table', 'schema') AND db <> 6
        UNION ALL SELECT db, 'sequence', concat(object, '_id_seq'), role, p, bool_or(grantable), 'serial column' FROM (
            SELECT db, object, role, 'SELECT' AS p, grantable FROM KIND_GRANTS
            WHERE kind = 'table' AND role <> 'ROLE_OWNER' AND permission IN ('SELECT', 'INSERT', 'UPDATE')
            UNION ALL SELECT db, object, role, 'UPDATE', grantable FROM KIND_GRANTS
            WHERE kind = 'table' AND role <> 'ROLE_OWNER' AND permission IN ('INSERT', 'UPDATE')) AS s
        GROUP BY db, object, role, p
        UNION ALL SELECT DISTINCT db, 'sequence', concat(object, '_id_seq'), 'readers', 'SELECT', FALSE, 'read only'
        FROM KIND_GRANTS WHERE kind = 'table' AND db <> 6""",
    ),
)
def _implicit_grants(spark, sf_dir):
    rows = frame(spark, sf_dir, "KIND_GRANTS")
    serials = rows.filter("kind = 'table'").select(
        "db", F.col("object").alias("table_name"), F.concat("object", F.lit("_id_seq")).alias("sequence_name")
    )
    readers = rows.filter("db <> 6").select("db").distinct().withColumn("role", F.lit("readers"))
    return grants.implicit_grants(rows, serials, readers, ["db"])


@query(
    "invalid_permissions",
    oracle(
        "KIND_GRANTS",
        """SELECT * FROM (SELECT *, CASE WHEN permission = 'JUGGLE' THEN 'unknown'
            WHEN NOT CASE kind WHEN 'view' THEN permission = 'SELECT' WHEN 'table' THEN permission IN ('SELECT', 'INSERT',
                'UPDATE') WHEN 'sequence' THEN permission IN ('SELECT', 'UPDATE', 'USAGE') WHEN 'schema' THEN
                permission = 'USAGE' ELSE permission = 'EXECUTE' END THEN 'invalid' END AS reason
            FROM KIND_GRANTS) AS g WHERE reason IS NOT NULL""",
    ),
)
def _invalid_permissions(spark, sf_dir):
    return grants.invalid_permissions(frame(spark, sf_dir, "KIND_GRANTS"))


# -- declared against live ----------------------------------------------------

TYPES = {"segment": "varchar(20)", "flag": "boolean"}
FOUND = """
    found AS (SELECT d.*, coalesce(l.n, 0) AS n, l.segment AS live_segment, l.flag AS live_flag FROM DECL d
        LEFT JOIN (SELECT c_custkey, count(*) AS n, min(segment) AS segment, min(flag) AS flag FROM LIVE GROUP BY c_custkey)
            l ON l.c_custkey = d.c_custkey)
"""


@query(
    "verify_rows",
    oracle(
        "DECL LIVE",
        f""", {FOUND}
        SELECT c_custkey, CASE WHEN _delete AND n > 0 THEN 'tombstone_present' WHEN _delete THEN 'match'
            WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'duplicate'
            WHEN segment <> live_segment OR (flag = 't') <> (live_flag = 'true') THEN 'mismatch' ELSE 'match' END AS verdict,
            n AS live_rows FROM found""",
    ),
)
def _verify_rows(spark, sf_dir):
    return verify.verify_rows(frame(spark, sf_dir, "DECL"), frame(spark, sf_dir, "LIVE"), ["c_custkey"], TYPES)


@query(
    "verify_cells",
    oracle(
        "DECL LIVE",
        f""", {FOUND}
        SELECT c_custkey, 'segment' AS column_name, segment AS declared_value, live_segment AS live_value FROM found
        WHERE NOT _delete AND n = 1 AND segment <> live_segment
        UNION ALL SELECT c_custkey, 'flag', CASE flag WHEN 't' THEN 'true' ELSE 'false' END, CASE live_flag WHEN 'true'
            THEN 'true' ELSE 'false' END FROM found WHERE NOT _delete AND n = 1 AND (flag = 't') <> (live_flag = 'true')""",
    ),
)
def _verify_cells(spark, sf_dir):
    return verify.verify_cells(frame(spark, sf_dir, "DECL"), frame(spark, sf_dir, "LIVE"), ["c_custkey"], TYPES)


FIXTURES["TIMES"] = """
    SELECT o_orderkey, o_orderdate,
        CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN '' ELSE o_orderstatus END AS declared_text,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS live_text,
        CASE o_orderkey % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 't' WHEN 2 THEN 'F' WHEN 3 THEN 'no' ELSE '' END AS declared_flag,
        CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'f' END AS live_flag,
        CAST(o_custkey % 5 AS VARCHAR(5)) AS hours, CAST(o_custkey % 60 AS VARCHAR(5)) AS minutes, o_custkey
    FROM orders
"""


@query(
    "typed_compare",
    oracle(
        "TIMES",
        """SELECT o_orderkey, coalesce(declared_text, '') = coalesce(live_text, '') AS text_equal,
            declared_text IS NOT DISTINCT FROM live_text AS typed_equal,
            (lower(declared_flag) IN ('true', 't')) = (coalesce(live_flag, '') IN ('true', 't')) AS bool_equal,
            CASE WHEN o_orderkey % 4 = 0 THEN date_trunc('day', o_orderdate) + INTERVAL 1 HOUR = date_trunc('day', o_orderdate)
                ELSE TRUE END AS time_equal,
            o_orderkey % 7 <> 0 OR (o_custkey % 5 = 0 AND o_custkey % 60 = 0) AS interval_equal
        FROM TIMES""",
    ),
)
def _typed_compare(spark, sf_dir):
    times = frame(spark, sf_dir, "TIMES")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    stamp = F.concat(day, F.when(F.col("o_orderkey") % 4 == 0, F.lit(" 01:00:00")).otherwise(F.lit(" 00:00:00")))
    verbose = F.concat(F.lit("@ "), "hours", F.lit(" hours "), "minutes", F.lit(" mins"))
    verbose = F.when(F.col("o_orderkey") % 7 == 0, F.concat(verbose, F.lit(" ago"))).otherwise(verbose)
    clock = F.concat(F.lpad("hours", 2, "0"), F.lit(":"), F.lpad("minutes", 2, "0"), F.lit(":00"))
    compare = verify.typed_compare
    return times.select(
        "o_orderkey",
        compare(F.col("declared_text"), F.col("live_text"), "text").alias("text_equal"),
        compare(F.col("declared_text"), F.col("live_text"), "text", TYPED).alias("typed_equal"),
        compare(F.col("declared_flag"), F.col("live_flag"), "boolean").alias("bool_equal"),
        compare(stamp, day, "timestamp").alias("time_equal"),
        compare(verbose, clock, "interval").alias("interval_equal"),
    )
