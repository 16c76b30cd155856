"""Queries of catalog drift and catalog assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.operators import assemble, catalog
from rowtide.plans.fixtures import FIXTURES, GRID, frame, oracle
from rowtide.plans.registry import ORACLES, QUERIES, query

DB = ["db"]

# -- one pair of object catalogs serves constraints, indexes, views and so on --

FIXTURES["OBJ_OLD"] = f"""
    SELECT db, n_nationkey AS n, concat('T', CAST(n_nationkey % 5 AS VARCHAR(5))) AS table_name, n_name AS name,
        concat(CAST(n_nationkey % 3 AS VARCHAR(5)), ',', CAST(n_nationkey % 5 AS VARCHAR(5))) AS members,
        concat('E', CAST(n_nationkey % 3 AS VARCHAR(5)), ',e', CAST(n_nationkey % 5 AS VARCHAR(5))) AS events,
        'NO ACTION' AS rule, 'app' AS owner, concat(' SELECT ', n_name, ';') AS body, n_nationkey % 3 + 1 AS step,
        CAST(NULL AS VARCHAR(5)) AS dflt, 'int' AS base_type, 'CHECK (value > 1)' AS check_text
    FROM ({GRID}) AS g
"""
FIXTURES["OBJ_NEW"] = f"""
    SELECT db, n_nationkey AS n, concat('t', CAST(n_nationkey % 5 AS VARCHAR(5))) AS table_name,
        CASE WHEN n_nationkey % 6 = 0 THEN lower(n_name) ELSE n_name END AS name,
        concat(CAST(n_nationkey % 3 AS VARCHAR(5)), ',',
            CAST((n_nationkey + CASE WHEN (db + n_nationkey) % 7 = 0 THEN 1 ELSE 0 END) % 5 AS VARCHAR(5))) AS members,
        concat('E', CAST(n_nationkey % 5 AS VARCHAR(5)), ',e',
            CAST((n_nationkey + CASE WHEN (db + n_nationkey) % 7 = 0 THEN 1 ELSE 0 END) % 3 AS VARCHAR(5))) AS events,
        CASE WHEN (db + n_nationkey) % 10 = 0 THEN 'CASCADE' ELSE 'NO ACTION' END AS rule,
        CASE WHEN (db + n_nationkey) % 9 = 0 THEN 'dba' ELSE 'APP' END AS owner,
        CASE WHEN (db + n_nationkey) % 8 = 0 THEN concat('select ', lower(n_name), '2')
            ELSE concat('select ', lower(n_name), ' ') END AS body,
        n_nationkey % 3 + CASE WHEN (db + n_nationkey) % 6 = 0 THEN 2 ELSE 1 END AS step,
        CASE WHEN (db + n_nationkey) % 5 = 0 THEN '0' END AS dflt,
        CASE WHEN (db + n_nationkey) % 11 = 0 THEN 'bigint' ELSE 'INT' END AS base_type,
        CASE WHEN (db + n_nationkey) % 4 = 0 THEN 'value > 2' ELSE 'value > 1' END AS check_text
    FROM ({GRID}) AS g
    WHERE (db + n_nationkey) % 13 <> 0
    UNION ALL
    SELECT db, 100, 't0', 'EXTRA', '1,1', 'E1,E1', 'NO ACTION', 'app', 'select extra', 1, NULL, 'int', 'value > 1'
    FROM ({GRID}) AS h
    WHERE n_nationkey = 0 AND db % 3 = 0
"""


def objects(spark, sf_dir):
    return frame(spark, sf_dir, "OBJ_OLD"), frame(spark, sf_dir, "OBJ_NEW")


def listed(df):
    """List of changed attributes as text."""
    return df.withColumn("changed", F.array_join("changed", ","))


def drift_oracle(kind: str, columns: str, attributes: dict[str, str], changed_as: str, stages=(1, 1, 1), on_table=True):
    """Oracle of an object kind. ``attributes`` maps an attribute to the SQL that
    says it changed; ``stages`` are those of create, drop and change."""
    changed = ", ".join(f"CASE WHEN {sql} THEN '{a}' END" for a, sql in attributes.items())
    any_change = " OR ".join(f"({sql})" for sql in attributes.values())
    same_table = " AND lower(o.table_name) = lower(n.table_name)" if on_table else ""
    return oracle(
        "OBJ_OLD OBJ_NEW",
        f"""
        SELECT * FROM (
            SELECT coalesce(n.db, o.db) AS db, '{kind}' AS kind, {columns},
                CASE WHEN o.db IS NULL THEN 'create' WHEN n.db IS NULL THEN 'drop' WHEN {any_change} THEN {changed_as}
                    ELSE 'same' END AS action,
                CASE WHEN o.db IS NULL THEN {stages[0]} WHEN n.db IS NULL THEN {stages[1]} ELSE {stages[2]} END AS stage,
                CASE WHEN o.db IS NULL OR n.db IS NULL THEN '' ELSE concat_ws(',', {changed}) END AS changed
            FROM OBJ_OLD o FULL OUTER JOIN OBJ_NEW n ON o.db = n.db AND lower(o.name) = lower(n.name){same_table}
        ) AS d WHERE action <> 'same'""",
    )


TABLE_AND_NAME = "coalesce(n.table_name, o.table_name) AS table_name, coalesce(n.name, o.name) AS {0}"


@query(
    "drift_constraints",
    drift_oracle(
        "constraint",
        TABLE_AND_NAME.format("constraint_name"),
        {"on_delete": "o.rule <> n.rule", "columns": "o.members <> n.members", "ref_types": "lower(o.base_type) <> lower(n.base_type)"},
        "'recreate'",
    ),
)
def _drift_constraints(spark, sf_dir):
    def constraints(df):
        return df.select(
            "db",
            "table_name",
            F.col("name").alias("constraint_name"),
            F.lit("foreign key").alias("constraint_type"),
            F.lit(None).cast("string").alias("definition"),
            F.col("rule").alias("on_delete"),
            F.lit("NO ACTION").alias("on_update"),
            F.split("members", ",").alias("columns"),
            F.concat(F.lit("ref_"), F.lower("table_name")).alias("ref_table"),
            F.array(F.lit("id")).alias("ref_columns"),
            F.array("base_type").alias("ref_types"),
        )

    old, new = objects(spark, sf_dir)
    return listed(catalog.drift_constraints(constraints(old), constraints(new), DB))


@query(
    "drift_indexes",
    oracle(
        "OBJ_OLD OBJ_NEW",
        """
        , o AS (SELECT db, table_name, name AS index_name, members, body, FALSE AS u FROM OBJ_OLD
            UNION ALL SELECT db, table_name, concat(table_name, '_', name, '_key'), name, '', TRUE FROM OBJ_OLD WHERE n % 4 = 0),
        n AS (SELECT db, table_name, name AS index_name, members, body, FALSE AS u FROM OBJ_NEW
            UNION ALL SELECT db, table_name, concat(table_name, '_', name, '_key'), name, '', TRUE FROM OBJ_NEW WHERE n % 8 = 0)
        SELECT * FROM (
            SELECT coalesce(n.db, o.db) AS db, 'index' AS kind, coalesce(n.table_name, o.table_name) AS table_name,
                coalesce(n.index_name, o.index_name) AS index_name,
                CASE WHEN o.db IS NULL THEN 'create' WHEN n.db IS NULL THEN 'drop'
                    WHEN o.members <> n.members OR trim(o.body) <> trim(n.body) THEN 'recreate' ELSE 'same' END AS action,
                1 AS stage,
                CASE WHEN o.db IS NULL OR n.db IS NULL THEN '' ELSE concat_ws(',',
                    CASE WHEN o.members <> n.members THEN 'dimensions' END,
                    CASE WHEN trim(o.body) <> trim(n.body) THEN 'predicate' END) END AS changed
            FROM o FULL OUTER JOIN n ON o.db = n.db AND lower(o.table_name) = lower(n.table_name)
                AND lower(o.index_name) = lower(n.index_name)) AS d
        WHERE action <> 'same'""",
    ),
)
def _drift_indexes(spark, sf_dir):
    def indexes(df, every):
        declared = df.select(
            "db",
            "table_name",
            F.col("name").alias("index_name"),
            F.lit(False).alias("is_unique"),
            F.lit(False).alias("concurrently"),
            F.lit("BTREE").alias("method"),
            F.split("members", ",").alias("dimensions"),
            F.col("body").alias("predicate"),
        )
        columns = df.select(
            "db", "table_name", F.col("name").alias("column_name"), (F.col("n") % every == 0).alias("is_unique")
        )
        return catalog.indexes_with_unique_columns(declared, columns, DB)

    old, new = objects(spark, sf_dir)
    return listed(catalog.drift_indexes(indexes(old, 4), indexes(new, 8), DB))


BODY_DIFFERS = "lower(regexp_replace(trim(o.body), ';$', '')) <> lower(regexp_replace(trim(n.body), ';$', ''))"


@query(
    "drift_views",
    drift_oracle(
        "view",
        "coalesce(n.name, o.name) AS view_name",
        {"owner": "lower(o.owner) <> lower(n.owner)", "query": BODY_DIFFERS},
        "'recreate'",
        stages=(3, 1, 3),
        on_table=False,
    ),
)
def _drift_views(spark, sf_dir):
    old, new = [
        d.select("db", F.col("name").alias("view_name"), "owner", F.col("body").alias("query"))
        for d in objects(spark, sf_dir)
    ]
    return listed(catalog.drift_views(old, new, DB))


@query(
    "drift_functions",
    oracle(
        "OBJ_OLD OBJ_NEW",
        """SELECT * FROM (
            SELECT coalesce(n.db, o.db) AS db, 'function' AS kind, coalesce(n.name, o.name) AS function_name,
                coalesce(n.members, o.members) AS params,
                CASE WHEN o.db IS NULL THEN 'create' WHEN n.db IS NULL THEN 'drop'
                    WHEN o.body <> n.body OR n.n % 12 = 0 OR (n.db % 5 = 0 AND (n.db + 1) % 13 <> 0 AND n.table_name = 't1') THEN 'replace'
                    ELSE 'same' END AS action,
                CASE WHEN n.db IS NULL THEN 3 ELSE 1 END AS stage,
                CASE WHEN o.body <> n.body THEN 'body' ELSE '' END AS changed
            FROM (SELECT db, name, members, lower(trim(body)) AS body FROM OBJ_OLD) o
            FULL OUTER JOIN (SELECT db, name, members, n, table_name,
                concat(trim(body), CASE WHEN (db + n) % 8 = 0 THEN '' ELSE ';' END) AS body FROM OBJ_NEW) n
                ON o.db = n.db AND lower(o.name) = lower(n.name) AND o.members = n.members) AS d
        WHERE action <> 'same'""",
    ),
)
def _drift_functions(spark, sf_dir):
    def functions(df, body):
        return df.select(
            "db",
            F.col("name").alias("function_name"),
            F.split("members", ",").alias("params"),
            F.lit("pgsql").alias("dialect"),
            F.lit("owner").alias("owner"),
            F.lower("table_name").alias("returns"),
            F.lit("sql").alias("language"),
            body.alias("body"),
            (F.col("n") % 12 == 0).alias("force"),
        )

    old, new = objects(spark, sf_dir)
    closing = F.when((F.col("db") + F.col("n")) % 8 == 0, "").otherwise(";")
    types = new.filter("db % 5 = 0 AND n = 1").select("db", F.lit("T1").alias("type_name"))
    drift = catalog.drift_functions(
        functions(old, F.lower(F.trim("body"))), functions(new, F.concat(F.trim("body"), closing)), DB, types
    )
    return listed(drift).withColumn("params", F.array_join("params", ",")).drop("dialect")


SORTED_EVENTS = "list_sort(string_split(lower({0}.events), ','))"


@query(
    "drift_triggers",
    drift_oracle(
        "trigger",
        TABLE_AND_NAME.format("trigger_name"),
        {
            "function_name": "lower(o.owner) <> lower(n.owner)",
            "events": f"{SORTED_EVENTS.format('o')} <> {SORTED_EVENTS.format('n')}",
            "timing": "o.rule <> n.rule",
        },
        "'recreate'",
    ),
)
def _drift_triggers(spark, sf_dir):
    old, new = [
        d.select(
            "db",
            "table_name",
            F.col("name").alias("trigger_name"),
            F.col("owner").alias("function_name"),
            F.split("events", ",").alias("events"),
            F.lit("ROW").alias("for_each"),
            F.col("rule").alias("timing"),
            F.lit("pgsql").alias("dialect"),
        )
        for d in objects(spark, sf_dir)
    ]
    return listed(catalog.drift_triggers(old, new, DB))


@query(
    "drift_sequences",
    drift_oracle(
        "sequence",
        "coalesce(n.name, o.name) AS sequence_name",
        {
            "increment": "o.step <> n.step",
            "minimum": "o.dflt IS DISTINCT FROM n.dflt",
            "cycle": "(o.rule = 'CASCADE') <> (n.rule = 'CASCADE')",
        },
        "'alter'",
        on_table=False,
    ),
)
def _drift_sequences(spark, sf_dir):
    old, new = [
        d.select(
            "db",
            F.col("name").alias("sequence_name"),
            F.col("step").alias("increment"),
            F.col("dflt").cast("int").alias("minimum"),
            F.lit(1000).alias("maximum"),
            F.lit(1).alias("cache"),
            (F.col("rule") == "CASCADE").alias("cycle"),
        )
        for d in objects(spark, sf_dir)
    ]
    return listed(catalog.drift_sequences(old, new, DB))


IS_DOMAIN = "o.n % 3 = 2"


@query(
    "drift_types",
    drift_oracle(
        "type",
        "coalesce(n.name, o.name) AS type_name",
        {
            "members": f"NOT ({IS_DOMAIN}) AND o.members <> n.members",
            "base_type": f"{IS_DOMAIN} AND lower(o.base_type) <> lower(n.base_type)",
            "dflt": f"{IS_DOMAIN} AND o.dflt IS DISTINCT FROM n.dflt",
            "checks": f"{IS_DOMAIN} AND n.check_text <> 'value > 1'",
        },
        f"CASE WHEN {IS_DOMAIN} AND lower(o.base_type) = lower(n.base_type) THEN 'alter' ELSE 'recreate' END",
        on_table=False,
    ),
)
def _drift_types(spark, sf_dir):
    def types(df, case):
        kind = F.element_at(F.array(F.lit("enum"), F.lit("composite"), F.lit("domain")), F.col("n") % 3 + 1)
        domain = F.col("n") % 3 == 2
        member = F.transform(F.split("members", ","), lambda m: F.concat(F.when(F.col("n") % 3 == 1, case).otherwise("v"), m))
        return df.select(
            "db",
            F.col("name").alias("type_name"),
            kind.alias("type_kind"),
            F.when(~domain, member).alias("members"),
            F.when(domain, F.col("base_type")).alias("base_type"),
            F.when(domain, F.col("dflt")).alias("dflt"),
            F.when(domain, F.lit(True)).alias("nullable"),
            F.when(domain, F.array("check_text")).alias("checks"),
        )

    old, new = objects(spark, sf_dir)
    return listed(catalog.drift_types(types(old, "field"), types(new, "FIELD"), DB))


# -- name and value, tables, columns ------------------------------------------

KIND_OF = """CASE n_nationkey % 6 WHEN 0 THEN 'schema' WHEN 1 THEN 'language' WHEN 2 THEN 'config'
            WHEN 3 THEN 'statistics' WHEN 4 THEN 'cluster' ELSE 'step' END"""
FIXTURES["SIMPLE_OLD"] = f"""
    SELECT db, {KIND_OF} AS kind, n_name AS name, CASE WHEN n_nationkey % 6 > 0 THEN CAST(n_nationkey AS VARCHAR(9)) END
        AS value
    FROM ({GRID}) AS g
    WHERE (db + n_nationkey) % 9 <> 0
"""
FIXTURES["SIMPLE_NEW"] = f"""
    SELECT db, {KIND_OF} AS kind, CASE WHEN db % 2 = 0 THEN lower(n_name) ELSE n_name END AS name,
        CASE WHEN n_nationkey % 6 > 0 THEN CAST(n_nationkey + CASE WHEN (db + n_nationkey) % 5 = 0 THEN 100 ELSE 0 END
            AS VARCHAR(9)) END AS value
    FROM ({GRID}) AS g
    WHERE (db + n_nationkey) % 13 <> 0
"""


@query(
    "drift_simple",
    oracle(
        "SIMPLE_OLD SIMPLE_NEW",
        """SELECT db, kind, name, action,
            CASE WHEN kind = 'schema' AND action = 'drop' THEN 3 WHEN kind = 'step' THEN 2 ELSE 1 END AS stage,
            coalesce(old_value, 'not defined') AS old_value,
            CASE WHEN kind = 'statistics' AND gone THEN '-1' ELSE new_value END AS new_value
        FROM (SELECT coalesce(n.db, o.db) AS db, coalesce(n.kind, o.kind) AS kind, coalesce(n.name, o.name) AS name,
                n.db IS NULL AS gone, o.value AS old_value, n.value AS new_value,
                CASE WHEN o.db IS NULL AND n.kind IN ('schema', 'language', 'step') THEN 'create'
                    WHEN o.db IS NULL THEN 'alter'
                    WHEN n.db IS NULL AND o.kind IN ('schema', 'language') THEN 'drop'
                    WHEN n.db IS NULL AND o.kind IN ('statistics', 'cluster') THEN 'alter'
                    WHEN n.db IS NULL THEN NULL
                    WHEN o.value <> n.value AND n.kind = 'language' THEN 'recreate'
                    WHEN o.value <> n.value AND n.kind IN ('config', 'statistics', 'cluster') THEN 'alter' END AS action
            FROM SIMPLE_OLD o FULL OUTER JOIN SIMPLE_NEW n ON o.db = n.db AND o.kind = n.kind
                AND CASE WHEN o.kind = 'step' THEN o.name = n.name ELSE lower(o.name) = lower(n.name) END) AS d
        WHERE action IS NOT NULL""",
    ),
)
def _drift_simple(spark, sf_dir):
    return catalog.drift_simple(frame(spark, sf_dir, "SIMPLE_OLD"), frame(spark, sf_dir, "SIMPLE_NEW"), DB)


FIXTURES["TABLES_OLD"] = f"SELECT db, 'public' AS schema_name, n_name AS table_name FROM ({GRID}) AS g"
FIXTURES["TABLES_NEW"] = f"""
    SELECT db, CASE WHEN n_nationkey % 14 = 0 THEN 'sales' ELSE 'public' END AS schema_name,
        CASE WHEN n_nationkey % 7 = 0 THEN concat('N_', n_name) WHEN n_nationkey = 5 THEN 'M_5'
            WHEN db % 2 = 0 THEN lower(n_name) ELSE n_name END AS table_name,
        CASE WHEN n_nationkey % 14 = 0 THEN 'Public' END AS old_schema_name,
        CASE WHEN n_nationkey % 7 = 0 THEN lower(n_name) WHEN n_nationkey = 5 THEN 'missing' END AS old_table_name
    FROM ({GRID}) AS g
    WHERE NOT (n_nationkey % 7 = 1 AND db % 3 = 0)
    UNION ALL
    SELECT db, 'public', 'EXTRA', NULL, NULL
    FROM ({GRID}) AS h
    WHERE n_nationkey = 0 AND db % 4 = 0
"""


@query(
    "drift_tables",
    f"""
    SELECT db, schema_name, table_name, old_table_name, action, CASE WHEN action = 'drop' THEN 3 ELSE 1 END AS stage
    FROM (
        SELECT db, CASE WHEN n_nationkey % 14 = 0 THEN 'sales' ELSE 'public' END AS schema_name,
            concat('N_', n_name) AS table_name, n_name AS old_table_name, 'rename' AS action
        FROM ({GRID}) AS g WHERE n_nationkey % 7 = 0
        UNION ALL SELECT db, 'sales', concat('N_', n_name), n_name, 'reschema' FROM ({GRID}) AS g
        WHERE n_nationkey % 14 = 0
        UNION ALL SELECT db, 'public', n_name, n_name, 'drop' FROM ({GRID}) AS g
        WHERE (n_nationkey % 7 = 1 AND db % 3 = 0) OR n_nationkey = 5
        UNION ALL SELECT db, 'public', 'M_5', NULL, 'invalid rename' FROM ({GRID}) AS g WHERE n_nationkey = 5
        UNION ALL SELECT db, 'public', 'EXTRA', NULL, 'create' FROM ({GRID}) AS g WHERE n_nationkey = 0 AND db % 4 = 0
    ) AS d""",
)
def _drift_tables(spark, sf_dir):
    return catalog.drift_tables(frame(spark, sf_dir, "TABLES_OLD"), frame(spark, sf_dir, "TABLES_NEW"), DB)


COLUMN_PAIRS = """
    SELECT coalesce(n.db, o.db) AS db, coalesce(n.table_name, o.table_name) AS table_name,
        coalesce(n.column_name, o.column_name) AS column_name, o.db IS NOT NULL AS in_old, n.db IS NOT NULL AS in_new,
        n.column_name = 'rebuilt' AS renamed, o.data_type AS ot, n.data_type AS nt, o.nullable AS onull,
        n.nullable AS nnull, o.dflt AS od, n.dflt AS nd
    FROM CAT_OLD o FULL OUTER JOIN CAT_RENAMED n ON o.db = n.db AND lower(o.table_name) = lower(n.table_name)
        AND lower(o.column_name) = lower(coalesce(n.old_column_name, n.column_name))
"""
FIXTURES["CAT_RENAMED"] = """
    SELECT db, table_name, CASE WHEN column_name = 'NATION_9' AND db % 2 = 0 THEN 'rebuilt' ELSE column_name END
            AS column_name, data_type, nullable, dflt,
        CASE WHEN column_name = 'NATION_9' AND db % 2 = 0 THEN 'nation_9' END AS old_column_name
    FROM ({0}) AS c
""".format(FIXTURES["CAT_NEW"])
COLUMN_STEPS = (
    ("NOT in_old", "add", 1),
    ("NOT in_old AND nd IS NOT NULL AND NOT nnull", "fill default", 1),
    ("NOT in_old AND NOT nnull", "set not null", 3),
    ("NOT in_new", "drop", 3),
    ("in_old AND renamed", "rename", 1),
    ("in_old AND in_new AND ot <> nt", "alter type", 1),
    ("in_old AND in_new AND od IS NOT NULL AND nd IS NULL", "drop default", 1),
    ("in_old AND in_new AND nd IS NOT NULL AND od IS DISTINCT FROM nd", "set default", 1),
    ("in_old AND in_new AND NOT onull AND nnull", "drop not null", 1),
    ("in_old AND in_new AND onull AND NOT nnull AND nd IS NOT NULL", "fill default", 1),
    ("in_old AND in_new AND onull AND NOT nnull", "set not null", 3),
)
COLUMN_DRIFT = " UNION ALL ".join(
    f"SELECT db, table_name, column_name, '{action}' AS action, {stage} AS stage FROM ({COLUMN_PAIRS}) AS p WHERE {when}"
    for when, action, stage in COLUMN_STEPS
)


def column_drift(spark, sf_dir):
    return catalog.drift_columns(frame(spark, sf_dir, "CAT_OLD"), frame(spark, sf_dir, "CAT_RENAMED"), DB)


@query("drift_columns", oracle("CAT_OLD CAT_RENAMED", COLUMN_DRIFT))
def _drift_columns(spark, sf_dir):
    return column_drift(spark, sf_dir)


TABLE_DRIFT = """
    SELECT db, 'table' AS kind, 'drop' AS action FROM TABLES_OLD o WHERE NOT EXISTS (SELECT 1 FROM TABLES_NEW n
        WHERE n.db = o.db AND lower(coalesce(n.old_table_name, n.table_name)) = lower(o.table_name))
    UNION ALL SELECT db, 'table', CASE WHEN table_name = 'EXTRA' THEN 'create' WHEN old_table_name = 'missing'
        THEN 'invalid rename' ELSE 'rename' END FROM TABLES_NEW WHERE table_name = 'EXTRA' OR old_table_name IS NOT NULL
    UNION ALL SELECT db, 'table', 'reschema' FROM TABLES_NEW WHERE schema_name = 'sales'
"""


# Tables of some databases renamed, with a column whose type is that of its reference.
FIXTURES["REN_OLD"] = f"""
    SELECT db, concat('T', CAST(n_nationkey % 5 AS VARCHAR(5))) AS table_name, n_name AS column_name,
        CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE 'int' END AS data_type, TRUE AS nullable, CAST(NULL AS VARCHAR(5)) AS dflt
    FROM ({GRID}) AS g
"""
FIXTURES["REN_NEW"] = f"""
    SELECT db, CASE WHEN db % 3 = 0 AND n_nationkey % 5 = 2 THEN 'Renamed' ELSE concat('t', CAST(n_nationkey % 5 AS VARCHAR(5))) END
            AS table_name,
        CASE WHEN db % 3 = 0 AND n_nationkey % 5 = 2 THEN 't2' END AS old_table_name, n_name AS column_name,
        CASE WHEN n_nationkey % 4 = CASE WHEN db % 2 = 0 THEN 1 ELSE 2 END THEN NULL ELSE 'int' END AS data_type,
        TRUE AS nullable, CAST(NULL AS VARCHAR(5)) AS dflt
    FROM ({GRID}) AS g
    WHERE NOT (db % 3 = 0 AND n_nationkey = 7)
"""


@query(
    "drift_columns_renamed_table",
    oracle(
        "REN_OLD REN_NEW",
        """SELECT o.db, coalesce(n.table_name, o.table_name) AS table_name, o.column_name,
            CASE WHEN n.db IS NULL THEN 'drop' ELSE 'alter type' END AS action, CASE WHEN n.db IS NULL THEN 3 ELSE 1 END AS stage
        FROM REN_OLD o LEFT JOIN REN_NEW n ON o.db = n.db AND o.column_name = n.column_name
        WHERE n.db IS NULL OR o.data_type IS DISTINCT FROM n.data_type""",
    ),
)
def _drift_columns_renamed_table(spark, sf_dir):
    return catalog.drift_columns(frame(spark, sf_dir, "REN_OLD"), frame(spark, sf_dir, "REN_NEW"), DB)


@query(
    "follow_table_renames",
    oracle(
        "REN_OLD REN_NEW",
        """SELECT db, CASE WHEN db % 3 = 0 AND table_name = 'T2' THEN 'Renamed' ELSE table_name END AS table_name, column_name
        FROM REN_OLD""",
    ),
)
def _follow_table_renames(spark, sf_dir):
    tables = frame(spark, sf_dir, "REN_NEW").select("db", "table_name", "old_table_name").distinct()
    return catalog.follow_table_renames(frame(spark, sf_dir, "REN_OLD"), tables, DB).select("db", "table_name", "column_name")


# Kinds of drift, each by the query that finds it; simple kinds carry a kind of their own.
REPORTED = ("table", "column", "constraint", "index", "view", "function", "trigger", "sequence", "type", "simple")


def _kind_query(kind: str) -> str:
    plural = {"index": "indexes", "simple": "simple"}.get(kind, kind + "s")
    return f"drift_{plural}"


@query(
    "drift_report",
    "SELECT db, coalesce(kind, '*') AS kind, coalesce(action, '*') AS action, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT db, '{k}' AS kind, action FROM ({ORACLES[_kind_query(k)]}) AS {k}_drift" for k in REPORTED)
    + ") AS d GROUP BY ROLLUP (db, kind, action)",
)
def _drift_report(spark, sf_dir):
    return catalog.drift_report({k: QUERIES[_kind_query(k)](spark, sf_dir) for k in REPORTED})


# -- assembly -----------------------------------------------------------------

FIXTURES["KEY_ROWS"] = f"""
    SELECT db, concat('fk', CAST(n_nationkey % 5 AS VARCHAR(5))) AS constraint_name,
        concat('T', CAST(n_nationkey % 5 AS VARCHAR(5))) AS table_name,
        CASE n_nationkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'r' WHEN 2 THEN 'c' WHEN 3 THEN 'n' ELSE 'd' END AS rule,
        n_nationkey AS position, n_name AS column_name
    FROM ({GRID}) AS g
    WHERE db % 4 <> 0 OR n_nationkey < 5
    UNION ALL
    SELECT db, concat('fk', CAST(n_nationkey % 5 AS VARCHAR(5))), concat('T', CAST(n_nationkey % 5 AS VARCHAR(5))),
        CASE n_nationkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'r' WHEN 2 THEN 'c' WHEN 3 THEN 'n' ELSE 'd' END,
        n_nationkey, n_name
    FROM ({GRID}) AS h
    WHERE db % 6 = 5
"""
GATHERED = """
    SELECT db, constraint_name, table_name, rule, count(*) AS n, string_agg(column_name, ',' ORDER BY position) AS columns
    FROM (SELECT DISTINCT * FROM KEY_ROWS) AS k GROUP BY db, constraint_name, table_name, rule
"""
RULES = """CASE rule WHEN 'a' THEN 'NO ACTION' WHEN 'r' THEN 'RESTRICT' WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL'
    ELSE 'SET DEFAULT' END"""


@query(
    "assemble_foreign_keys",
    oracle(
        "KEY_ROWS",
        f"""SELECT db, constraint_name, table_name AS local_table, columns AS local_columns,
            concat('P', table_name) AS foreign_table, lower(columns) AS foreign_columns, {RULES} AS on_update,
            'CASCADE' AS on_delete, n = 1 AS inline FROM ({GATHERED}) AS g""",
    ),
)
def _assemble_foreign_keys(spark, sf_dir):
    rows = frame(spark, sf_dir, "KEY_ROWS").select(
        "db",
        "constraint_name",
        F.col("table_name").alias("local_table"),
        F.concat(F.lit("P"), "table_name").alias("foreign_table"),
        F.col("rule").alias("update_rule"),
        F.lit("C").alias("delete_rule"),
        "position",
        F.col("column_name").alias("local_column"),
        F.lower("column_name").alias("foreign_column"),
    )
    keys, inline = assemble.assemble_foreign_keys(rows, DB)
    whole = keys.withColumn("local_columns", F.array_join("local_columns", ",")).withColumn(
        "foreign_columns", F.array_join("foreign_columns", ",")
    )
    single = inline.withColumnsRenamed({"local_column": "local_columns", "foreign_column": "foreign_columns"})
    return whole.withColumn("inline", F.lit(False)).unionByName(single.withColumn("inline", F.lit(True)))


@query(
    "assemble_constraints",
    oracle(
        "KEY_ROWS",
        f"""
        SELECT db, table_name, constraint_name,
            CASE WHEN rule = 'a' THEN 'primary key' WHEN rule = 'r' THEN 'unique' WHEN n = 1 THEN 'column check'
                ELSE 'check' END AS placement, columns,
            CASE WHEN rule = 'r' THEN concat('("', replace(columns, ',', '", "'), '")')
                WHEN rule <> 'a' AND n = 1 THEN '(v > 0) AND (v < 9)'
                WHEN rule <> 'a' THEN 'CHECK ((v > 0) AND (v < 9))' END AS definition,
            CAST(NULL AS VARCHAR) AS warning
        FROM ({GATHERED}) AS g
        UNION ALL SELECT DISTINCT db, table_name, NULL, 'primary key', '', NULL, 'primary key definition not found'
        FROM KEY_ROWS WHERE rule <> 'a'""",
    ),
)
def _assemble_constraints(spark, sf_dir):
    rows = frame(spark, sf_dir, "KEY_ROWS")
    kind = F.when(F.col("rule") == "a", "p").when(F.col("rule") == "r", "u").otherwise("c")
    constraints = rows.select(
        "db",
        "table_name",
        "constraint_name",
        kind.alias("constraint_type"),
        F.when(kind == "c", "CHECK ((v > 0) AND (v < 9))").alias("check_def"),
        "position",
        "column_name",
    )
    found = assemble.assemble_constraints(rows.select("db", "table_name"), constraints, DB)
    return found.withColumn("columns", F.array_join("columns", ","))


@query(
    "assemble_indexes",
    oracle(
        "KEY_ROWS",
        f"""
        SELECT db, table_name, constraint_name AS index_name, columns AS dimensions,
            rule IN ('c', 'n') AS is_unique, NOT (n = 1 AND rule IN ('c', 'n')) AS listed
        FROM ({GATHERED}) AS g WHERE rule NOT IN ('a', 'r')""",
    ),
)
def _assemble_indexes(spark, sf_dir):
    rows = frame(spark, sf_dir, "KEY_ROWS").select(
        "db",
        "table_name",
        F.col("constraint_name").alias("index_name"),
        F.col("rule").isin("c", "n", "a").alias("is_unique"),
        (F.col("rule") == "a").alias("is_primary"),
        F.lit("BTREE").alias("method"),
        F.lit(None).cast("string").alias("predicate"),
        "position",
        F.col("column_name").alias("dimension"),
    )
    backing = frame(spark, sf_dir, "KEY_ROWS").filter("rule = 'r'").select("db", "table_name", "constraint_name")
    indexes, columns = assemble.assemble_indexes(rows, backing, DB)
    listed_indexes = indexes.select(
        "db", "table_name", "index_name", F.array_join("dimensions", ",").alias("dimensions"), "is_unique",
        F.lit(True).alias("listed"),
    )
    single = columns.select(
        "db", "table_name", F.regexp_replace("table_name", "T", "fk").alias("index_name"),
        F.col("column_name").alias("dimensions"), F.lit(True).alias("is_unique"), F.lit(False).alias("listed"),
    )
    return listed_indexes.unionByName(single)


@query(
    "assemble_triggers",
    oracle(
        "KEY_ROWS",
        """SELECT db, table_name, constraint_name AS trigger_name, 'AFTER' AS timing, 'ROW' AS orientation,
            'audit.log()' AS function_call, string_agg(DISTINCT event, ',' ORDER BY event) AS events
        FROM (SELECT *, CASE position % 3 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END AS event
            FROM KEY_ROWS) AS k GROUP BY db, table_name, constraint_name""",
    ),
)
def _assemble_triggers(spark, sf_dir):
    event = F.element_at(F.array(F.lit("INSERT"), F.lit("UPDATE"), F.lit("DELETE")), F.col("position") % 3 + 1)
    rows = frame(spark, sf_dir, "KEY_ROWS").select(
        "db",
        "table_name",
        F.col("constraint_name").alias("trigger_name"),
        event.alias("event"),
        F.lit("AFTER").alias("timing"),
        F.lit("ROW").alias("orientation"),
        F.lit("EXECUTE FUNCTION audit.log()").alias("statement"),
    )
    return assemble.assemble_triggers(rows, DB).withColumn("events", F.array_join("events", ","))


FIXTURES["SERIAL_COLUMNS"] = f"""
    SELECT db, concat('T', CAST(n_nationkey % 5 AS VARCHAR(5))) AS table_name, n_name AS column_name,
        CASE WHEN n_nationkey % 3 = 0 THEN 'bigint' ELSE 'integer' END AS data_type, n_nationkey % 8 = 6 AS nullable,
        CASE WHEN n_nationkey % 4 = 2 THEN concat('nextval(''', CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'public.'
            ELSE '"app"."' END, n_name, CASE n_nationkey % 3 WHEN 2 THEN '_seq"' ELSE '_seq' END, '''::regclass)') ELSE '0' END AS dflt
    FROM ({GRID}) AS g
"""
FIXTURES["SEQUENCES"] = f"SELECT db, concat(n_name, '_seq') AS sequence_name FROM ({GRID}) AS g WHERE n_nationkey % 2 = 0"


@query(
    "collapse_serials",
    oracle(
        "SERIAL_COLUMNS SEQUENCES",
        """
        SELECT 'column' AS kind, db, column_name AS name,
            CASE WHEN dflt LIKE 'nextval%' AND NOT nullable THEN CASE data_type WHEN 'bigint' THEN 'bigserial'
                ELSE 'serial' END ELSE data_type END AS data_type,
            CASE WHEN NOT (dflt LIKE 'nextval%' AND NOT nullable) THEN dflt END AS dflt FROM SERIAL_COLUMNS
        UNION ALL SELECT 'sequence', s.db, s.sequence_name, NULL, NULL FROM SEQUENCES s WHERE NOT EXISTS (
            SELECT 1 FROM SERIAL_COLUMNS c WHERE c.db = s.db AND concat(c.column_name, '_seq') = s.sequence_name
                AND c.dflt LIKE 'nextval%' AND NOT c.nullable)""",
    ),
)
def _collapse_serials(spark, sf_dir):
    columns, sequences = assemble.collapse_serials(
        frame(spark, sf_dir, "SERIAL_COLUMNS"), frame(spark, sf_dir, "SEQUENCES"), DB
    )
    return columns.select(
        F.lit("column").alias("kind"), "db", F.col("column_name").alias("name"), "data_type", "dflt"
    ).unionByName(
        sequences.select(F.lit("sequence").alias("kind"), "db", F.col("sequence_name").alias("name")),
        allowMissingColumns=True,
    )


@query(
    "assemble_columns",
    oracle(
        "GRID",
        """SELECT db, concat('T', CAST(n_nationkey % 5 AS VARCHAR)) AS table_name, n_nationkey AS position,
            n_name AS column_name, CASE n_nationkey % 4 WHEN 0 THEN 'int4' WHEN 1 THEN 'numeric(12,3)' WHEN 2 THEN 'varchar(40)'
                ELSE 'timestamptz(3)' END AS data_type, n_nationkey % 2 = 0 AS nullable,
            CASE WHEN n_nationkey % 3 = 0 THEN '0' END AS dflt,
            CASE WHEN n_nationkey % 6 = 1 THEN lower(n_name) END AS description
        FROM GRID WHERE n_nationkey > 0 AND (db + n_nationkey) % 9 <> 0""",
    ),
)
def _assemble_columns(spark, sf_dir):
    grid = frame(spark, sf_dir, "GRID").withColumn("table_id", F.col("n_nationkey") % 5).withColumn(
        "type_id", F.col("n_nationkey") % 4
    )
    tables = grid.filter("n_nationkey < 5").select(
        "db", "table_id", F.concat(F.lit("T"), F.col("table_id").cast("string")).alias("table_name")
    )
    names = F.element_at(F.array(*[F.lit(t) for t in ("int4", "numeric", "varchar", "timestamptz")]), F.col("type_id") + 1)
    types = grid.filter("n_nationkey < 4").select("db", "type_id", names.alias("type_name"))
    columns = grid.select(
        "db",
        "table_id",
        F.col("n_nationkey").alias("position"),
        F.col("n_name").alias("column_name"),
        "type_id",
        # As the catalog keeps them: a length plus 4, precision and scale in one number plus 4, a precision.
        F.when(F.col("type_id") == 2, 44).when(F.col("type_id") == 1, (12 << 16) + 3 + 4).when(F.col("type_id") == 3, 3).otherwise(-1).alias("type_mod"),
        (F.col("n_nationkey") % 2 != 0).alias("not_null"),
        ((F.col("db") + F.col("n_nationkey")) % 9 == 0).alias("dropped"),
    )
    place = ["db", "table_id", F.col("n_nationkey").alias("position")]
    defaults = grid.filter("n_nationkey % 3 = 0").select(*place, F.lit("0").alias("dflt"))
    notes = grid.filter("n_nationkey % 6 = 1").select(*place, F.lower("n_name").alias("description"))
    return assemble.assemble_columns(tables, columns, types, defaults, notes, DB)
