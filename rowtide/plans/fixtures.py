"""Inputs of the registered queries, derived from the given tables.

Each text runs unchanged in Spark and in the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

FIXTURES: dict[str, str] = {}


# Schemas found so far, by path, so that a table's footers are read once.
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _needed(text: str) -> set[str]:
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
    return words & set(TABLES)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named fixture as a DataFrame."""
    return sql(spark, sf_dir, FIXTURES[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    for used in _needed(text):
        table(spark, sf_dir, used).createOrReplaceTempView(used)
    return spark.sql(text)


def oracle(names: str, body: str) -> str:
    """Oracle text: the named fixtures as a WITH list in front of ``body``."""
    parts = [f"{n} AS ({FIXTURES[n]})" for n in names.split()]
    if not parts:
        return body
    text = body.lstrip()
    if text.startswith(","):
        return "WITH " + ", ".join(parts) + text
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + text[len("WITH RECURSIVE") :]
    if text.upper().startswith("WITH"):
        return "WITH " + ", ".join(parts) + ", " + text[len("WITH") :]
    return "WITH " + ", ".join(parts) + " " + text

# -- snapshots, layers, cells, constraints, graphs, catalogs, grants -----------

FIXTURES["ORD_OLD"] = """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders
    WHERE o_orderkey % 10 <> 3
"""

FIXTURES["ORD_NEW"] = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, CASE WHEN
        o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, CASE
        WHEN o_orderkey % 7 = 0 THEN 'CHANGED' ELSE o_orderpriority END AS o_orderpriority
    FROM orders
    WHERE o_orderkey % 10 <> 4
"""

FIXTURES["ORD_NEW_T"] = """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_orderkey % 13 = 0
        AS _delete
    FROM orders
    WHERE o_orderkey % 10 <> 4
"""

FIXTURES["ORD_NEW_COLS"] = """
    SELECT o_orderkey, o_custkey, o_orderpriority AS o_priority, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN
        NULL ELSE o_orderkey % 3 END AS o_channel
    FROM orders
"""

FIXTURES["LI_OLD"] = """
    SELECT l_orderkey, l_linenumber, MAX(l_partkey) AS l_partkey, MAX(l_quantity) AS l_quantity, MAX(l_returnflag)
        AS l_returnflag
    FROM lineitem
    WHERE l_orderkey % 9 <> 2
    GROUP BY l_orderkey, l_linenumber
"""

FIXTURES["LI_NEW"] = """
    SELECT l_orderkey, l_linenumber, MAX(l_partkey) AS l_partkey, CASE WHEN l_linenumber = 2 THEN 0 ELSE
        MAX(l_quantity) END AS l_quantity, MAX(l_returnflag) AS l_returnflag
    FROM lineitem
    WHERE l_orderkey % 9 <> 5
    GROUP BY l_orderkey, l_linenumber
"""

FIXTURES["LAYER_1"] = """
    SELECT o_orderkey, 'L1' AS o_orderpriority
    FROM orders
    WHERE o_orderkey % 5 = 0
"""

FIXTURES["LAYER_2"] = """
    SELECT o_orderkey, CAST('X' AS VARCHAR(1)) AS o_orderstatus, o_orderkey % 150 = 0 AS _delete
    FROM orders
    WHERE o_orderkey % 15 = 0
    UNION ALL SELECT o_orderkey + 1000000, 'N', FALSE
    FROM orders
    WHERE o_orderkey % 100 = 0
"""

FIXTURES["CELLS"] = """
    SELECT c_custkey, c_custkey % 5 = 0 AS is_null, c_custkey % 5 = 1 AS is_empty, c_custkey % 5 = 2 AS is_sql,
        CASE c_custkey % 5 WHEN 2 THEN ' Default ' WHEN 4 THEN c_mktsegment ELSE '' END AS txt
    FROM customer
"""

FIXTURES["TABROWS"] = """
    SELECT concat(CAST(c_custkey AS VARCHAR(20)), '|', c_name, '|', CASE WHEN c_nationkey % 4 = 0 THEN
        concat(chr(92), 'N') ELSE CAST(c_nationkey AS VARCHAR(20)) END) AS line
    FROM customer
"""

FIXTURES["FK_CHILD"] = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS o_custkey
    FROM orders
"""

FIXTURES["FK_PARENT"] = """
    SELECT c_custkey, c_name
    FROM customer
    WHERE c_custkey % 8 <> 1
"""

FIXTURES["DOMAIN"] = """
    SELECT c_custkey, CASE WHEN c_custkey % 21 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN 'OTHER' ELSE
        c_mktsegment END AS segment, c_acctbal AS balance, CASE WHEN c_custkey % 14 = 0 THEN 'n/a' ELSE
        CAST(c_custkey * 3000000 AS VARCHAR(20)) END AS int_text
    FROM customer
"""

FIXTURES["PARTS"] = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey - 700 END AS k
    FROM orders
"""

FIXTURES["PARTY"] = """
    SELECT 'customer' AS src, c_custkey AS id, c_name AS name, c_nationkey AS nationkey
    FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey
    FROM supplier
"""

FIXTURES["CHAIN_EDGES"] = """
    SELECT conv_id AS grp, turn AS child, turn - 1 AS parent
    FROM conversations
    WHERE turn > 0
    UNION SELECT conv_id, turn, CAST(floor(turn / 2) AS BIGINT)
    FROM conversations
    WHERE turn > 1
"""

FIXTURES["CYCLE_EDGES"] = """
    SELECT conv_id AS grp, turn AS child, turn - 1 AS parent
    FROM conversations
    WHERE turn > 0
    UNION SELECT conv_id, 0, MAX(turn)
    FROM conversations
    WHERE conv_id % 10 = 0
    GROUP BY conv_id
    HAVING MAX(turn) > 0
"""

# One catalog column per row, for a fleet of databases of 25 columns each.
GRID = """
    SELECT CAST(floor(c_custkey / 25) AS BIGINT) AS db, n_nationkey, n_name
    FROM customer JOIN nation ON c_custkey % 25 = n_nationkey
"""

FIXTURES["GRID"] = GRID

FIXTURES["CAT_OLD"] = f"""
    SELECT db, concat('T', CAST(n_nationkey % 5 AS VARCHAR(5))) AS table_name, n_name AS column_name,
        CASE n_nationkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'text' WHEN 2 THEN 'serial' ELSE 'varchar(40)' END
            AS data_type,
        n_nationkey % 2 = 0 AS nullable,
        CASE WHEN n_nationkey % 3 = 0 THEN '0' END AS dflt
    FROM ({GRID}) AS g
"""

FIXTURES["CAT_NEW"] = f"""
    SELECT db, concat('T', CAST(n_nationkey % 5 AS VARCHAR(5))) AS table_name,
        CASE WHEN n_nationkey % 6 = 0 THEN lower(n_name) ELSE n_name END AS column_name,
        CASE WHEN (db + n_nationkey) % 11 = 0 THEN 'bigint' WHEN n_nationkey % 4 = 0 THEN 'int'
            WHEN n_nationkey % 4 = 1 THEN 'text' WHEN n_nationkey % 4 = 2 THEN 'serial' ELSE 'varchar(40)' END
            AS data_type,
        (n_nationkey + CASE WHEN db % 7 = 0 THEN 1 ELSE 0 END) % 2 = 0 AS nullable,
        CASE WHEN n_nationkey % 3 = 0 AND db % 5 <> 0 THEN '0' END AS dflt
    FROM ({GRID}) AS g
    WHERE (db + n_nationkey) % 13 <> 0
    UNION ALL
    SELECT CAST(floor(c_custkey / 25) AS BIGINT), 'T0', 'EXTRA', 'text', TRUE, NULL
    FROM customer
    WHERE c_custkey % 75 = 0
"""

FIXTURES["OPTIONS_OLD"] = """
    SELECT CAST(floor(event_id / 2) AS BIGINT) AS owner, concat('(kind=', event_type, ',fill=', CAST(user_id AS
        VARCHAR(20)), ')') AS opts
    FROM events
    WHERE event_id % 2 = 0
"""

FIXTURES["OPTIONS_NEW"] = """
    SELECT CAST(floor(event_id / 2) AS BIGINT) AS owner, CASE WHEN event_id % 3 = 0 THEN concat('(KIND=',
        upper(event_type), ')') ELSE concat('(kind=', event_type, ',oids=true)') END AS opts
    FROM events
    WHERE event_id % 2 = 1
"""

FIXTURES["ACL"] = """
    SELECT DISTINCT event_type AS object, CASE WHEN user_id % 10 = 0 THEN concat('u', CAST(user_id AS
        VARCHAR(20)), '_ro') WHEN user_id % 10 = 1 THEN '' ELSE concat('u', CAST(user_id AS VARCHAR(20))) END AS
        grantee, CASE user_id % 4 WHEN 0 THEN 'r' WHEN 1 THEN 'rw' WHEN 2 THEN 'arwd' ELSE 'U' END AS codes
    FROM events
"""

FIXTURES["DECL"] = """
    SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS segment, CASE WHEN
        c_custkey % 2 = 0 THEN 't' ELSE 'False' END AS flag, c_custkey % 15 = 0 AS _delete
    FROM customer
    WHERE c_custkey % 3 = 0
"""

FIXTURES["LIVE"] = """
    SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'f' END AS flag
    FROM customer
    WHERE c_custkey % 20 <> 0
    UNION ALL SELECT c_custkey, c_mktsegment, 'true'
    FROM customer
    WHERE c_custkey % 33 = 0 AND c_custkey % 20 <> 0
"""

