"""Queries of dependency ordering and lineage."""

from __future__ import annotations

from rowtide.operators import graph
from rowtide.plans.fixtures import FIXTURES, frame, oracle
from rowtide.plans.registry import query

FIXTURES["NODES"] = "SELECT conv_id AS grp, turn AS node FROM conversations"
FIXTURES["CYCLE_AND_SELF"] = (
    FIXTURES["CYCLE_EDGES"] + " UNION SELECT conv_id, turn, turn FROM conversations WHERE conv_id % 7 = 0 AND turn = 0"
)

LEVELS = """WITH RECURSIVE lv(grp, node, level) AS (
        SELECT grp, node, 0 FROM NODES
        UNION SELECT e.grp, e.child, lv.level + 1 FROM lv JOIN CHAIN_EDGES e ON e.grp = lv.grp AND e.parent = lv.node),
    levels AS (SELECT grp, node, max(level) AS level FROM lv GROUP BY grp, node)
    SELECT {0} FROM levels"""


def chain(spark, sf_dir):
    return frame(spark, sf_dir, "NODES"), frame(spark, sf_dir, "CHAIN_EDGES")


@query("dependency_levels", oracle("NODES CHAIN_EDGES", LEVELS.format("grp, node, level")))
def _dependency_levels(spark, sf_dir):
    return graph.dependency_levels(*chain(spark, sf_dir), ["grp"], "node")


@query(
    "dependency_cycles",
    """SELECT conv_id AS grp, turn AS node, 'cycle' AS reason FROM conversations WHERE conv_id % 10 = 0 AND conv_id IN
        (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) > 0)
    UNION ALL SELECT conv_id, turn, 'self' FROM conversations WHERE conv_id % 7 = 0 AND turn = 0""",
)
def _dependency_cycles(spark, sf_dir):
    nodes, edges = frame(spark, sf_dir, "NODES"), frame(spark, sf_dir, "CYCLE_AND_SELF")
    return graph.dependency_cycles(nodes, edges, ["grp"], "node")


@query(
    "drop_order",
    oracle("NODES CHAIN_EDGES", LEVELS.format("grp, node, max(level) OVER (PARTITION BY grp) - level AS drop_order")),
)
def _drop_order(spark, sf_dir):
    levels = graph.dependency_levels(*chain(spark, sf_dir), ["grp"], "node")
    return graph.drop_order(levels, ["grp"], "node")


SCHEMA_OF = "CASE WHEN {0} % 2 = 0 THEN 'public' ELSE 'audit' END"
FIXTURES["VIEWS"] = f"""
    SELECT conv_id, {SCHEMA_OF.format("turn")} AS schema_name, concat('V', CAST(turn AS VARCHAR(5))) AS view_name
    FROM conversations
"""
FIXTURES["VIEW_DEPS"] = f"""
    SELECT conv_id, {SCHEMA_OF.format("turn")} AS schema_name, concat('V', CAST(turn AS VARCHAR(5))) AS view_name,
        concat('v', CAST(turn - 2 AS VARCHAR(5))) AS depends_on
    FROM conversations
    WHERE turn >= 2
    UNION ALL
    SELECT conv_id, {SCHEMA_OF.format("turn")}, concat('V', CAST(turn AS VARCHAR(5))),
        concat({SCHEMA_OF.format("(turn - 1)")}, '.V', CAST(turn - 1 AS VARCHAR(5)))
    FROM conversations
    WHERE turn % 3 = 1
    UNION ALL
    SELECT conv_id, {SCHEMA_OF.format("turn")}, concat('V', CAST(turn AS VARCHAR(5))), 'nowhere.v0'
    FROM conversations
    WHERE turn % 5 = 4
"""
FIXTURES["VIEW_EDGES"] = """
    SELECT conv_id AS grp, turn AS child, turn - 2 AS parent FROM conversations WHERE turn >= 2
    UNION
    SELECT conv_id, turn, turn - 1 FROM conversations WHERE turn % 3 = 1
"""


@query(
    "view_order",
    oracle(
        "NODES VIEW_EDGES",
        LEVELS.replace("CHAIN_EDGES", "VIEW_EDGES").format(
            f"grp AS conv_id, concat({SCHEMA_OF.format('node')}, '.v', CAST(node AS VARCHAR)) AS view, level, "
            "CAST(NULL AS VARCHAR) AS unknown_view"
        )
        + f""" UNION ALL SELECT conv_id, concat({SCHEMA_OF.format("turn")}, '.v', CAST(turn AS VARCHAR)), NULL,
            'nowhere.v0' FROM conversations WHERE turn % 5 = 4""",
    ),
)
def _view_order(spark, sf_dir):
    views, needs = frame(spark, sf_dir, "VIEWS"), frame(spark, sf_dir, "VIEW_DEPS")
    order, errors = graph.view_order(views, needs, ["conv_id"])
    return order.unionByName(errors, allowMissingColumns=True)


FIXTURES["REF_COLUMNS"] = """
    SELECT conv_id, turn AS column_id,
        CASE WHEN turn = 0 AND conv_id % 9 <> 0 THEN CASE WHEN conv_id % 2 = 0 THEN 'bigserial' ELSE 'serial' END
            WHEN turn % 4 = 3 THEN 'text' END AS data_type,
        CASE WHEN turn > 0 THEN turn - 1 END AS references_id
    FROM conversations
"""


@query(
    "terminal_reference",
    oracle(
        "REF_COLUMNS",
        """
        , ends AS (SELECT c.conv_id, c.column_id, c.data_type, coalesce((SELECT max(t.column_id) FROM REF_COLUMNS t
            WHERE t.conv_id = c.conv_id AND t.column_id <= c.column_id AND t.data_type IS NOT NULL), 0) AS terminal_id
            FROM REF_COLUMNS c)
        SELECT e.conv_id, e.column_id, e.terminal_id,
            CASE WHEN e.data_type IS NOT NULL THEN e.data_type WHEN t.data_type = 'serial' THEN 'int'
                WHEN t.data_type = 'bigserial' THEN 'bigint' ELSE t.data_type END AS resolved_type,
            CAST(e.column_id - e.terminal_id AS INTEGER) AS steps
        FROM ends e JOIN REF_COLUMNS t ON t.conv_id = e.conv_id AND t.column_id = e.terminal_id""",
    ),
)
def _terminal_reference(spark, sf_dir):
    return graph.terminal_reference(frame(spark, sf_dir, "REF_COLUMNS"), ["conv_id"])


FIXTURES["USER_TYPES"] = """
    SELECT db, 'public' AS schema_name, concat('Type', CAST(n_nationkey AS VARCHAR(5))) AS type_name
    FROM ({0}) AS g
    WHERE n_nationkey < 6
""".format(FIXTURES["GRID"])
FIXTURES["TYPE_USERS"] = """
    SELECT db, CASE WHEN n_nationkey % 2 = 0 THEN 'column' ELSE 'function' END AS kind, n_name AS object,
        CASE n_nationkey % 4 WHEN 0 THEN concat('type', CAST(n_nationkey % 7 AS VARCHAR(5)))
            WHEN 1 THEN concat('PUBLIC.TYPE', CAST(n_nationkey % 7 AS VARCHAR(5)), '[]')
            WHEN 2 THEN 'int' ELSE concat('Type', CAST(n_nationkey % 7 AS VARCHAR(5)), ' []') END AS used_type
    FROM ({0}) AS g
""".format(FIXTURES["GRID"])


@query(
    "type_dependents",
    oracle(
        "USER_TYPES TYPE_USERS",
        """SELECT DISTINCT u.db, t.schema_name, t.type_name, u.kind, u.object FROM TYPE_USERS u JOIN USER_TYPES t
        ON t.db = u.db AND lower(rtrim(u.used_type, '[] ')) IN (lower(t.type_name),
            lower(concat(t.schema_name, '.', t.type_name)))""",
    ),
)
def _type_dependents(spark, sf_dir):
    return graph.type_dependents(frame(spark, sf_dir, "USER_TYPES"), frame(spark, sf_dir, "TYPE_USERS"), ["db"])


FIXTURES["STATEMENTS"] = """
    SELECT conv_id, turn, CASE turn % 6
        WHEN 0 THEN concat('select a, b  from sales.T', CAST(turn AS VARCHAR(5)), ' WHERE role = 1')
        WHEN 1 THEN concat('INSERT INTO t', CAST(turn AS VARCHAR(5)), ' VALUES (1)')
        WHEN 2 THEN concat('Delete From only x.t', CAST(turn AS VARCHAR(5)), ' WHERE a = 1')
        WHEN 3 THEN concat('UPDATE t', CAST(turn AS VARCHAR(5)), ' SET a = 1')
        WHEN 4 THEN concat('INSERT INTO log.t1 SELECT * FROM live.t', CAST(turn AS VARCHAR(5)))
        ELSE concat('PERFORM ', role) END AS statement
    FROM conversations
"""


@query(
    "statement_lineage",
    oracle(
        "STATEMENTS",
        """SELECT conv_id, turn, statement,
            CASE turn % 6 WHEN 0 THEN 'sales' WHEN 2 THEN 'x' WHEN 4 THEN 'live' WHEN 5 THEN NULL ELSE 'public' END
                AS table_schema,
            CASE turn % 6 WHEN 0 THEN 'T' WHEN 5 THEN NULL ELSE 't' END || CAST(turn AS VARCHAR) AS table_name
        FROM STATEMENTS""",
    ),
)
def _statement_lineage(spark, sf_dir):
    return graph.statement_lineage(frame(spark, sf_dir, "STATEMENTS"), "statement")


FIXTURES["SCRIPTS"] = """
    SELECT conv_id, turn, CASE turn % 6
        WHEN 0 THEN concat('SELECT extract(year FROM d), ''from no.t'' FROM s.T', CAST(turn AS VARCHAR(5)), ' a JOIN "U" b ON a.x IS DISTINCT FROM b.x')
        WHEN 1 THEN concat('/* FROM old.t */ WITH w AS (SELECT * FROM base.t', CAST(turn AS VARCHAR(5)), ') INSERT INTO log SELECT * FROM w, live')
        WHEN 2 THEN concat('DELETE FROM ONLY x.t', CAST(turn AS VARCHAR(5)), ' USING u WHERE trim(both '' '' FROM name) = ''a''')
        WHEN 3 THEN concat('UPDATE t', CAST(turn AS VARCHAR(5)), ' SET a = (SELECT max(b) FROM y.u) -- FROM z')
        WHEN 4 THEN concat('select * from f(1), t', CAST(turn AS VARCHAR(5)), ' for update')
        ELSE concat('PERFORM ', role) END AS statement
    FROM conversations
"""


@query(
    "statement_tables",
    oracle(
        "SCRIPTS",
        """SELECT s.conv_id, s.turn, t.table_schema, t.name || CASE WHEN t.numbered THEN CAST(s.turn AS VARCHAR) ELSE '' END AS table_name, t.role
        FROM SCRIPTS s JOIN (VALUES (0, 's', 'T', TRUE, 'read'), (0, 'public', 'U', FALSE, 'read'), (1, 'base', 't', TRUE, 'read'),
            (1, 'public', 'log', FALSE, 'write'), (1, 'public', 'live', FALSE, 'read'), (2, 'x', 't', TRUE, 'write'), (2, 'public', 'u', FALSE, 'read'),
            (3, 'public', 't', TRUE, 'write'), (3, 'y', 'u', FALSE, 'read'), (4, 'public', 't', TRUE, 'read')
        ) t(form, table_schema, name, numbered, role) ON t.form = s.turn % 6""",
    ),
)
def _statement_tables(spark, sf_dir):
    return graph.lineage(frame(spark, sf_dir, "SCRIPTS"), "statement").drop("statement")


FIXTURES["FK_TEXTS"] = """
    SELECT db, n_name AS constraint_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Public' END AS ref_schema,
        CASE WHEN n_nationkey % 2 = 0 THEN concat('t', CAST(n_nationkey % 6 AS VARCHAR(5))) END AS ref_table,
        CASE WHEN n_nationkey % 2 = 1 THEN concat('FOREIGN KEY (x) references "public"."T',
            CAST(n_nationkey % 6 AS VARCHAR(5)), '" ("id")') END AS definition
    FROM ({0}) AS g
""".format(FIXTURES["GRID"])
FIXTURES["RENAMED"] = """
    SELECT db, 'public' AS schema_name, concat('T', CAST(n_nationkey AS VARCHAR(5))) AS table_name, n_nationkey AS nr
    FROM ({0}) AS g
    WHERE n_nationkey < 6 AND (db + n_nationkey) % 2 = 0
""".format(FIXTURES["GRID"])


@query(
    "affected_by_rename",
    oracle(
        "FK_TEXTS RENAMED",
        """SELECT f.db, f.constraint_name, f.ref_schema, f.ref_table, f.definition FROM FK_TEXTS f
        JOIN nation n ON n.n_name = f.constraint_name
        WHERE EXISTS (SELECT 1 FROM RENAMED r WHERE r.db = f.db AND r.nr = n.n_nationkey % 6)""",
    ),
)
def _affected_by_rename(spark, sf_dir):
    return graph.affected_by_rename(frame(spark, sf_dir, "FK_TEXTS"), frame(spark, sf_dir, "RENAMED"), ["db"])
