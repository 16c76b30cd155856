"""Queries of the constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.operators import checks
from rowtide.operators.inheritance import inherited_columns
from rowtide.plans.fixtures import FIXTURES, frame, oracle, table
from rowtide.plans.registry import query
from rowtide.spec import CheckSpec, ColumnSpec, DomainSpec, EnumSpec, ForeignKeySpec, TableSpec, UniqueSpec

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENT_LIST = ", ".join(f"'{s}'" for s in SEGMENTS)
SEGMENT = EnumSpec("segment_enum", SEGMENTS)
BALANCE = DomainSpec(
    "balance_domain", "double precision", False, None, (CheckSpec("positive", "CHECK ((VALUE > 0))"),
                                                       CheckSpec("bounded", "VALUE < 9000"))
)
INT_TEXT = DomainSpec("int_domain", "int", True, None, (CheckSpec("small", "CHECK (VALUE < 1000000000)"),))
CUSTOMER_FK = ForeignKeySpec(("o_custkey",), "customer", ("c_custkey",), "orders_customer_fk")


@query(
    "check_primary_key",
    """SELECT 'lineitem_pkey' AS constraint_name, l_orderkey, l_linenumber, 'duplicate' AS violation, count(*) AS n
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def _check_primary_key(spark, sf_dir):
    return checks.check_primary_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem_pkey")


@query(
    "check_unique",
    oracle(
        "DOMAIN",
        """SELECT 'segment_balance_unique' AS constraint_name, segment, balance_band, count(*) AS n
        FROM (SELECT segment, CAST(floor(balance / 100) AS BIGINT) AS balance_band FROM DOMAIN) AS d
        WHERE segment IS NOT NULL AND balance_band IS NOT NULL GROUP BY segment, balance_band HAVING count(*) > 1""",
    ),
)
def _check_unique(spark, sf_dir):
    rows = frame(spark, sf_dir, "DOMAIN").select("segment", F.floor(F.col("balance") / 100).alias("balance_band"))
    return checks.check_unique(rows, ["segment", "balance_band"], "segment_balance_unique")


@query(
    "check_partial_unique",
    """SELECT 'open_order_unique' AS constraint_name, o_custkey, lower(o_orderpriority) AS expression_1, count(*) AS n
    FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IS NOT NULL
    GROUP BY o_custkey, lower(o_orderpriority) HAVING count(*) > 1""",
)
def _check_partial_unique(spark, sf_dir):
    rule = UniqueSpec("open_order_unique", ("o_custkey",), ("lower(o_orderpriority)",), "(o_orderstatus = 'O')")
    return checks.check_partial_unique(table(spark, sf_dir, "orders"), rule)


@query(
    "check_not_null",
    oracle(
        "DOMAIN FK_CHILD",
        """SELECT * FROM (
            SELECT 'segment_not_null' AS constraint_name, 'segment' AS column_name, count(*) AS n FROM DOMAIN
            WHERE segment IS NULL
            UNION ALL SELECT 'balance_not_null', 'balance', count(*) FROM DOMAIN WHERE balance IS NULL
            UNION ALL SELECT 'int_text_not_null', 'int_text', count(*) FROM DOMAIN WHERE int_text IS NULL
            UNION ALL SELECT 'o_custkey_not_null', 'o_custkey', count(*) FROM FK_CHILD WHERE o_custkey IS NULL) AS v
        WHERE n > 0""",
    ),
)
def _check_not_null(spark, sf_dir):
    domain = checks.check_not_null(frame(spark, sf_dir, "DOMAIN"), ["segment", "balance", "int_text"])
    return domain.unionByName(checks.check_not_null(frame(spark, sf_dir, "FK_CHILD"), ["o_custkey"]))


@query(
    "check_foreign_key",
    oracle(
        "FK_CHILD FK_PARENT",
        """SELECT 'orders_customer_fk' AS constraint_name, o_custkey, count(*) AS n FROM FK_CHILD
        WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM FK_PARENT) GROUP BY o_custkey""",
    ),
)
def _check_foreign_key(spark, sf_dir):
    return checks.check_foreign_key(frame(spark, sf_dir, "FK_CHILD"), frame(spark, sf_dir, "FK_PARENT"), CUSTOMER_FK)


@query(
    "check_foreign_key_rows",
    """SELECT 'line_pair_fk' AS constraint_name, l.l_orderkey, l.l_linenumber, l.l_partkey FROM lineitem l
    WHERE NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_linenumber > 1 AND p.l_orderkey = l.l_orderkey
        AND p.l_linenumber = l.l_linenumber)""",
)
def _check_foreign_key_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    fk = ForeignKeySpec(("l_orderkey", "l_linenumber"), "lineitem", (), "line_pair_fk")
    return checks.check_foreign_key(lines, lines.filter("l_linenumber > 1"), fk, detail="rows")


@query(
    "check_expression",
    oracle(
        "DOMAIN",
        """SELECT 'balance_check' AS constraint_name, c_custkey, segment, balance, int_text FROM DOMAIN
        WHERE NOT (balance > 0 AND segment <> 'OTHER')""",
    ),
)
def _check_expression(spark, sf_dir):
    return checks.check_expression(
        frame(spark, sf_dir, "DOMAIN"), "balance_check", "CHECK ((balance > 0) AND (segment <> 'OTHER'))"
    )


@query(
    "check_enum",
    oracle(
        "DOMAIN",
        f"""SELECT 'segment_enum' AS constraint_name, c_custkey, segment FROM DOMAIN
        WHERE segment NOT IN ({SEGMENT_LIST})""",
    ),
)
def _check_enum(spark, sf_dir):
    return checks.check_enum(frame(spark, sf_dir, "DOMAIN").select("c_custkey", "segment"), "segment", SEGMENT)


@query(
    "check_domain",
    oracle(
        "DOMAIN",
        """SELECT 'balance_domain' AS constraint_name, c_custkey, 'positive' AS violation FROM DOMAIN WHERE balance <= 0
        UNION ALL SELECT 'balance_domain', c_custkey, 'bounded' FROM DOMAIN WHERE balance >= 9000
        UNION ALL SELECT 'balance_domain', c_custkey, 'not_null' FROM DOMAIN WHERE balance IS NULL
        UNION ALL SELECT 'int_domain', c_custkey, 'type' FROM DOMAIN
        WHERE int_text IS NOT NULL AND TRY_CAST(int_text AS INTEGER) IS NULL
        UNION ALL SELECT 'int_domain', c_custkey, 'small' FROM DOMAIN WHERE TRY_CAST(int_text AS INTEGER) >= 1000000000""",
    ),
)
def _check_domain(spark, sf_dir):
    rows = frame(spark, sf_dir, "DOMAIN")
    columns = ["constraint_name", "c_custkey", "violation"]
    balance = checks.check_domain(rows, "balance", BALANCE).select(*columns)
    return balance.unionByName(checks.check_domain(rows, "int_text", INT_TEXT).select(*columns))


@query(
    "check_type_fit",
    oracle(
        "DOMAIN",
        """SELECT 'int_text_type' AS constraint_name, c_custkey, int_text AS value FROM DOMAIN
        WHERE int_text IS NOT NULL AND TRY_CAST(int_text AS INTEGER) IS NULL
        UNION ALL SELECT 'segment_length', c_custkey, segment FROM DOMAIN WHERE length(segment) > 8
        UNION ALL SELECT 'segment_bool', c_custkey, segment FROM DOMAIN WHERE segment IS NOT NULL""",
    ),
)
def _check_type_fit(spark, sf_dir):
    rows = frame(spark, sf_dir, "DOMAIN")
    ints = checks.check_type_fit(rows, "int_text", "int")
    long = checks.check_type_fit(rows, "segment", "varchar(8)", "segment_length")
    flags = checks.check_type_fit(rows, "segment", "boolean", "segment_bool")
    out = ints.select("constraint_name", "c_custkey", F.col("int_text").alias("value"))
    for part in (long, flags):
        out = out.unionByName(part.select("constraint_name", "c_custkey", F.col("segment").alias("value")))
    return out


@query(
    "check_partition_rule",
    oracle(
        "PARTS",
        """SELECT 'partition_rule' AS constraint_name, o_orderkey, k, CAST(abs(k) % 8 AS BIGINT) AS part FROM PARTS
        WHERE k IS NOT NULL AND ((k % 8) + 8) % 8 <> abs(k) % 8""",
    ),
)
def _check_partition_rule(spark, sf_dir):
    # Rows placed by the sign-blind rule, which is wrong for most negative keys.
    routed = frame(spark, sf_dir, "PARTS").withColumn("part", F.abs(F.col("k")) % 8)
    return checks.check_partition_rule(routed, "k", "part", 8)


FIXTURES["DECLARED_KEYS"] = """
    SELECT conv_id, turn, concat('c', CAST(turn % 3 AS VARCHAR(5))) AS column_name FROM conversations
    UNION ALL
    SELECT conv_id, turn, concat('C', CAST((turn + 1) % 4 AS VARCHAR(5))) FROM conversations
"""
FIXTURES["OWN_COLUMNS"] = """
    SELECT conv_id, turn, concat('c', CAST(turn % 3 AS VARCHAR(5))) AS column_name, role AS data_type FROM conversations
    UNION ALL
    SELECT conv_id, turn, concat('k', CAST(turn AS VARCHAR(5))), 'int' FROM conversations
"""
FIXTURES["TABLE_PARENTS"] = """
    SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 END AS parent FROM conversations
"""


@query(
    "check_declared_columns",
    oracle(
        "DECLARED_KEYS OWN_COLUMNS",
        """SELECT d.conv_id, d.turn, d.column_name FROM DECLARED_KEYS d WHERE NOT EXISTS (
            SELECT 1 FROM OWN_COLUMNS c WHERE c.conv_id = d.conv_id AND c.turn <= d.turn
            AND lower(c.column_name) = lower(d.column_name))""",
    ),
)
def _check_declared_columns(spark, sf_dir):
    effective = inherited_columns(
        frame(spark, sf_dir, "OWN_COLUMNS"), frame(spark, sf_dir, "TABLE_PARENTS"), ["conv_id"], "turn", "parent"
    )
    declared = frame(spark, sf_dir, "DECLARED_KEYS")
    return checks.check_declared_columns(declared, effective, ["conv_id", "turn"], "column_name")


DOMAIN_SPEC = TableSpec(
    "accounts",
    (
        ColumnSpec("c_custkey", "bigint", nullable=False),
        ColumnSpec("segment", "varchar(9)", nullable=False, enum=SEGMENT),
        ColumnSpec("balance", "double precision", check="CHECK (balance > 0)", domain=BALANCE),
        ColumnSpec("int_text", "int"),
    ),
    ("c_custkey",),
    uniques=(UniqueSpec("segment_unique", ("segment",)),),
    checks=(CheckSpec("other_positive", "(segment <> 'OTHER' OR balance > 5000)"),),
)
CHILD_SPEC = TableSpec(
    "child",
    (ColumnSpec("o_orderkey", "bigint", False), ColumnSpec("o_custkey", "bigint")),
    ("o_custkey",),
    foreign_keys=(ForeignKeySpec(("o_custkey",), "parent", ("c_custkey",), "child_parent_fk"),),
)
PARENT_SPEC = TableSpec("parent", (ColumnSpec("c_custkey", "bigint", False),), ("c_custkey",))

REPORT = f"""
    SELECT 'accounts' AS "table", 'accounts_pkey' AS constraint_name, 'primary' AS kind, 0 AS violations
    UNION ALL SELECT 'accounts', 'c_custkey_not_null', 'other', 0
    UNION ALL SELECT 'accounts', 'c_custkey_type', 'other', 0
    UNION ALL SELECT 'accounts', 'segment_not_null', 'other', count(*) FROM DOMAIN WHERE segment IS NULL
    UNION ALL SELECT 'accounts', 'segment_enum', 'other', count(*) FROM DOMAIN WHERE segment NOT IN ({SEGMENT_LIST})
    UNION ALL SELECT 'accounts', 'segment_type', 'other', count(*) FROM DOMAIN WHERE length(segment) > 9
    UNION ALL SELECT 'accounts', 'balance_check', 'other', count(*) FROM DOMAIN WHERE balance <= 0
    UNION ALL SELECT 'accounts', 'balance_type', 'other', 0
    UNION ALL SELECT 'accounts', 'int_text_type', 'other', count(*) FROM DOMAIN
        WHERE int_text IS NOT NULL AND TRY_CAST(int_text AS INTEGER) IS NULL
    UNION ALL SELECT 'accounts', 'other_positive', 'other', count(*) FROM DOMAIN
        WHERE NOT (segment <> 'OTHER' OR balance > 5000)
    UNION ALL SELECT 'accounts', 'segment_unique', 'other', count(*) FROM DOMAIN WHERE segment IS NOT NULL
    UNION ALL SELECT 'accounts', 'balance_domain', 'other', count(*) FROM DOMAIN
        WHERE balance <= 0 OR balance >= 9000 OR balance IS NULL
    UNION ALL SELECT 'child', 'child_pkey', 'primary', CAST(sum(n) AS BIGINT) FROM (
        SELECT count(*) AS n FROM FK_CHILD GROUP BY o_custkey HAVING count(*) > 1 OR o_custkey IS NULL) AS k
    UNION ALL SELECT 'child', 'o_orderkey_not_null', 'other', 0
    UNION ALL SELECT 'child', 'o_orderkey_type', 'other', 0
    UNION ALL SELECT 'child', 'o_custkey_type', 'other', 0
    UNION ALL SELECT 'child', 'child_parent_fk', 'foreign', count(*) FROM FK_CHILD
        WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM FK_PARENT)
    UNION ALL SELECT 'parent', 'parent_pkey', 'primary', 0
    UNION ALL SELECT 'parent', 'c_custkey_not_null', 'other', 0
    UNION ALL SELECT 'parent', 'c_custkey_type', 'other', 0
"""


@query("constraint_report", oracle("DOMAIN FK_CHILD FK_PARENT", REPORT))
def _constraint_report(spark, sf_dir):
    tables = {
        "accounts": frame(spark, sf_dir, "DOMAIN"),
        "child": frame(spark, sf_dir, "FK_CHILD"),
        "parent": frame(spark, sf_dir, "FK_PARENT"),
    }
    return checks.constraint_report(tables, {"accounts": DOMAIN_SPEC, "child": CHILD_SPEC, "parent": PARENT_SPEC})


ACTIONS = (("CASCADE", "D"), ("SET NULL", "U"), ("SET DEFAULT", "U"), ("RESTRICT", "B"))


def _action_oracle(condition: str, cascade: str) -> str:
    parts = []
    for action, op in ACTIONS:
        after = {"CASCADE": cascade, "SET NULL": "NULL", "SET DEFAULT": "0"}.get(action, "o_custkey")
        parts.append(
            f"SELECT '{action}' AS constraint_name, o_orderkey, '{op}' AS op, o_custkey AS old_o_custkey, "
            f"CAST({after} AS BIGINT) AS new_o_custkey FROM FK_CHILD WHERE {condition}"
        )
    return " UNION ALL ".join(parts)


def _over_actions(apply):
    out = None
    for action, _ in ACTIONS:
        fk = ForeignKeySpec(("o_custkey",), "customer", ("c_custkey",), action, action, action)
        part = apply(fk)
        out = part if out is None else out.unionByName(part)
    return out


@query("propagate_delete", oracle("FK_CHILD FK_PARENT", _action_oracle(
    "o_custkey IN (SELECT c_custkey FROM FK_PARENT WHERE c_custkey % 4 = 3)", "NULL")))
def _propagate_delete(spark, sf_dir):
    child = frame(spark, sf_dir, "FK_CHILD")
    deletes = frame(spark, sf_dir, "FK_PARENT").filter("c_custkey % 4 = 3")
    return _over_actions(lambda fk: checks.propagate_delete(deletes, child, fk, ["o_orderkey"], {"o_custkey": 0}))


@query("propagate_update", oracle("FK_CHILD FK_PARENT", _action_oracle(
    "o_custkey IN (SELECT c_custkey FROM FK_PARENT WHERE c_custkey % 4 = 3)", "o_custkey + 1000000").replace(
        "'CASCADE' AS constraint_name, o_orderkey, 'D'", "'CASCADE' AS constraint_name, o_orderkey, 'U'")))
def _propagate_update(spark, sf_dir):
    child = frame(spark, sf_dir, "FK_CHILD")
    moved = frame(spark, sf_dir, "FK_PARENT").filter("c_custkey % 4 = 3")
    updates = moved.select(
        F.col("c_custkey").alias("old_c_custkey"), (F.col("c_custkey") + 1000000).alias("new_c_custkey")
    )
    return _over_actions(lambda fk: checks.propagate_update(updates, child, fk, ["o_orderkey"], {"o_custkey": 0}))


@query(
    "propagate_delete_cascade",
    """SELECT 'orders' AS "table", o_orderkey AS k1, 0 AS k2 FROM orders WHERE o_custkey % 50 = 7
    UNION ALL SELECT DISTINCT 'lines', l_orderkey, l_linenumber FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 7)""",
)
def _propagate_delete_cascade(spark, sf_dir):
    customer = TableSpec("customer", (), ("c_custkey",))
    orders = TableSpec("orders", (), ("o_orderkey",), foreign_keys=(
        ForeignKeySpec(("o_custkey",), "customer", ("c_custkey",), "o_c", "CASCADE"),))
    lines = TableSpec("lines", (), ("l_orderkey", "l_linenumber"), foreign_keys=(
        ForeignKeySpec(("l_orderkey",), "orders", ("o_orderkey",), "l_o", "CASCADE"),))
    tables = {"customer": table(spark, sf_dir, "customer"), "orders": table(spark, sf_dir, "orders"),
              "lines": table(spark, sf_dir, "lineitem")}
    seeds = {"customer": tables["customer"].filter("c_custkey % 50 = 7")}
    gone = checks.propagate_deletes(seeds, tables, {"customer": customer, "orders": orders, "lines": lines})
    return gone["orders"].select(
        F.lit("orders").alias("table"), F.col("o_orderkey").alias("k1"), F.lit(0).alias("k2")
    ).unionByName(
        gone["lines"].select(F.lit("lines").alias("table"), F.col("l_orderkey").alias("k1"),
                             F.col("l_linenumber").alias("k2"))
    )


FIXTURES["TURNS"] = "SELECT DISTINCT conv_id, turn, turn - 1 AS before FROM conversations"


@query(
    "delete_effects",
    oracle(
        "TURNS",
        """
        , LOCKED AS (SELECT DISTINCT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
            WHERE l_linenumber = 1 AND l_partkey % 40 = 1),
        ASKED AS (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 2),
        FREE AS (SELECT c_custkey FROM ASKED WHERE c_custkey NOT IN (SELECT o_custkey FROM LOCKED)),
        LOCKS AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 40 = 1)
        SELECT 'customer' AS "table", 'D' AS op, c_custkey AS k1, CAST(0 AS BIGINT) AS k2 FROM FREE
        UNION ALL SELECT 'customer', 'B', c_custkey, 0 FROM ASKED WHERE c_custkey IN (SELECT o_custkey FROM LOCKED)
        UNION ALL SELECT 'orders', 'D', o_orderkey, 0 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM FREE)
        UNION ALL SELECT 'orders', 'B', o_orderkey, 0 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM ASKED)
            AND o_custkey IN (SELECT o_custkey FROM LOCKED)
        UNION ALL SELECT 'events', 'U', event_id, 0 FROM events WHERE user_id IN (SELECT c_custkey FROM FREE)
        UNION ALL SELECT 'turns', 'D', conv_id, turn FROM TURNS WHERE turn >= 2""",
    ),
)
def _delete_effects(spark, sf_dir):
    """Customers take their orders along unless a locked line refers to one of these; events lose
    their user; a turn takes along the turns after it."""
    customer = TableSpec("customer", (), ("c_custkey",))
    orders = TableSpec("orders", (), ("o_orderkey",), foreign_keys=(
        ForeignKeySpec(("o_custkey",), "customer", ("c_custkey",), "o_c", "CASCADE"),))
    locks = TableSpec("locks", (), ("l_orderkey",), foreign_keys=(
        ForeignKeySpec(("l_orderkey",), "orders", ("o_orderkey",), "l_o", "RESTRICT"),))
    events = TableSpec("events", (), ("event_id",), foreign_keys=(
        ForeignKeySpec(("user_id",), "customer", ("c_custkey",), "e_c", "SET NULL"),))
    turns = TableSpec("turns", (), ("conv_id", "turn"), foreign_keys=(
        ForeignKeySpec(("conv_id", "before"), "turns", ("conv_id", "turn"), "t_t", "CASCADE"),))
    tables = {
        "customer": table(spark, sf_dir, "customer"), "orders": table(spark, sf_dir, "orders"),
        "locks": table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 AND l_partkey % 40 = 1").select("l_orderkey").distinct(),
        "events": table(spark, sf_dir, "events"), "turns": frame(spark, sf_dir, "TURNS"),
    }
    seeds = {"customer": tables["customer"].filter("c_custkey % 5 = 2"), "turns": tables["turns"].filter("turn = 2")}
    specs = {s.name: s for s in (customer, orders, locks, events, turns)}
    effects = checks.delete_effects(seeds, tables, specs)

    def shown(df, name, op, first, second=None):
        last = F.col(second) if second else F.lit(0)
        return df.select(F.lit(name).alias("table"), F.lit(op).alias("op"), F.col(first).cast("bigint").alias("k1"), last.cast("bigint").alias("k2"))

    parts = [
        shown(effects.deleted["customer"], "customer", "D", "c_custkey"),
        shown(effects.blocked["customer"], "customer", "B", "c_custkey"),
        shown(effects.deleted["orders"], "orders", "D", "o_orderkey"),
        shown(effects.blocked["orders"], "orders", "B", "o_orderkey"),
        shown(effects.updated["events"], "events", "U", "event_id"),
        shown(effects.deleted["turns"], "turns", "D", "conv_id", "turn"),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union
