"""Queries of the snapshot diff."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.functions.cells import TEXT, TYPED, cell_equal, tagged_cell_equal
from rowtide.operators import diff, options, setops
from rowtide.operators.sequences import number_as_ordered
from rowtide.plans.fixtures import FIXTURES, frame, oracle, table
from rowtide.plans.registry import query
from rowtide.session import cut_lineage
from rowtide.sources import sinks
from rowtide.spec import ForeignKeySpec, TableSpec

ORDER_KEY = ["o_orderkey"]
LINE_KEY = ["l_orderkey", "l_linenumber"]

# The line states are aggregates on their key, so it is unique, and their layout serves the join.
GROUPED = {"on_duplicate": "trust", "null_keys": False}
PRIMARY = {"null_keys": False}

# -- pieces of the oracles ----------------------------------------------------

ORDER_VALUES = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
CHANGED = "(" + " OR ".join(f"n.{c} IS DISTINCT FROM o.{c}" for c in ORDER_VALUES) + ")"
CHANGED_NAMES = (
    "concat_ws(',', " + ", ".join(f"CASE WHEN n.{c} IS DISTINCT FROM o.{c} THEN '{c}' END" for c in ORDER_VALUES) + ")"
)

ORDER_OPS = f"""
    SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey,
        CASE WHEN o.o_orderkey IS NULL THEN 'I' WHEN n.o_orderkey IS NULL THEN 'D' WHEN {CHANGED} THEN 'U' ELSE 'N' END
            AS op,
        CASE WHEN o.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL THEN {CHANGED_NAMES} ELSE '' END AS changed,
        o.o_custkey AS old_custkey, n.o_custkey AS new_custkey,
        o.o_orderstatus AS old_status, n.o_orderstatus AS new_status,
        o.o_orderpriority AS old_priority, n.o_orderpriority AS new_priority
    FROM ORD_OLD o FULL OUTER JOIN ORD_NEW n ON o.o_orderkey = n.o_orderkey
"""

LINE_OPS = """
    SELECT coalesce(n.l_orderkey, o.l_orderkey) AS l_orderkey, coalesce(n.l_linenumber, o.l_linenumber) AS l_linenumber,
        CASE WHEN o.l_orderkey IS NULL THEN 'I' WHEN n.l_orderkey IS NULL THEN 'D'
            WHEN n.l_partkey IS DISTINCT FROM o.l_partkey OR n.l_quantity IS DISTINCT FROM o.l_quantity
                OR n.l_returnflag IS DISTINCT FROM o.l_returnflag THEN 'U' ELSE 'N' END AS op,
        o.l_quantity AS old_quantity, n.l_quantity AS new_quantity
    FROM LI_OLD o FULL OUTER JOIN LI_NEW n ON o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber
"""


def order_states(spark, sf_dir):
    return frame(spark, sf_dir, "ORD_OLD"), frame(spark, sf_dir, "ORD_NEW")


def line_states(spark, sf_dir):
    return frame(spark, sf_dir, "LI_OLD"), frame(spark, sf_dir, "LI_NEW")


def flat_orders(changes):
    return changes.select(
        "key.o_orderkey",
        "op",
        F.array_join("changed", ",").alias("changed"),
        F.col("before.o_custkey").alias("old_custkey"),
        F.col("after.o_custkey").alias("new_custkey"),
        F.col("before.o_orderstatus").alias("old_status"),
        F.col("after.o_orderstatus").alias("new_status"),
        F.col("before.o_orderpriority").alias("old_priority"),
        F.col("after.o_orderpriority").alias("new_priority"),
    )


# -- presence and comparison --------------------------------------------------


@query(
    "rows_added",
    oracle(
        "ORD_OLD ORD_NEW",
        "SELECT * FROM ORD_NEW n WHERE NOT EXISTS (SELECT 1 FROM ORD_OLD o WHERE o.o_orderkey = n.o_orderkey)",
    ),
)
def _rows_added(spark, sf_dir):
    return diff.rows_added(*order_states(spark, sf_dir), ORDER_KEY)


@query(
    "rows_removed",
    oracle(
        "ORD_OLD ORD_NEW_T",
        "SELECT * FROM ORD_OLD o WHERE NOT EXISTS "
        "(SELECT 1 FROM ORD_NEW_T n WHERE o.o_orderkey = n.o_orderkey AND NOT n._delete)",
    ),
)
def _rows_removed(spark, sf_dir):
    return diff.rows_removed(frame(spark, sf_dir, "ORD_OLD"), frame(spark, sf_dir, "ORD_NEW_T"), ORDER_KEY)


@query(
    "rows_changed",
    oracle(
        "ORD_OLD ORD_NEW",
        f"SELECT n.* FROM ORD_NEW n JOIN ORD_OLD o ON o.o_orderkey = n.o_orderkey WHERE {CHANGED}",
    ),
)
def _rows_changed(spark, sf_dir):
    return diff.rows_changed(*order_states(spark, sf_dir), ORDER_KEY)


KIND = "CASE WHEN {0}.is_null THEN 'null' WHEN {0}.is_empty THEN 'empty' WHEN {0}.is_sql THEN 'sql' ELSE 'text' END"
PLAIN = "CASE WHEN NOT {0}.is_null THEN {0}.txt END"


@query(
    "cell_equal",
    oracle(
        "CELLS",
        f"""
        SELECT {KIND.format("o")} AS old_kind, {KIND.format("n")} AS new_kind,
            CASE WHEN o.is_null AND n.is_null THEN TRUE WHEN o.is_empty AND n.is_empty THEN TRUE
                WHEN o.is_sql <> n.is_sql THEN FALSE ELSE o.txt = n.txt END AS tagged,
            {PLAIN.format("o")} IS NOT DISTINCT FROM {PLAIN.format("n")} AS typed,
            coalesce({PLAIN.format("o")}, '') = coalesce({PLAIN.format("n")}, '') AS texts,
            count(*) AS n
        FROM CELLS o JOIN CELLS n ON n.c_custkey = o.c_custkey + CAST(floor(o.c_custkey / 5) AS BIGINT) % 5
        GROUP BY 1, 2, 3, 4, 5""",
    ),
)
def _cell_equal(spark, sf_dir):
    cells = frame(spark, sf_dir, "CELLS").select(
        "c_custkey",
        F.struct(
            F.col("is_null").alias("null"),
            F.col("is_empty").alias("empty"),
            F.col("is_sql").alias("sql"),
            F.col("txt").alias("text"),
        ).alias("cell"),
    )
    partner = F.col("c_custkey") + F.floor(F.col("c_custkey") / 5) % 5
    old = cells.select(partner.alias("partner"), F.col("cell").alias("old"))
    new = cells.select("c_custkey", F.col("cell").alias("new"))

    def kind(c):
        return F.when(c["null"], "null").when(c["empty"], "empty").when(c["sql"], "sql").otherwise("text")

    def plain(c):
        return F.when(~c["null"], c["text"])

    a, b = F.col("old"), F.col("new")
    return (
        old.join(new, F.col("partner") == F.col("c_custkey"))
        .groupBy(
            kind(a).alias("old_kind"),
            kind(b).alias("new_kind"),
            tagged_cell_equal(a, b).alias("tagged"),
            cell_equal(plain(a), plain(b), TYPED).alias("typed"),
            cell_equal(plain(a), plain(b), TEXT).alias("texts"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "row_equal",
    oracle(
        "ORD_OLD ORD_NEW_T",
        f"SELECT n.o_orderkey, NOT {CHANGED} AND NOT n._delete AS equal "
        "FROM ORD_NEW_T n JOIN ORD_OLD o ON o.o_orderkey = n.o_orderkey",
    ),
)
def _row_equal(spark, sf_dir):
    return diff.row_equal(frame(spark, sf_dir, "ORD_OLD"), frame(spark, sf_dir, "ORD_NEW_T"), ORDER_KEY)


@query(
    "changed_columns",
    oracle(
        "ORD_OLD ORD_NEW",
        f"""
        SELECT n.o_orderkey, {CHANGED_NAMES} AS changed,
            CASE WHEN n.o_custkey IS DISTINCT FROM o.o_custkey THEN n.o_custkey END AS o_custkey,
            CASE WHEN n.o_orderstatus IS DISTINCT FROM o.o_orderstatus THEN n.o_orderstatus END AS o_orderstatus,
            CASE WHEN n.o_orderpriority IS DISTINCT FROM o.o_orderpriority THEN n.o_orderpriority END
                AS o_orderpriority
        FROM ORD_NEW n JOIN ORD_OLD o ON o.o_orderkey = n.o_orderkey WHERE {CHANGED}""",
    ),
)
def _changed_columns(spark, sf_dir):
    return diff.changed_columns(*order_states(spark, sf_dir), ORDER_KEY).select(
        "o_orderkey", F.array_join("changed", ",").alias("changed"), "o_custkey", "o_orderstatus", "o_orderpriority"
    )


@query(
    "cell_changes",
    oracle(
        "ORD_OLD ORD_NEW",
        """
        SELECT o_orderkey, column_name, old_value, new_value FROM (
            SELECT n.o_orderkey, 'o_custkey' AS column_name, CAST(o.o_custkey AS VARCHAR) AS old_value,
                CAST(n.o_custkey AS VARCHAR) AS new_value
            FROM ORD_NEW n JOIN ORD_OLD o ON o.o_orderkey = n.o_orderkey
            UNION ALL SELECT n.o_orderkey, 'o_orderstatus', o.o_orderstatus, n.o_orderstatus
            FROM ORD_NEW n JOIN ORD_OLD o ON o.o_orderkey = n.o_orderkey
            UNION ALL SELECT n.o_orderkey, 'o_orderpriority', o.o_orderpriority, n.o_orderpriority
            FROM ORD_NEW n JOIN ORD_OLD o ON o.o_orderkey = n.o_orderkey) AS cells
        WHERE old_value IS DISTINCT FROM new_value""",
    ),
)
def _cell_changes(spark, sf_dir):
    return diff.cell_changes(*order_states(spark, sf_dir), ORDER_KEY)


# -- change sets --------------------------------------------------------------


@query("change_set", oracle("ORD_OLD ORD_NEW", f"SELECT * FROM ({ORDER_OPS}) AS c WHERE op <> 'N'"))
def _change_set(spark, sf_dir):
    return flat_orders(diff.change_set(*order_states(spark, sf_dir), ORDER_KEY))


@query("change_set_composite_key", oracle("LI_OLD LI_NEW", f"SELECT * FROM ({LINE_OPS}) AS c WHERE op <> 'N'"))
def _change_set_composite_key(spark, sf_dir):
    return diff.change_set(*line_states(spark, sf_dir), LINE_KEY, **GROUPED).select(
        "key.l_orderkey",
        "key.l_linenumber",
        "op",
        F.col("before.l_quantity").alias("old_quantity"),
        F.col("after.l_quantity").alias("new_quantity"),
    )


LINE_RAW = """
    SELECT l_orderkey, l_linenumber, count(*) AS copies, min(l_partkey) AS lo, max(l_partkey) AS hi,
        min(l_quantity) AS qlo, max(l_quantity) AS qhi
    FROM lineitem
    WHERE l_orderkey % 9 <> {0} GROUP BY l_orderkey, l_linenumber
"""


@query(
    "change_set_duplicate_keys",
    f"""
    SELECT coalesce(n.l_orderkey, o.l_orderkey) AS l_orderkey, coalesce(n.l_linenumber, o.l_linenumber) AS l_linenumber,
        CASE WHEN coalesce(o.copies, 0) > 1 OR coalesce(n.copies, 0) > 1 THEN 'X'
            WHEN o.copies IS NULL THEN 'I' WHEN n.copies IS NULL THEN 'D' ELSE 'N' END AS op,
        coalesce(o.copies, 0) AS old_copies, coalesce(n.copies, 0) AS new_copies
    FROM ({LINE_RAW.format(2)}) o FULL OUTER JOIN ({LINE_RAW.format(5)}) n
        ON o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber
    WHERE o.copies IS NULL OR n.copies IS NULL OR o.copies > 1 OR n.copies > 1""",
)
def _change_set_duplicate_keys(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    old, new = lines.filter("l_orderkey % 9 <> 2"), lines.filter("l_orderkey % 9 <> 5")
    return diff.change_set(old, new, LINE_KEY, on_duplicate="flag").select(
        "key.l_orderkey", "key.l_linenumber", "op", "old_copies", "new_copies"
    )


@query(
    "tombstones",
    oracle(
        "ORD_OLD ORD_NEW_T",
        f"""
        SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n._delete, FALSE) AS flagged,
            CASE WHEN n._delete AND o.o_orderkey IS NOT NULL THEN 'D' WHEN n._delete THEN 'N'
                WHEN o.o_orderkey IS NULL THEN 'I' WHEN n.o_orderkey IS NULL THEN 'D'
                WHEN {CHANGED} THEN 'U' ELSE 'N' END AS op
        FROM ORD_OLD o FULL OUTER JOIN ORD_NEW_T n ON o.o_orderkey = n.o_orderkey""",
    ),
)
def _tombstones(spark, sf_dir):
    return diff.tombstones(frame(spark, sf_dir, "ORD_OLD"), frame(spark, sf_dir, "ORD_NEW_T"), ORDER_KEY)


@query(
    "diff_column_renames",
    oracle(
        "ORD_OLD ORD_NEW_COLS",
        """
        SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey,
            CASE WHEN o.o_orderkey IS NULL THEN 'I' WHEN n.o_orderkey IS NULL THEN 'D' ELSE 'U' END AS op,
            CASE WHEN o.o_orderkey IS NULL OR n.o_orderkey IS NULL THEN '' ELSE concat_ws(',',
                CASE WHEN n.o_custkey IS DISTINCT FROM o.o_custkey THEN 'o_custkey' END,
                CASE WHEN n.o_priority IS DISTINCT FROM o.o_orderpriority THEN 'o_priority' END,
                CASE WHEN n.o_totalprice IS DISTINCT FROM o.o_totalprice THEN 'o_totalprice' END,
                'o_channel') END AS changed,
            n.o_priority, n.o_channel
        FROM ORD_OLD o FULL OUTER JOIN ORD_NEW_COLS n ON o.o_orderkey = n.o_orderkey""",
    ),
)
def _diff_column_renames(spark, sf_dir):
    old, new = frame(spark, sf_dir, "ORD_OLD"), frame(spark, sf_dir, "ORD_NEW_COLS")
    return diff.diff_column_renames(old, new, ORDER_KEY, {"o_orderpriority": "o_priority"}).select(
        "key.o_orderkey", "op", F.array_join("changed", ",").alias("changed"), "after.o_priority", "after.o_channel"
    )


@query(
    "diff_table_renames",
    oracle(
        "ORD_OLD ORD_NEW",
        """
        SELECT 'public.purchase' AS "table", op, o_orderkey, changed FROM (%s) AS c WHERE op <> 'N'""" % ORDER_OPS,
    ),
)
def _diff_table_renames(spark, sf_dir):
    old, new = order_states(spark, sf_dir)
    spec = TableSpec("purchase", (), ("o_orderkey",), old_name="orders", old_schema="archive")
    changes = diff.diff_table_renames({"archive.orders": old}, {"public.purchase": new}, {"public.purchase": spec})
    return changes.select(
        "table",
        "op",
        F.get_json_object("key", "$.o_orderkey").cast("bigint").alias("o_orderkey"),
        F.array_join("changed", ",").alias("changed"),
    )


@query(
    "diff_key_change",
    oracle(
        "LI_NEW",
        """
        , OLD_BY_ORDER AS (SELECT l_orderkey, max(l_quantity) AS l_quantity FROM lineitem
            WHERE l_orderkey % 9 <> 2 GROUP BY l_orderkey),
        NEW_BY_ORDER AS (SELECT l_orderkey, max(l_quantity) AS l_quantity, 'main' AS region FROM LI_NEW
            GROUP BY l_orderkey)
        SELECT coalesce(n.l_orderkey, o.l_orderkey) AS l_orderkey,
            CASE WHEN o.l_orderkey IS NULL THEN 'I' WHEN n.l_orderkey IS NULL THEN 'D' ELSE 'U' END AS op,
            CASE WHEN o.l_orderkey IS NULL OR n.l_orderkey IS NULL THEN ''
                WHEN n.l_quantity IS DISTINCT FROM o.l_quantity THEN 'l_quantity,region' ELSE 'region' END AS changed
        FROM OLD_BY_ORDER o FULL OUTER JOIN NEW_BY_ORDER n ON o.l_orderkey = n.l_orderkey""",
    ),
)
def _diff_key_change(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 9 <> 2")
    old = lines.groupBy("l_orderkey").agg(F.max("l_quantity").alias("l_quantity"))
    new = (
        frame(spark, sf_dir, "LI_NEW")
        .groupBy("l_orderkey")
        .agg(F.max("l_quantity").alias("l_quantity"))
        .withColumn("region", F.lit("main"))
    )
    return diff.diff_key_change(old, new, ["region", "l_orderkey"]).select(
        "key.l_orderkey", "op", F.array_join("changed", ",").alias("changed")
    )


STATE_SPECS = {
    "public.customer": TableSpec("customer", (), ("c_custkey",)),
    "public.orders": TableSpec("orders", (), ("o_orderkey",)),
    "public.lines": TableSpec("lines", (), ("l_orderkey", "l_linenumber")),
    "public.supplier": TableSpec("supplier", (), ("s_suppkey",)),
}
STATE_RANKS = {"public.customer": 0, "public.supplier": 0, "public.orders": 1, "public.lines": 2}


def many_changes(spark, sf_dir):
    """Two states of four tables: one only in old, one only in new."""
    orders_old, orders_new = order_states(spark, sf_dir)
    lines_old, lines_new = line_states(spark, sf_dir)
    old = {
        "public.orders": orders_old,
        "public.lines": lines_old,
        "public.supplier": table(spark, sf_dir, "supplier"),
    }
    new = {"public.customer": table(spark, sf_dir, "customer"), "public.orders": orders_new, "public.lines": lines_new}
    return diff.diff_many_tables(
        old, new, STATE_SPECS, ranks=STATE_RANKS, table_options={"public.lines": GROUPED, "public.orders": PRIMARY}
    )


MANY = f"""
    SELECT 'public.orders' AS "table", op, o_orderkey AS k1, 0 AS k2, 1 AS dep_rank, changed
    FROM ({ORDER_OPS}) AS c WHERE op <> 'N'
    UNION ALL SELECT 'public.lines', op, l_orderkey, l_linenumber, 2, CASE WHEN op = 'U' THEN 'l_quantity' ELSE '' END
    FROM ({LINE_OPS}) AS c WHERE op <> 'N'
    UNION ALL SELECT 'public.supplier', 'D', s_suppkey, 0, 0, '' FROM supplier
    UNION ALL SELECT 'public.customer', 'I', c_custkey, 0, 0, '' FROM customer
"""

def flat_key(changes):
    """JSON keys of the four tables as two plain columns."""
    kind = "o_orderkey bigint, l_orderkey bigint, s_suppkey bigint, c_custkey bigint, l_linenumber int"
    key = F.from_json("key", kind)
    one = F.coalesce(key["o_orderkey"], key["l_orderkey"], key["s_suppkey"], key["c_custkey"])
    return changes.withColumn("key", F.struct(one.alias("k1"), F.coalesce(key["l_linenumber"], F.lit(0)).alias("k2")))


@query(
    "diff_many_tables",
    oracle(
        "ORD_OLD ORD_NEW LI_OLD LI_NEW",
        f"""SELECT "table", CASE WHEN op = 'D' THEN 2 ELSE 4 END AS stage, dep_rank, op, k1, k2, changed
        FROM ({MANY}) AS m""",
    ),
)
def _diff_many_tables(spark, sf_dir):
    return flat_key(many_changes(spark, sf_dir)).select(
        "table", "stage", "dep_rank", "op", "key.k1", "key.k2", F.array_join("changed", ",").alias("changed")
    )


@query(
    "ordered_change_set",
    oracle(
        "ORD_OLD ORD_NEW LI_OLD LI_NEW",
        f"""SELECT row_number() OVER (ORDER BY CASE WHEN op = 'D' THEN 2 ELSE 4 END,
                CASE WHEN op = 'D' THEN -dep_rank ELSE dep_rank END, "table",
                CASE op WHEN 'D' THEN 0 WHEN 'U' THEN 1 ELSE 2 END, k1, k2) AS position,
            "table", op, k1, k2
        FROM ({MANY}) AS m""",
    ),
)
def _ordered_change_set(spark, sf_dir):
    ordered = diff.ordered_change_set(many_changes(spark, sf_dir))
    # The rows as they come out of the operator, numbered where they stand.
    return flat_key(number_as_ordered(ordered, "position")).select("position", "table", "op", "key.k1", "key.k2")


# -- an upgrade of several tables, from diff to statements and applied state ----

# A key part and values that may be NULL.
FIXTURES["UP_LINES_OLD"] = """
    SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS l_linenumber,
        CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE max(l_returnflag) END AS flag
    FROM lineitem
    WHERE l_orderkey % 9 <> 2
    GROUP BY l_orderkey, l_linenumber
"""
FIXTURES["UP_LINES_NEW"] = """
    SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber END AS l_linenumber,
        CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE max(l_returnflag) END AS flag
    FROM lineitem
    WHERE l_orderkey % 9 <> 5
    GROUP BY l_orderkey, l_linenumber
"""
FIXTURES["UP_ORDERS_OLD"] = "SELECT o_orderkey, o_custkey, o_orderstatus AS st FROM orders WHERE o_orderkey % 10 <> 3"
FIXTURES["UP_ORDERS_NEW"] = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS st
    FROM orders WHERE o_orderkey % 10 <> 4
"""
FIXTURES["UP_CUSTOMER"] = "SELECT c_custkey, c_nationkey FROM customer"
FIXTURES["UP_SUPPLIER"] = "SELECT s_suppkey, s_nationkey FROM supplier"

# Named so that the order of names is not that of the foreign keys.
UP_SPECS = {
    "public.a_lines": TableSpec("a_lines", (), ("l_orderkey", "l_linenumber"), foreign_keys=(
        ForeignKeySpec(("l_orderkey",), "b_orders", ("o_orderkey",), "l_o"),)),
    "public.b_orders": TableSpec("b_orders", (), ("o_orderkey",), foreign_keys=(
        ForeignKeySpec(("o_custkey",), "public.c_customer", ("c_custkey",), "o_c"),)),
    "public.c_customer": TableSpec("c_customer", (), ("c_custkey",)),
    "public.d_supplier": TableSpec("d_supplier", (), ("s_suppkey",)),
}


def upgrade_states(spark, sf_dir):
    """Two states of four tables; customers are new, suppliers go away."""
    old = {"public.a_lines": "UP_LINES_OLD", "public.b_orders": "UP_ORDERS_OLD", "public.d_supplier": "UP_SUPPLIER"}
    new = {"public.a_lines": "UP_LINES_NEW", "public.b_orders": "UP_ORDERS_NEW", "public.c_customer": "UP_CUSTOMER"}
    return tuple({name: frame(spark, sf_dir, fixture) for name, fixture in side.items()} for side in (old, new))


@query(
    "upgrade_statements",
    oracle(
        "UP_LINES_OLD UP_LINES_NEW UP_ORDERS_OLD UP_ORDERS_NEW",
        """
        , STEPS AS (
            SELECT 2 AS stage, 0 AS rank, 'public.d_supplier' AS "table", 0 AS op_rank, s_suppkey AS k1, 0 AS k2,
                'DELETE FROM public.d_supplier' || chr(10) || 'WHERE s_suppkey = ' || s_suppkey || ';' AS sql FROM supplier
            UNION ALL SELECT 4, 0, 'public.c_customer', 2, c_custkey, 0,
                'INSERT INTO public.c_customer (c_custkey, c_nationkey) VALUES (' || c_custkey || ', ' || c_nationkey || ');'
            FROM customer
            UNION ALL SELECT CASE WHEN n.o_orderkey IS NULL THEN 2 ELSE 4 END, CASE WHEN n.o_orderkey IS NULL THEN -1 ELSE 1 END,
                'public.b_orders', CASE WHEN n.o_orderkey IS NULL THEN 0 WHEN o.o_orderkey IS NULL THEN 2 ELSE 1 END,
                coalesce(n.o_orderkey, o.o_orderkey), 0,
                CASE WHEN n.o_orderkey IS NULL THEN 'DELETE FROM public.b_orders' || chr(10) || 'WHERE o_orderkey = ' || o.o_orderkey || ';'
                    WHEN o.o_orderkey IS NULL THEN 'INSERT INTO public.b_orders (o_orderkey, o_custkey, st) VALUES (' || n.o_orderkey
                        || ', ' || n.o_custkey || ', ' || coalesce('''' || n.st || '''', 'NULL') || ');'
                    ELSE 'UPDATE public.b_orders' || chr(10) || 'SET ' || concat_ws(',' || chr(10) || '    ',
                        CASE WHEN n.o_custkey <> o.o_custkey THEN 'o_custkey = ' || n.o_custkey END,
                        CASE WHEN n.st IS DISTINCT FROM o.st THEN 'st = ' || coalesce('''' || n.st || '''', 'NULL') END)
                        || chr(10) || 'WHERE o_orderkey = ' || n.o_orderkey || ';' END
            FROM UP_ORDERS_OLD o FULL OUTER JOIN UP_ORDERS_NEW n ON o.o_orderkey = n.o_orderkey
            WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR n.o_custkey <> o.o_custkey OR n.st IS DISTINCT FROM o.st
            UNION ALL SELECT CASE WHEN n.l_orderkey IS NULL THEN 2 ELSE 4 END, CASE WHEN n.l_orderkey IS NULL THEN -2 ELSE 2 END,
                'public.a_lines', CASE WHEN n.l_orderkey IS NULL THEN 0 WHEN o.l_orderkey IS NULL THEN 2 ELSE 1 END,
                coalesce(n.l_orderkey, o.l_orderkey), coalesce(n.l_linenumber, o.l_linenumber, 0),
                CASE WHEN n.l_orderkey IS NULL THEN 'DELETE FROM public.a_lines' || chr(10) || 'WHERE l_orderkey = ' || o.l_orderkey
                        || '  AND l_linenumber' || coalesce(' = ' || o.l_linenumber, ' IS NULL') || ';'
                    WHEN o.l_orderkey IS NULL THEN 'INSERT INTO public.a_lines (l_orderkey, l_linenumber, flag) VALUES (' || n.l_orderkey
                        || ', ' || coalesce(CAST(n.l_linenumber AS VARCHAR), 'NULL') || ', ' || coalesce('''' || n.flag || '''', 'NULL') || ');'
                    ELSE 'UPDATE public.a_lines' || chr(10) || 'SET flag = ' || coalesce('''' || n.flag || '''', 'NULL') || chr(10)
                        || 'WHERE l_orderkey = ' || n.l_orderkey || '  AND' || chr(10) || '  l_linenumber'
                        || coalesce(' = ' || n.l_linenumber, ' IS NULL') || ';' END
            FROM UP_LINES_OLD o FULL OUTER JOIN UP_LINES_NEW n
                ON o.l_orderkey = n.l_orderkey AND o.l_linenumber IS NOT DISTINCT FROM n.l_linenumber
            WHERE o.l_orderkey IS NULL OR n.l_orderkey IS NULL OR n.flag IS DISTINCT FROM o.flag)
        SELECT row_number() OVER (ORDER BY stage, rank, "table", op_rank, k1, k2) AS position, "table", sql FROM STEPS""",
    ),
)
def _upgrade_statements(spark, sf_dir):
    old, new = upgrade_states(spark, sf_dir)
    statements = sinks.render_many_sql(diff.diff_many_tables(old, new, UP_SPECS), UP_SPECS, old, new)
    return number_as_ordered(diff.ordered_change_set(statements), "position").select("position", "table", "sql")


@query(
    "upgrade_round_trip",
    oracle(
        "UP_LINES_NEW UP_ORDERS_NEW UP_CUSTOMER",
        """SELECT 'public.a_lines' AS "table", count(*) AS n, CAST(0 AS BIGINT) AS wrong_rows FROM UP_LINES_NEW
        UNION ALL SELECT 'public.b_orders', count(*), 0 FROM UP_ORDERS_NEW
        UNION ALL SELECT 'public.c_customer', count(*), 0 FROM UP_CUSTOMER""",
    ),
)
def _upgrade_round_trip(spark, sf_dir):
    old, new = upgrade_states(spark, sf_dir)
    changes = cut_lineage(diff.diff_many_tables(old, new, UP_SPECS))
    parts = []
    for name, state in diff.apply_many(old, changes, UP_SPECS, new).items():
        gap = diff.multiset_gap(new[name], state.select(*new[name].columns))
        wrong = gap.agg(F.coalesce(F.sum(F.abs("surplus")), F.lit(0).cast("bigint")).alias("wrong_rows"))
        parts.append(state.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n", wrong.scalar().alias("wrong_rows")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "diff_summary",
    oracle(
        "ORD_OLD ORD_NEW LI_OLD LI_NEW",
        f"""
        SELECT coalesce("table", '*') AS "table", coalesce(op, '*') AS op, count(*) AS n FROM (
            SELECT 'orders' AS "table", op FROM ({ORDER_OPS}) AS a
            UNION ALL SELECT 'lines', op FROM ({LINE_OPS}) AS b) AS c
        GROUP BY ROLLUP ("table", op)""",
    ),
)
def _diff_summary(spark, sf_dir):
    orders = diff.change_set(*order_states(spark, sf_dir), ORDER_KEY, table="orders", keep_unchanged=True)
    lines = diff.change_set(*line_states(spark, sf_dir), LINE_KEY, table="lines", keep_unchanged=True, **GROUPED)
    return diff.diff_summary(orders.select("table", "op").unionByName(lines.select("table", "op")))


@query(
    "diff_summary_columns",
    oracle(
        "ORD_OLD ORD_NEW",
        "SELECT 'orders' AS \"table\", column_name, count(*) AS n FROM ("
        f"SELECT unnest(string_split(changed, ',')) AS column_name FROM ({ORDER_OPS}) AS c WHERE op = 'U') AS u "
        "GROUP BY column_name",
    ),
)
def _diff_summary_columns(spark, sf_dir):
    changes = diff.change_set(*order_states(spark, sf_dir), ORDER_KEY, table="orders")
    return diff.diff_summary(changes, per_column=True)


@query("apply_change_set", oracle("ORD_NEW", "SELECT * FROM ORD_NEW"))
def _apply_change_set(spark, sf_dir):
    old, new = order_states(spark, sf_dir)
    # Written first, as the application reads the changes twice.
    return diff.apply_change_set(old, cut_lineage(diff.change_set(old, new, ORDER_KEY)), ORDER_KEY)


@query(
    "round_trip_check",
    oracle(
        "ORD_NEW",
        """SELECT CAST(count(*) AS BIGINT) AS missing_rows, CAST(count(*) AS BIGINT) AS unexpected_rows
        FROM (SELECT * FROM ORD_NEW EXCEPT ALL SELECT * FROM ORD_NEW) AS e""",
    ),
)
def _round_trip_check(spark, sf_dir):
    return diff.round_trip_check(*order_states(spark, sf_dir), ORDER_KEY)


@query(
    "reverse_change_set",
    oracle(
        "ORD_OLD ORD_NEW",
        f"""SELECT o_orderkey, CASE op WHEN 'I' THEN 'D' WHEN 'D' THEN 'I' ELSE op END AS op, changed,
            new_custkey AS old_custkey, old_custkey AS new_custkey, new_status AS old_status,
            old_status AS new_status, new_priority AS old_priority, old_priority AS new_priority
        FROM ({ORDER_OPS}) AS c WHERE op <> 'N'""",
    ),
)
def _reverse_change_set(spark, sf_dir):
    return flat_orders(diff.reverse_change_set(diff.change_set(*order_states(spark, sf_dir), ORDER_KEY)))


@query(
    "fresh_rows",
    oracle(
        "ORD_NEW_T",
        """SELECT 4 AS stage, 1 AS dep_rank, 'I' AS op, o_orderkey, o_custkey, o_orderstatus, o_totalprice
        FROM ORD_NEW_T WHERE NOT _delete
        UNION ALL SELECT 4, 0, 'I', c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer""",
    ),
)
def _fresh_rows(spark, sf_dir):
    orders = diff.fresh_rows(frame(spark, sf_dir, "ORD_NEW_T"), ORDER_KEY, table="orders", dep_rank=1)
    customers = diff.fresh_rows(table(spark, sf_dir, "customer"), ["c_custkey"], table="customer", dep_rank=0)
    return orders.select(
        "stage", "dep_rank", "op", "key.o_orderkey", "after.o_custkey", "after.o_orderstatus", "after.o_totalprice"
    ).unionByName(
        customers.select(
            "stage",
            "dep_rank",
            "op",
            F.col("key.c_custkey").alias("o_orderkey"),
            F.col("after.c_nationkey").cast("bigint").alias("o_custkey"),
            F.col("after.c_mktsegment").alias("o_orderstatus"),
            F.col("after.c_acctbal").alias("o_totalprice"),
        )
    )


# -- set operations and options -----------------------------------------------

FIXTURES["NAMES_LEFT"] = """
    SELECT CASE WHEN event_id % 3 = 0 THEN upper(concat(event_type, CAST(user_id AS VARCHAR(20))))
        ELSE concat(event_type, CAST(user_id AS VARCHAR(20))) END AS name
    FROM events WHERE user_id % 3 <> 0
"""
FIXTURES["NAMES_RIGHT"] = """
    SELECT CASE WHEN event_id % 2 = 0 THEN upper(concat(event_type, CAST(user_id AS VARCHAR(20))))
        ELSE concat(event_type, CAST(user_id AS VARCHAR(20))) END AS name
    FROM events WHERE user_id % 3 <> 1
"""


def name_lists(spark, sf_dir):
    return frame(spark, sf_dir, "NAMES_LEFT"), frame(spark, sf_dir, "NAMES_RIGHT")


@query(
    "set_union_ci",
    oracle(
        "NAMES_LEFT NAMES_RIGHT",
        """SELECT name AS value, count(*) AS copies FROM NAMES_LEFT GROUP BY name
        UNION ALL SELECT min(name), 1 FROM NAMES_RIGHT
        WHERE lower(name) NOT IN (SELECT lower(name) FROM NAMES_LEFT) GROUP BY lower(name)""",
    ),
)
def _set_union_ci(spark, sf_dir):
    return setops.set_union_ci(*name_lists(spark, sf_dir), "name")


@query(
    "set_intersect_ci",
    oracle(
        "NAMES_LEFT NAMES_RIGHT",
        """SELECT l.name AS value, count(*) AS copies FROM NAMES_LEFT l
        JOIN NAMES_RIGHT r ON lower(l.name) = lower(r.name) GROUP BY l.name""",
    ),
)
def _set_intersect_ci(spark, sf_dir):
    return setops.set_intersect_ci(*name_lists(spark, sf_dir), "name")


@query(
    "set_difference_ci",
    oracle(
        "NAMES_LEFT NAMES_RIGHT",
        """SELECT name AS value, count(*) AS copies FROM NAMES_LEFT
        WHERE lower(name) NOT IN (SELECT lower(name) FROM NAMES_RIGHT) GROUP BY name""",
    ),
)
def _set_difference_ci(spark, sf_dir):
    return setops.set_difference_ci(*name_lists(spark, sf_dir), "name")


OPTION_ROWS = """
    SELECT owner, lower(string_split(item, '=')[1]) AS option, coalesce(string_split(item, '=')[2], '') AS value
    FROM (SELECT owner, unnest(string_split(trim(opts, '()'), ',')) AS item FROM {0}) AS i
"""


@query(
    "options_diff",
    oracle(
        "OPTIONS_OLD OPTIONS_NEW",
        f"""
        SELECT * FROM (
            SELECT coalesce(n.owner, o.owner) AS owner, coalesce(n.option, o.option) AS option,
                CASE WHEN o.owner IS NULL THEN 'create' WHEN n.owner IS NULL THEN 'delete'
                    WHEN lower(o.value) <> lower(n.value) THEN 'update' END AS action,
                o.value AS old_value, n.value AS new_value
            FROM ({OPTION_ROWS.format("OPTIONS_OLD")}) o
            FULL OUTER JOIN ({OPTION_ROWS.format("OPTIONS_NEW")}) n ON o.owner = n.owner AND o.option = n.option
        ) AS d WHERE action IS NOT NULL""",
    ),
)
def _options_diff(spark, sf_dir):
    return options.options_diff(frame(spark, sf_dir, "OPTIONS_OLD"), frame(spark, sf_dir, "OPTIONS_NEW"), ["owner"], "opts")
