"""Queries of schema evolution, partitioning, inheritance and sequences."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from rowtide.operators import evolve, inheritance, partitions, sequences
from rowtide.plans.check_queries import INT_TEXT
from rowtide.plans.fixtures import FIXTURES, frame, oracle, table
from rowtide.plans.registry import query
from rowtide.session import scratch_path
from rowtide.spec import CheckSpec, ColumnSpec, DomainSpec, EnumSpec, PartitionSpec, SequenceSpec, TableSpec

RUN_TS = datetime.datetime(2024, 3, 1, 12, 30, 0)

ORDERS_V1 = TableSpec(
    "orders",
    (
        ColumnSpec("o_orderkey", "bigserial", False),
        ColumnSpec("o_custkey", "bigint"),
        ColumnSpec("o_orderstatus", "varchar(1)"),
        ColumnSpec("o_totalprice", "double precision"),
        ColumnSpec("o_orderdate", "timestamp"),
        ColumnSpec("o_orderpriority", "text"),
    ),
    ("o_orderkey",),
)
ORDERS_V2 = TableSpec(
    "orders",
    (
        ColumnSpec("o_orderkey", "bigint", False),
        ColumnSpec("o_custkey", "bigint"),
        ColumnSpec("o_orderstatus", "varchar(1)", False, "'?'"),
        ColumnSpec("o_priority", "int", old_name="o_orderpriority", using="substr(o_orderpriority, 1, 1)"),
        ColumnSpec("o_cents", "bigint", default="0"),
        ColumnSpec("o_channel", "text", False, "'web'"),
        ColumnSpec("o_loaded", "timestamp", default="now()"),
        ColumnSpec("o_note", "text"),
    ),
    ("o_orderkey",),
)


@query(
    "add_nullable_column",
    "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_note, 5 AS c_rank FROM customer",
)
def _add_nullable_column(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    df = evolve.add_nullable_column(df, ColumnSpec("c_note", "text"))
    return evolve.add_nullable_column(df, ColumnSpec("c_rank", "int", default="5"))


@query("add_column_default", "SELECT c_custkey, c_name, 'new' AS c_state FROM customer")
def _add_column_default(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return evolve.add_column_default(df, ColumnSpec("c_state", "text", False, "'new'"))


@query("add_column_now", "SELECT c_custkey, TIMESTAMP '2024-03-01 12:30:00' AS c_since FROM customer")
def _add_column_now(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey")
    return evolve.add_column_now(df, ColumnSpec("c_since", "timestamp", False, "now()"), RUN_TS)


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def _drop_columns(spark, sf_dir):
    return evolve.drop_columns(table(spark, sf_dir, "orders"), ORDERS_V1, ORDERS_V2)


@query(
    "rename_columns",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority AS o_priority FROM orders",
)
def _rename_columns(spark, sf_dir):
    return evolve.rename_columns(table(spark, sf_dir, "orders"), ORDERS_V1, ORDERS_V2)


@query(
    "change_column_type",
    oracle(
        "DOMAIN",
        """SELECT c_custkey, TRY_CAST(int_text AS INTEGER) AS int_text,
            int_text IS NOT NULL AND TRY_CAST(int_text AS INTEGER) IS NULL AS failed FROM DOMAIN""",
    ),
)
def _change_column_type(spark, sf_dir):
    df, column = frame(spark, sf_dir, "DOMAIN").select("c_custkey", "int_text"), ColumnSpec("int_text", "int")
    failed = F.col("int_text").isNotNull() & evolve.converted(column, F.col("int_text")).isNull()
    return evolve.change_column_type(df.withColumn("failed", failed), column)


@query(
    "set_not_null",
    oracle("DOMAIN", "SELECT c_custkey, coalesce(segment, 'NONE') AS segment FROM DOMAIN"),
)
def _set_not_null(spark, sf_dir):
    df = frame(spark, sf_dir, "DOMAIN").select("c_custkey", "segment")
    return evolve.set_not_null(df, ColumnSpec("segment", "text", False, "'NONE'"))


@query("serial_to_int", "SELECT o_orderkey, o_custkey FROM orders")
def _serial_to_int(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return evolve.serial_to_int(df, ORDERS_V1.column("o_orderkey"), ORDERS_V2.column("o_orderkey"))


@query(
    "migrate_enum",
    oracle(
        "DOMAIN",
        """SELECT segment, count(*) AS n, CAST(sum(CASE WHEN segment NOT IN ('BUILDING', 'MACHINERY', 'OTHER') THEN 1
            ELSE 0 END) AS BIGINT) AS lost FROM DOMAIN WHERE segment IS NOT NULL GROUP BY segment""",
    ),
)
def _migrate_enum(spark, sf_dir):
    new = EnumSpec("segment_enum", ("BUILDING", "MACHINERY", "OTHER"))
    rows, lost = evolve.migrate_enum(frame(spark, sf_dir, "DOMAIN").select("segment"), "segment", new)
    counted = rows.filter(F.col("segment").isNotNull()).select("segment", F.lit(0).alias("lost"), F.lit(1).alias("n"))
    both = counted.unionByName(lost.select("segment", F.lit(1).alias("lost"), F.lit(0).alias("n")))
    return both.groupBy("segment").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))


@query(
    "migrate_domain",
    oracle(
        "DOMAIN",
        """SELECT c_custkey, 'even' AS violation FROM DOMAIN WHERE TRY_CAST(int_text AS BIGINT) % 2000000 <> 0
        UNION ALL SELECT c_custkey, 'small' FROM DOMAIN
        WHERE TRY_CAST(int_text AS INTEGER) IS NULL AND TRY_CAST(int_text AS BIGINT) >= 2500000000""",
    ),
)
def _migrate_domain(spark, sf_dir):
    new = DomainSpec(
        "int_domain", "bigint", False, "0",
        (CheckSpec("small", "VALUE < 2500000000"), CheckSpec("even", "CHECK (VALUE % 2000000 = 0)")),
    )
    df = frame(spark, sf_dir, "DOMAIN").select("c_custkey", "int_text")
    return evolve.migrate_domain(df, "int_text", INT_TEXT, new).select("c_custkey", "violation")


@query(
    "evolve_table",
    """SELECT o_orderkey, o_custkey, coalesce(CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END, '?')
            AS o_orderstatus,
        CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS o_priority, CAST(0 AS BIGINT) AS o_cents,
        concat('web-', o_orderstatus) AS o_channel, TIMESTAMP '2024-03-01 12:30:00' AS o_loaded,
        CAST(NULL AS VARCHAR) AS o_note FROM orders WHERE o_custkey IS NOT NULL""",
)
def _evolve_table(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("source_status", F.col("o_orderstatus")).withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderstatus"))
    )
    hooks = {
        "before_stage1": lambda df: df.filter(F.col("o_custkey").isNotNull()),
        # Fills the new column from one that stage 3 drops.
        "after_stage1": lambda df: df.withColumn("o_channel", F.concat_ws("-", "o_channel", "source_status")),
    }
    return evolve.evolve_table(orders, ORDERS_V1, ORDERS_V2, hooks=hooks, run_ts=RUN_TS)


FIXTURES["TAB_OLD"] = """
    SELECT db, n_name AS table_name, CASE WHEN n_nationkey % 3 = 0 THEN 'modulo' END AS part_type,
        CASE WHEN n_nationkey % 3 = 0 THEN 'id' END AS part_column, CASE WHEN n_nationkey % 3 = 0 THEN 8 END AS part_count,
        CASE WHEN n_nationkey % 5 = 0 THEN 'parent' END AS inherits
    FROM ({0}) AS g
""".format(FIXTURES["GRID"])
FIXTURES["TAB_NEW"] = """
    SELECT db, lower(n_name) AS table_name,
        CASE WHEN n_nationkey % 3 = 0 AND (db + n_nationkey) % 7 <> 0 THEN 'MODULO' END AS part_type,
        CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN db % 4 = 0 THEN 'region' ELSE 'ID' END END AS part_column,
        CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN db % 6 = 0 THEN 16 ELSE 8 END END AS part_count,
        CASE WHEN n_nationkey % 5 = 0 AND db % 8 <> 0 THEN 'parent' END AS inherits,
        CASE WHEN n_nationkey % 9 = 0 AND db % 2 = 0 THEN 'former' END AS old_table_name
    FROM ({0}) AS g
    WHERE (db + n_nationkey) % 13 <> 0
""".format(FIXTURES["GRID"])

GUARD_PAIRS = """
    SELECT o.db, lower(o.table_name) AS table_name, o.part_type AS ot, n.part_type AS nt, o.part_column AS oc,
        n.part_column AS nc, o.part_count AS op, n.part_count AS np, o.inherits AS oi, n.inherits AS ni, n.old_table_name
    FROM TAB_OLD o JOIN TAB_NEW n ON o.db = n.db AND lower(o.table_name) = lower(n.table_name)
"""


@query(
    "evolution_guards",
    oracle(
        "TAB_OLD TAB_NEW CAT_OLD CAT_NEW",
        f"""
        SELECT db, table_name, NULL AS column_name, 'partition status changed' AS violation FROM ({GUARD_PAIRS}) AS p
        WHERE (ot IS NULL) <> (nt IS NULL)
        UNION ALL SELECT db, table_name, NULL, 'partitioned table renamed' FROM ({GUARD_PAIRS}) AS p
        WHERE ot IS NOT NULL AND nt IS NOT NULL AND old_table_name IS NOT NULL
        UNION ALL SELECT db, table_name, NULL, 'partition column changed' FROM ({GUARD_PAIRS}) AS p
        WHERE ot IS NOT NULL AND nt IS NOT NULL AND lower(oc) <> lower(nc)
        UNION ALL SELECT db, table_name, NULL, 'partition count changed' FROM ({GUARD_PAIRS}) AS p
        WHERE ot IS NOT NULL AND nt IS NOT NULL AND op <> np
        UNION ALL SELECT db, table_name, NULL, 'inheritance changed' FROM ({GUARD_PAIRS}) AS p
        WHERE (oi IS NULL) <> (ni IS NULL)
        UNION ALL SELECT o.db, lower(o.table_name), lower(o.column_name), 'type changed to serial'
        FROM CAT_NEW o JOIN CAT_OLD n ON o.db = n.db AND lower(o.table_name) = lower(n.table_name)
            AND lower(o.column_name) = lower(n.column_name)
        WHERE o.data_type <> 'serial' AND n.data_type = 'serial'""",
    ),
)
def _evolution_guards(spark, sf_dir):
    # The column catalogs go in reverse, as only that direction turns types into serial.
    return evolve.evolution_guards(
        frame(spark, sf_dir, "TAB_OLD"),
        frame(spark, sf_dir, "TAB_NEW"),
        frame(spark, sf_dir, "CAT_NEW"),
        frame(spark, sf_dir, "CAT_OLD"),
        ["db"],
    )


# -- partitioning -------------------------------------------------------------


def _part(n: int) -> str:
    return (
        f"CASE WHEN k IS NULL THEN 'unroutable' ELSE concat('partition_', "
        f"lpad(CAST(((k % {n}) + {n}) % {n} AS VARCHAR), {len(str(n))}, '0')) END"
    )


@query("modulo_partition", oracle("PARTS", f"SELECT o_orderkey, k, {_part(12)} AS part, {_part(8)} AS part8 FROM PARTS"))
def _modulo_partition(spark, sf_dir):
    routed = partitions.modulo_partition(frame(spark, sf_dir, "PARTS"), PartitionSpec("k", 12))
    return partitions.modulo_partition(routed, PartitionSpec("k", 8), "part8")


@query(
    "partition_counts",
    oracle(
        "PARTS",
        f"""SELECT part, count(*) AS n, CASE WHEN part <> 'unroutable' THEN
            round(count(*) * 12 / (SELECT count(*) FROM PARTS WHERE k IS NOT NULL), 6) END AS skew
        FROM (SELECT {_part(12)} AS part FROM PARTS) AS p GROUP BY part""",
    ),
)
def _partition_counts(spark, sf_dir):
    return partitions.partition_counts(frame(spark, sf_dir, "PARTS"), PartitionSpec("k", 12))


@query("write_partitioned", oracle("PARTS", f"SELECT o_orderkey, k, {_part(8)} AS part FROM PARTS WHERE k = 11"))
def _write_partitioned(spark, sf_dir):
    spec, path = PartitionSpec("k", 8), scratch_path(spark, "partitioned")
    partitions.write_partitioned(frame(spark, sf_dir, "PARTS"), spec, path)
    return partitions.read_partition(spark, path, spec, 11)


# -- inheritance --------------------------------------------------------------


@query(
    "inheritance_scan",
    """SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_nationkey AS nationkey FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey FROM supplier
    UNION ALL SELECT 'nation', n_nationkey, n_name, n_nationkey FROM nation""",
)
def _inheritance_scan(spark, sf_dir):
    parent = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_nationkey AS nationkey")
    suppliers = table(spark, sf_dir, "supplier").selectExpr(
        "s_acctbal", "s_name AS NAME", "s_suppkey AS id", "s_nationkey AS nationkey"
    )
    nations = table(spark, sf_dir, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS id", "n_name AS name", "n_nationkey AS nationkey"
    )
    return inheritance.inheritance_scan(parent, {"supplier": suppliers, "nation": nations}, "customer")


@query(
    "inherited_columns",
    oracle(
        "OWN_COLUMNS TABLE_PARENTS",
        """
        SELECT conv_id, turn, column_name, data_type, defined_in, depth FROM (
            SELECT t.conv_id, t.turn, c.column_name, c.data_type, c.turn AS defined_in, CAST(t.turn - c.turn AS INTEGER) AS depth,
                row_number() OVER (PARTITION BY t.conv_id, t.turn, lower(c.column_name) ORDER BY c.turn DESC) AS rn
            FROM TABLE_PARENTS t JOIN OWN_COLUMNS c ON c.conv_id = t.conv_id AND c.turn <= t.turn) AS x
        WHERE rn = 1""",
    ),
)
def _inherited_columns(spark, sf_dir):
    return inheritance.inherited_columns(
        frame(spark, sf_dir, "OWN_COLUMNS"), frame(spark, sf_dir, "TABLE_PARENTS"), ["conv_id"], "turn", "parent"
    )


FIXTURES["FULL_COLUMNS"] = """
    SELECT conv_id, turn, 'id' AS column_name, 'int' AS data_type, CAST(NULL AS VARCHAR(5)) AS dflt FROM conversations
    UNION ALL
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'note' ELSE 'NOTE' END,
        CASE WHEN conv_id % 3 = 0 AND turn % 4 = 2 THEN 'varchar(9)' ELSE 'text' END, 'x' FROM conversations
    UNION ALL
    SELECT conv_id, turn, concat('k', CAST(turn AS VARCHAR(5))), 'int', '0' FROM conversations
"""


@query(
    "strip_inherited",
    oracle(
        "FULL_COLUMNS",
        """SELECT c.* FROM FULL_COLUMNS c WHERE NOT EXISTS (SELECT 1 FROM FULL_COLUMNS p
        WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND lower(p.column_name) = lower(c.column_name)
            AND lower(p.data_type) = lower(c.data_type) AND p.dflt IS NOT DISTINCT FROM c.dflt)""",
    ),
)
def _strip_inherited(spark, sf_dir):
    return inheritance.strip_inherited(
        frame(spark, sf_dir, "FULL_COLUMNS"),
        frame(spark, sf_dir, "TABLE_PARENTS"),
        ["conv_id"],
        "turn",
        "parent",
        ["column_name", "data_type", "dflt"],
    )


# -- sequences ----------------------------------------------------------------


@query(
    "assign_serial",
    "SELECT event_id, user_id, 999 + row_number() OVER (ORDER BY ts, event_id) AS serial FROM events",
)
def _assign_serial(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return sequences.assign_serial(events, ["ts", "event_id"], start=1000).drop("ts")


SERIAL_KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
               "events": "event_id", "documents": "doc_id"}


@query(
    "sequence_position",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{k}' AS column_name, max({k}) AS position FROM {t}" for t, k in SERIAL_KEYS.items()
    ),
)
def _sequence_position(spark, sf_dir):
    specs = {t: TableSpec(t, (ColumnSpec(k, "bigserial", False),), (k,)) for t, k in SERIAL_KEYS.items()}
    # Neither of these takes part: a declared start, and a key of two columns.
    specs["labels"] = TableSpec("labels", (ColumnSpec("doc_id", "serial", serial_start=7),), ("doc_id",))
    specs["conversations"] = TableSpec("conversations", (ColumnSpec("conv_id", "serial"),), ("conv_id", "turn"))
    return sequences.sequence_position({t: table(spark, sf_dir, t) for t in specs}, specs)


@query(
    "sequence_values",
    """SELECT event_id, CASE WHEN event_id < 16 THEN 5 + event_id * 3 ELSE 2 + ((event_id - 16) % 17) * 3 END AS cycled,
        CASE WHEN event_id < 16 THEN 5 + event_id * 3 END AS plain, event_id >= 16 AS exhausted,
        CASE WHEN event_id < 3 THEN 10 - event_id * 4 ELSE 20 - ((event_id - 3) % 5) * 4 END AS falling
    FROM events""",
)
def _sequence_values(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") + 1).alias("call"))
    up = SequenceSpec(start=5, increment=3, minimum=2, maximum=50, cycle=True)
    once = SequenceSpec(start=5, increment=3, minimum=2, maximum=50)
    down = SequenceSpec(start=10, increment=-4, minimum=2, maximum=20, cycle=True)
    df = sequences.sequence_values(calls, "call", up, "cycled").drop("exhausted")
    df = sequences.sequence_values(df, "call", down, "falling").drop("exhausted")
    return sequences.sequence_values(df, "call", once, "plain").drop("call")
