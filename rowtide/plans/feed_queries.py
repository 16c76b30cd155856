"""Queries of sources, sinks and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from rowtide.operators import diff
from rowtide.plans.diff_queries import MANY, ORDER_KEY, flat_key, many_changes, order_states
from rowtide.plans.fixtures import frame, oracle, table
from rowtide.plans.registry import query
from rowtide.session import scratch_path
from rowtide.sources import rowsets, sinks
from rowtide.spec import CheckSpec, ColumnSpec, EnumSpec, ForeignKeySpec, TableSpec
from rowtide.streaming import changes as feeds

# -- sources ------------------------------------------------------------------


@query("read_snapshot", "SELECT o_orderkey, o_totalprice FROM orders")
def _read_snapshot(spark, sf_dir):
    return rowsets.read_snapshot(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])


SEGMENT_SPEC = TableSpec(
    "customer",
    (
        ColumnSpec("c_custkey", "bigint", False),
        ColumnSpec("segment", "text", default="'UNKNOWN'"),
        ColumnSpec("balance", "double precision"),
        ColumnSpec("note", "text"),
    ),
    ("c_custkey",),
)
DECLARED = """
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'UNKNOWN'
        ELSE c_mktsegment END AS segment, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS note, c_custkey % 7 = 0 AS _delete
    FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey, CASE WHEN c_nationkey % 4 <> 0 THEN c_mktsegment END, c_acctbal, NULL, FALSE
    FROM customer WHERE c_custkey % 2 = 1
"""


@query("read_declared_rows", DECLARED)
def _read_declared_rows(spark, sf_dir):
    path = scratch_path(spark, "declared")
    customers = table(spark, sf_dir, "customer")
    kind = F.col("c_custkey") % 5
    # Cells for even keys, delimited lines for odd ones; 50 keys to an element.
    text = F.when(kind == 2, " Default ").when(kind == 4, F.col("c_mktsegment"))
    none = F.lit(None).cast("boolean")
    segment = F.struct(
        text.alias("_VALUE"),
        F.when(kind == 0, True).alias("_null"),
        F.when(kind == 1, True).alias("_empty"),
        F.when(kind == 2, True).alias("_sql"),
    )

    def plain(value):
        return F.struct(
            value.cast("string").alias("_VALUE"), none.alias("_null"), none.alias("_empty"), none.alias("_sql")
        )

    row = F.struct(
        F.when(F.col("c_custkey") % 7 == 0, True).alias("_delete"),
        F.array(plain(F.col("c_custkey")), segment, plain(F.col("c_acctbal"))).alias("col"),
    )
    line = F.concat_ws(
        "|",
        F.col("c_custkey").cast("string"),
        F.when(F.col("c_nationkey") % 4 == 0, F.lit("\\N")).otherwise(F.col("c_mktsegment")),
        F.col("c_acctbal").cast("string"),
    )
    even = F.col("c_custkey") % 2 == 0
    elements = (
        customers.groupBy(F.floor(F.col("c_custkey") / 50).alias("element"))
        .agg(F.collect_list(F.when(even, row)).alias("row"), F.collect_list(F.when(~even, line)).alias("tabrow"))
        .select(
            F.lit("c_custkey, SEGMENT balance").alias("_columns"), F.lit("|").alias("_tabrowDelimiter"), "row", "tabrow"
        )
    )
    elements.write.format("xml").option("rootTag", "tables").option("rowTag", "rows").save(path)
    return rowsets.declared_table(rowsets.read_declared_rows(spark, path), SEGMENT_SPEC)


@query(
    "decode_tabrows",
    """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
        CASE WHEN c_nationkey % 4 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
        CAST(NULL AS VARCHAR) AS c_extra FROM customer""",
)
def _decode_tabrows(spark, sf_dir):
    columns = ["c_custkey", "c_name", "c_nationkey", "c_extra"]
    return rowsets.decode_tabrows(frame(spark, sf_dir, "TABROWS"), "line", columns, "|")


@query(
    "resolve_cells",
    oracle(
        "CELLS",
        """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 4 THEN txt ELSE 'UNKNOWN' END
            AS segment, CAST(NULL AS VARCHAR) AS segment_expression FROM CELLS""",
    ),
)
def _resolve_cells(spark, sf_dir):
    cell = F.struct(
        F.col("is_null").alias("null"), F.col("is_empty").alias("empty"), F.col("is_sql").alias("sql"), F.col("txt").alias("text")
    )
    cells = frame(spark, sf_dir, "CELLS").select("c_custkey", cell.alias("segment"))
    return rowsets.resolve_cells(cells, SEGMENT_SPEC)


@query(
    "align_rowset",
    "SELECT c_custkey, c_mktsegment AS segment, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS note FROM customer",
)
def _align_rowset(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_acctbal AS BALANCE", "c_custkey", "c_mktsegment AS Segment")
    return rowsets.align_rowset(rows, SEGMENT_SPEC)


@query("add_rowset_column", "SELECT s_suppkey, s_name, 'active' AS s_state FROM supplier")
def _add_rowset_column(spark, sf_dir):
    return rowsets.add_rowset_column(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_state", "active")


# -- sinks --------------------------------------------------------------------


@query(
    "write_change_set",
    oracle(
        "ORD_OLD ORD_NEW LI_OLD LI_NEW",
        f"""SELECT CASE WHEN op = 'D' THEN 2 ELSE 4 END AS stage, "table", count(*) AS n, TRUE AS within_limit,
            TRUE AS files_in_order, CAST(0 AS BIGINT) AS rows_out_of_order FROM ({MANY}) AS m GROUP BY ALL""",
    ),
)
def _write_change_set(spark, sf_dir):
    """What the files hold, as properties of any right layout: all rows, at most
    700 to a file, rows in run order within a file, and files that follow each other."""
    path = scratch_path(spark, "changes")
    changes = flat_key(many_changes(spark, sf_dir)).drop("sort_key")
    op_rank = F.when(F.col("op") == "D", 0).when(F.col("op") == "U", 1).otherwise(2)
    changes = changes.withColumn("key", F.struct(op_rank.alias("op_rank"), "key.k1", "key.k2"))
    sinks.write_change_set(changes, path, max_per_file=700)
    files = sinks.written_files(spark, path)
    # Of two files of a folder the one with the smaller name ends before the other begins.
    other = files.select(F.col("stage").alias("s"), F.col("table").alias("t"), F.col("file").alias("f"), F.col("first_key").alias("k"))
    pairs = files.join(other, (F.col("stage") == F.col("s")) & (F.col("table") == F.col("t")) & (F.col("file") < F.col("f")), "left")
    each = pairs.groupBy("stage", "table", "file").agg(
        F.max("n").alias("n"), F.max("out_of_order").alias("out_of_order"),
        F.bool_and(F.coalesce(F.col("last_key") < F.col("k"), F.lit(True))).alias("before_next"),
    )
    return each.groupBy("stage", "table").agg(
        F.sum("n").alias("n"), (F.max("n") <= 700).alias("within_limit"), F.bool_and("before_next").alias("files_in_order"),
        F.sum("out_of_order").alias("rows_out_of_order"),
    )


@query(
    "render_change_sql",
    oracle(
        "ORD_OLD ORD_NEW",
        f"""SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey,
            CASE WHEN o.o_orderkey IS NULL THEN 'INSERT INTO public.orders (o_orderkey, o_custkey, o_orderstatus, '
                    || 'o_orderpriority) VALUES (' || n.o_orderkey || ', ' || n.o_custkey || ', '
                    || coalesce('''' || n.o_orderstatus || '''', 'NULL') || ', '''
                    || replace(n.o_orderpriority, 'CHANGED', 'it''''s') || ''');'
                WHEN n.o_orderkey IS NULL THEN 'DELETE FROM public.orders' || chr(10) || 'WHERE o_orderkey = '
                    || o.o_orderkey || ';'
                ELSE 'UPDATE public.orders' || chr(10) || 'SET ' || concat_ws(',' || chr(10) || '    ',
                    CASE WHEN n.o_custkey <> o.o_custkey THEN 'o_custkey = ' || n.o_custkey END,
                    CASE WHEN n.o_orderstatus IS DISTINCT FROM o.o_orderstatus THEN
                        'o_orderstatus = ' || coalesce('''' || n.o_orderstatus || '''', 'NULL') END,
                    CASE WHEN n.o_orderpriority <> o.o_orderpriority THEN 'o_orderpriority = '''
                        || replace(n.o_orderpriority, 'CHANGED', 'it''''s') || '''' END)
                    || chr(10) || 'WHERE o_orderkey = ' || n.o_orderkey || ';' END AS sql
        FROM ORD_OLD o FULL OUTER JOIN ORD_NEW n ON o.o_orderkey = n.o_orderkey
        WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR n.o_custkey <> o.o_custkey
            OR n.o_orderstatus IS DISTINCT FROM o.o_orderstatus OR n.o_orderpriority <> o.o_orderpriority""",
    ),
)
def _render_change_sql(spark, sf_dir):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    old, new = [d.select(*columns) for d in order_states(spark, sf_dir)]
    quoted = F.replace("o_orderpriority", F.lit("CHANGED"), F.lit("it's"))
    new = new.withColumn("o_orderpriority", quoted)
    changes = diff.change_set(old, new, ORDER_KEY, table="public.orders")
    return sinks.render_change_sql(changes).select("key.o_orderkey", "sql")


# -- feeds --------------------------------------------------------------------


def event_feed(spark, sf_dir):
    """The events as a stream of files, split by number."""
    path = scratch_path(spark, "feed")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    events.withColumn("part", F.col("event_id") % 4).write.partitionBy("part").parquet(path)
    schema = T.StructType([*events.schema.fields, T.StructField("part", T.LongType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path).drop("part")


@query(
    "stream_apply_changes",
    """
    WITH last AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value,
        max(event_id) AS seq FROM events GROUP BY user_id)
    SELECT user_id, event_type, value, seq FROM last WHERE event_type <> 'error'
    UNION ALL SELECT c_custkey, 'base', c_acctbal, NULL FROM customer
    WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
)
def _stream_apply_changes(spark, sf_dir):
    path = scratch_path(spark, "state")
    feed = event_feed(spark, sf_dir)
    op = F.when(F.col("event_type") == "error", "D").otherwise("U")
    rows = feed.select("user_id", "event_type", "value", op.alias("op"), F.col("event_id").alias("seq"))
    writer = feeds.stream_apply_changes(rows, path, scratch_path(spark, "progress"), ["user_id"])
    feeds.run_available(writer)
    base = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit("base").alias("event_type"), F.col("c_acctbal").alias("value")
    )
    return feeds.current_state(spark, path, ["user_id"], base=base)


@query(
    "stream_constraint_check",
    """
    SELECT event_id, user_id, event_type, value, 'value_low' AS constraint_name FROM events WHERE NOT value < 100
    UNION ALL SELECT event_id, user_id, event_type, value, 'event_enum' FROM events
    WHERE event_type NOT IN ('click', 'view', 'purchase')
    UNION ALL SELECT event_id, user_id, event_type, value, 'value_not_null' FROM events WHERE value IS NULL
    UNION ALL SELECT event_id, user_id, event_type, value, 'events_supplier_fk' FROM events
    WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""",
)
def _stream_constraint_check(spark, sf_dir):
    path = scratch_path(spark, "violations")
    writer = feeds.stream_constraint_check(
        event_feed(spark, sf_dir),
        path,
        scratch_path(spark, "progress"),
        not_null=("value",),
        checks=(CheckSpec("value_low", "CHECK (value < 100)"),),
        enums={"event_type": EnumSpec("event_enum", ("click", "view", "purchase"))},
        foreign_keys=(
            (ForeignKeySpec(("user_id",), "supplier", ("s_suppkey",), "events_supplier_fk"), table(spark, sf_dir, "supplier")),
        ),
    )
    feeds.run_available(writer)
    return spark.read.parquet(path)


@query(
    "stream_reference_check",
    """
    WITH clicks AS (SELECT DISTINCT user_id,
        time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE - INTERVAL 1 MICROSECOND AS until
        FROM events WHERE event_type = 'click')
    SELECT event_id, user_id, value, 'purchase_click_fk' AS constraint_name FROM events e
    WHERE event_type = 'purchase' AND user_id IS NOT NULL AND ts IS NOT NULL AND NOT EXISTS (SELECT 1 FROM clicks c
        WHERE c.user_id = e.user_id AND c.until BETWEEN e.ts - INTERVAL 36 HOUR AND e.ts + INTERVAL 70 MINUTE)""",
)
def _stream_reference_check(spark, sf_dir):
    """Purchases without a click of the user from 36 hours before to an hour after.

    The earlier half of the events comes in one run and the later half in the
    next, so state is carried over; a click and a purchase of no real user, far
    ahead, close both streams.
    """
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.select("event_id", "user_id", "event_type", "value", "ts")
    middle = events.agg(F.timestamp_seconds((F.min(F.unix_micros("ts")) + F.max(F.unix_micros("ts"))) / 2000000)).first()[0]
    late = F.coalesce(F.col("ts") >= F.lit(middle), F.lit(True))
    path, found, progress = (scratch_path(spark, n) for n in ("feed", "violations", "progress"))
    end = F.lit("2200-01-01 00:00:00").cast("timestamp")
    none = [F.lit(-1).cast(events.schema[c].dataType).alias(c) for c in ("event_id", "user_id")]
    close = spark.range(2).select(
        *none, F.when(F.col("id") == 0, "click").otherwise("purchase").alias("event_type"), F.lit(None).cast("double").alias("value"), end.alias("ts")
    )
    for rows in (events.filter(~late), events.filter(late).unionByName(close)):
        rows.write.mode("append").parquet(path)
        feed = spark.readStream.schema(events.schema).parquet(path)
        writer = feeds.stream_reference_check(
            feed.filter("event_type = 'purchase'"),
            feed.filter("event_type = 'click'"),
            ForeignKeySpec(("user_id",), "clicks", ("user_id",), "purchase_click_fk"),
            found,
            progress,
            child_time="ts",
            parent_time="ts",
            before="36 hours",
            after="1 hour",
            bucket="10 minutes",
            delay="1 hour",
        )
        feeds.run_available(writer)
    return spark.read.parquet(found).select("event_id", "user_id", "value", "constraint_name")
