import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rowtide import CheckSpec, ColumnSpec, DomainSpec, EnumSpec, ForeignKeySpec, TableSpec, UniqueSpec
from check import oracle_result, spark_result
from rowtide.functions.text import strip_check
from rowtide.operators import checks, graph, overlay
from rowtide.plans import load_all
from tests.conftest import plan_of, rows

# -- layers -------------------------------------------------------------------


def test_headers_decide_what_a_layer_supplies(frame):
    base = frame("k int, a string, b string", (1, "a", "b"), (2, "a", "b"))
    top = frame("B string, k int", (None, 1), ("new", 3))
    assert rows(overlay.overlay_rows([base, top], ["k"]), "k", "a", "b") == [
        (1, "a", None),
        (2, "a", "b"),
        (3, None, "new"),
    ]


def test_a_key_that_comes_back_starts_afresh(frame):
    base = frame("k int, a string, b string", (1, "a", "b"))
    gone = frame("k int, _delete boolean", (1, True))
    back = frame("k int, a string", (1, "again"))
    assert rows(overlay.overlay_rows([base, gone], ["k"])) == []
    assert rows(overlay.overlay_rows([base, gone, back], ["k"])) == [(1, "again", None)]


def test_copies_within_a_layer_stop_the_job(frame):
    base = frame("k int, a string", (1, "a"), (1, "b"))
    with pytest.raises(Exception, match="layer 0"):
        overlay.overlay_rows([base], ["k"]).collect()


def test_three_layers_of_an_inherited_table(frame):
    # Rows of a grandchild that use a column of the parent.
    one = frame("pk int, col1 string", (1, "p"))
    two = frame("pk int, x int", (1, 10), (2, 20))
    three = frame("pk int, col1 string, y int", (2, "q", 200))
    assert rows(overlay.overlay_rows([one, two, three], ["pk"]), "pk", "col1", "x", "y") == [
        (1, "p", 10, None),
        (2, "q", 20, 200),
    ]


def test_overwrite_takes_blanks_and_replace_takes_lists(frame):
    base = frame("k int, t string, d string, note string", (1, "int", "0", "n"), (2, "text", None, "m"))
    top = frame("k int, t string, d string", (1, "bigint", None))
    assert rows(overlay.overlay_overwrite([base, top], ["k"], ["t", "d"])) == [(1, "bigint", None, "n"), (2, "text", None, "m")]
    lists = frame("o string, e string", ("x", "1"), ("x", "2"), ("y", "3"))
    newer = frame("o string, e string", ("x", "9"))
    assert rows(overlay.overlay_replace([lists, newer], ["o"])) == [("x", "9"), ("y", "3")]


def test_append_and_update_only(frame):
    base, top = frame("k int, v string", (1, "a"), (2, "b")), frame("k int, v string", (1, None), (9, "z"))
    assert len(rows(overlay.overlay_append([base, top], ["k"]))) == 4
    assert rows(overlay.overlay_update_only(base, top, ["k"])) == [(1, None), (2, "b")]


def test_addendums_and_identities(frame):
    layers = [frame("k int, v string", (i, "x")) for i in range(4)]
    assert rows(overlay.collect_addendums(layers, 2, ["k"]), "k") == [(2,), (3,)]
    with pytest.raises(ValueError):
        overlay.collect_addendums(layers, 5, ["k"])
    functions = frame("db int, name string, params string", (1, "f", "int"), (1, "F", "INT"), (1, "f", "text"), (2, "f", "int"))
    assert rows(overlay.duplicate_identities(functions, ["db"], ["name", "params"])) == [(1, "f", "int", 2)]


# -- constraints --------------------------------------------------------------


def test_primary_key(frame):
    df = frame("a int, b int", (1, 1), (1, 1), (1, 2), (None, 1))
    assert rows(checks.check_primary_key(df, ["a", "b"]), "a", "b", "violation", "n") == [
        (1, 1, "duplicate", 2),
        (None, 1, "null", 1),
    ]


def test_unique_lets_nulls_pass(frame):
    df = frame("a int, b int", (1, None), (1, None), (2, 2), (2, 2))
    assert rows(checks.check_unique(df, ["a", "b"]), "a", "b", "n") == [(2, 2, 2)]
    rule = UniqueSpec("u", (), ("lower(v)",), "live")
    text = frame("v string, live boolean", ("A", True), ("a", True), ("a", False), ("b", True))
    assert rows(checks.check_partial_unique(text, rule), "expression_1", "n") == [("a", 2)]


def test_foreign_keys(frame):
    child = frame("x int, y int, v int", (1, 1, 1), (1, 2, 2), (None, 9, 3), (7, 7, 4), (7, 7, 5))
    parent = frame("p int, q int", (1, 1), (1, 2))
    fk = ForeignKeySpec(("x", "y"), "parent", ("p", "q"), "fk")
    assert rows(checks.check_foreign_key(child, parent, fk), "x", "y", "n") == [(7, 7, 2)]
    assert rows(checks.check_foreign_key(child, parent, fk, "rows"), "v") == [(4,), (5,)]


def test_self_reference_and_default_columns(frame):
    tree = frame("id int, parent int", (1, None), (2, 1), (3, 9))
    fk = ForeignKeySpec(("parent",), "tree", ("id",), "fk")
    assert rows(checks.check_foreign_key(tree, tree, fk), "parent") == [(9,)]
    assert ForeignKeySpec(("a", "b"), "t").target_columns == ("a", "b")
    assert ForeignKeySpec(("a", "b"), "t", ("", "z")).target_columns == ("a", "z")
    with pytest.raises(ValueError):
        ForeignKeySpec(("a", "b"), "t", ("z",)).target_columns


@pytest.mark.parametrize("text,bare", [
    ("CHECK ((a > 0))", "a > 0"),
    ("check(a > 0)", "a > 0"),
    ("  CHECK  ( ( (a > 0) ) ) ", "a > 0"),
    ("CHECK ((a > 0) AND (b > 0))", "(a > 0) AND (b > 0)"),
    ("(a > 0) OR (b > 0)", "(a > 0) OR (b > 0)"),
    ("checked = 1", "checked = 1"),
])
def test_checks_are_stripped_of_enclosing_parentheses_only(text, bare):
    assert strip_check(text) == bare


def test_null_passes_a_check(frame):
    df = frame("a int", (1,), (-1,), (None,))
    assert rows(checks.check_expression(df, "c", "CHECK ((a > 0))"), "a") == [(-1,)]
    assert rows(checks.check_enum(frame("v string", ("a",), ("z",), (None,)), "v", EnumSpec("e", ("a", "b"))), "v") == [("z",)]


def test_domain_names_every_broken_rule(frame):
    domain = DomainSpec("d", "int", False, None, (CheckSpec("positive", "CHECK (VALUE > 0)"), CheckSpec("not_value", "'VALUE' = 'VALUE'")))
    df = frame("v string", ("5",), ("-5",), ("x",), (None,))
    assert rows(checks.check_domain(df, "v", domain), "v", "violation") == [("-5", "positive"), ("x", "type"), (None, "not_null")]


def test_type_fit(frame):
    df = frame("v string", ("99999999999999",), ("7",), (None,), ("true",), ("2024-02-30",), ("2024-02-29",))
    assert rows(checks.check_type_fit(df, "v", "int"), "v") == [("2024-02-29",), ("2024-02-30",), ("99999999999999",), ("true",)]
    assert ("2024-02-30",) in rows(checks.check_type_fit(df, "v", "date"), "v")
    assert ("2024-02-29",) not in rows(checks.check_type_fit(df, "v", "date"), "v")
    assert rows(checks.check_type_fit(df, "v", "character varying(5)"), "v") == [("2024-02-29",), ("2024-02-30",), ("99999999999999",)]


def test_report_kinds(frame):
    spec = TableSpec("t", (ColumnSpec("k", "int", False), ColumnSpec("p", "int")), ("k",),
                     foreign_keys=(ForeignKeySpec(("p",), "t", ("k",), "t_p_fk"),))
    df = frame("k int, p int", (1, None), (2, 1), (2, 8))
    report = checks.constraint_report({"t": df}, {"t": spec})
    assert rows(report, "constraint_name", "kind", "violations") == [
        ("k_not_null", "other", 0), ("k_type", "other", 0), ("p_type", "other", 0),
        ("t_p_fk", "foreign", 1), ("t_pkey", "primary", 2),
    ]
    assert rows(checks.constraint_report({"t": df}, {"t": spec}, ("foreign",)), "kind") == [("foreign",)]


def test_cascade_over_levels(frame):
    cascade = lambda *a: ForeignKeySpec(*a, on_delete="CASCADE")
    specs = {
        "c": TableSpec("c", (), ("id",), foreign_keys=(cascade(("b_code",), "b", ("code",), "c_b"),)),
        "b": TableSpec("b", (), ("id",), foreign_keys=(cascade(("a_id",), "a", ("id",), "b_a"),)),
        "a": TableSpec("a", (), ("id",)),
    }
    tables = {
        "a": frame("id int", (1,), (2,)),
        "b": frame("id int, code string, a_id int", (10, "x", 1), (11, "y", 2)),
        "c": frame("id int, b_code string", (100, "x"), (101, "y"), (102, None)),
    }
    gone = checks.propagate_deletes({"a": tables["a"].filter("id = 1")}, tables, specs)
    assert {n: rows(d) for n, d in gone.items()} == {"a": [(1,)], "b": [(10,)], "c": [(100,)]}


def test_unknown_action(frame):
    df = frame("id int, p int", (1, 1))
    with pytest.raises(ValueError, match="unknown foreign key action"):
        checks.propagate_delete(df, df, ForeignKeySpec(("p",), "t", ("id",), on_delete="EXPLODE"), ["id"])


# -- deletes ------------------------------------------------------------------


def test_a_restricted_row_holds_what_is_above_it(frame):
    tables = {
        "a": frame("id int", (1,), (2,)),
        "b": frame("id int, a int", (10, 1), (11, 1), (20, 2)),
        "c": frame("id int, b int", (100, 10)),
        "d": frame("id int, a int", (5, 1), (6, 2)),
    }
    key = lambda col, ref, action: ForeignKeySpec((col,), ref, ("id",), f"{col}_{ref}", action)
    specs = {
        "a": TableSpec("a", (), ("id",)),
        "b": TableSpec("b", (), ("id",), foreign_keys=(key("a", "a", "CASCADE"),)),
        "c": TableSpec("c", (), ("id",), foreign_keys=(key("b", "b", "RESTRICT"),)),
        "d": TableSpec("d", (), ("id",), foreign_keys=(key("a", "a", "SET NULL"),)),
    }
    effects = checks.delete_effects({"a": tables["a"]}, tables, specs)
    assert rows(effects.deleted["a"]) == [(2,)] and rows(effects.deleted["b"]) == [(20,)]
    assert rows(effects.blocked["a"]) == [(1, True)] and rows(effects.blocked["b"]) == [(10, False), (11, False)]
    assert rows(effects.updated["d"], "id", "op", "new_a") == [(6, "U", None)]
    assert rows(checks.propagate_deletes({"a": tables["a"]}, tables, specs)["b"]) == [(20,)]


@pytest.mark.parametrize("action,gone", [("CASCADE", [1, 2, 3, 4]), ("NO ACTION", []), ("RESTRICT", [])])
def test_a_tree_that_refers_to_itself(frame, action, gone):
    tree = frame("id int, up int", (1, None), (2, 1), (3, 2), (4, 3), (9, None), (8, 8))
    spec = TableSpec("t", (), ("id",), foreign_keys=(ForeignKeySpec(("up",), "t", ("id",), "t_t", action),))
    found = checks.delete_effects({"t": tree.filter("id = 1")}, {"t": tree}, {"t": spec})
    assert rows(found.deleted["t"]) == [(i,) for i in gone]
    # With the whole tree asked for, nothing that stays refers to it.
    whole = checks.delete_effects({"t": tree.filter("id < 5")}, {"t": tree}, {"t": spec})
    assert rows(whole.deleted["t"]) == ([(4,)] if action == "RESTRICT" else [(1,), (2,), (3,), (4,)])


@pytest.mark.parametrize("action", ["CASCADE", "RESTRICT"])
def test_a_chain_of_1000_levels(spark, monkeypatch, action):
    made, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: made.append(1) or cut(df))
    chain = spark.range(1000).select(F.col("id"), F.nullif(F.col("id") - 1, F.lit(-1)).alias("up"))
    specs = {
        "t": TableSpec("t", (), ("id",), foreign_keys=(ForeignKeySpec(("up",), "t", ("id",), "t_t", "CASCADE"),)),
        "x": TableSpec("x", (), ("id",), foreign_keys=(ForeignKeySpec(("t",), "t", ("id",), "x_t", action),)),
    }
    tables = {"t": chain, "x": spark.range(1).select("id", F.lit(999).cast("bigint").alias("t"))}
    found = checks.delete_effects({"t": chain.filter("id = 0")}, tables, specs)
    assert found.deleted["t"].count() == (1000 if action == "CASCADE" else 0)
    assert found.blocked["t"].count() == (0 if action == "CASCADE" else 1000)
    # Two checkpoints a round and one to begin with, down and, where a row is held, up again.
    assert len(made) <= (1 if action == "CASCADE" else 3) * (2 * 12 + 1)


def test_links_come_from_one_scan_of_each_child(spark, monkeypatch, tmp_path):
    """The rows of a child table are read once for its cascading key, however deep the chain."""
    spark.range(300).select("id", F.nullif(F.col("id") - 1, F.lit(-1)).alias("up")).write.parquet(str(tmp_path / "t"))
    tree = spark.read.parquet(str(tmp_path / "t"))
    plans, cut = [], checks.cut_lineage
    monkeypatch.setattr(checks, "cut_lineage", lambda df: plans.append(plan_of(df)) or cut(df))
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(plan_of(df)) or graph_cut(df))
    graph_cut = cut
    spec = TableSpec("t", (), ("id",), foreign_keys=(ForeignKeySpec(("up",), "t", ("id",), "t_t", "CASCADE"),))
    found = checks.delete_effects({"t": tree.filter("id = 0")}, {"t": tree}, {"t": spec})
    assert found.deleted["t"].count() == 300
    scans = [p for p in plans if "FileScan" in p and "up" in p.split("ReadSchema")[-1]]
    assert len(scans) == 1


def test_reachable_nodes_against_a_plain_search(frame):
    rng = random.Random(3)
    for size, links in ((40, 30), (200, 220), (400, 390)):
        edges = [(rng.randrange(size), rng.randrange(size)) for _ in range(links)] + [(i, i - 1) for i in range(size // 2, size)]
        start = [rng.randrange(size) for _ in range(3)]
        want, open_ = set(start), list(start)
        while open_:
            foot = open_.pop()
            for a, b in edges:
                if b == foot and a not in want:
                    want.add(a)
                    open_.append(a)
        found = graph.reachable(frame("id int", *[(i,) for i in start]), frame("id int, foot int", *edges))
        assert [r[0] for r in rows(found)] == sorted(want, key=lambda i: repr((i,)))


def test_no_action_looks_at_what_is_left(frame):
    tables = {"p": frame("id int", (1,), (2,)), "c": frame("id int, p int", (10, 1), (20, 2)), "x": frame("id int, c int", (7, 20))}
    specs = {
        "p": TableSpec("p", (), ("id",)),
        "c": TableSpec("c", (), ("id",), foreign_keys=(ForeignKeySpec(("p",), "p", ("id",), "c_p", "CASCADE"),)),
        "x": TableSpec("x", (), ("id",), foreign_keys=(ForeignKeySpec(("c",), "c", ("id",), "x_c", "NO ACTION"),)),
    }
    found = checks.delete_effects({"p": tables["p"]}, tables, specs)
    assert rows(found.deleted["p"]) == [(1,)] and rows(found.blocked["p"]) == [(2, True)]
    both = checks.delete_effects({"p": tables["p"], "x": tables["x"]}, tables, specs)
    assert rows(both.deleted["p"]) == [(1,), (2,)]


def test_a_parent_with_a_third_of_all_children(spark, frame):
    child = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).alias("p"))
    fk = ForeignKeySpec(("p",), "parent", ("id",), "fk", on_update="CASCADE")
    moved = checks.propagate_update(frame("old_id long, new_id long", (1, 5)), child, fk, ["id"])
    assert moved.count() == 10_000 and rows(moved.select("new_p").distinct()) == [(5,)]


# -- addendums and repeated keys ----------------------------------------------


def test_addendums_keep_their_deletes(frame):
    base = frame("k int, v string, w int", (1, "a", 1), (2, "b", 2), (3, "c", 3))
    first = frame("k int, v string, _delete boolean", (1, None, True), (2, "x", False), (3, None, True))
    second = frame("k int, v string, _delete boolean", (3, "again", False), (9, "new", False), (2, None, None))
    added = overlay.collect_addendums([base, first, second], 2, ["k"])
    assert rows(added, "k", "_delete") == [(1, True), (2, False), (3, False), (9, False)]
    together = overlay.overlay_rows([base, first, second], ["k"])
    assert rows(overlay.overlay_addendums(base, added, ["k"]), "k", "v", "w") == rows(together, "k", "v", "w")


def test_repeated_overlay_keys_are_refused(frame):
    base, twice = frame("k int, v string", (1, "a")), frame("k int, v string", (1, "x"), (1, "y"))
    for run in (
        lambda: overlay.overlay_update_only(base, twice, ["k"]),
        lambda: overlay.overlay_overwrite([base, twice], ["k"], ["v"]),
        lambda: overlay.collect_addendums([base, twice], 1, ["k"]),
    ):
        with pytest.raises(Exception, match="not unique"):
            run().collect()


def test_each_version_of_a_repeated_key_counts(frame):
    base = frame("k int, v string, w int", (1, "a", 1), (2, "b", 2), (3, "c", 3), (None, "n", 0))
    first = frame("k int, V string", (1, "x"), (3, "y"), (None, "m"))
    second = frame(
        "k int, u string, _delete boolean",
        (1, "one", False), (1, "gone", True), (2, "p", None), (2, "q", None), (9, "r", False), (9, "s", False), (None, "t", False),
    )
    modes = ["fail", "fail", "each"]
    expected = sorted(
        [(1, "x", 1, "one"), (2, "b", 2, "p"), (2, "b", 2, "q"), (3, "y", 3, None), (9, None, None, "r"), (9, None, None, "s"), (None, "m", 0, "t")],
        key=repr,
    )
    layers = [base, first, second]
    assert rows(overlay.overlay_rows(layers, ["k"], on_duplicate=modes), "k", "v", "w", "u") == expected
    added = overlay.collect_addendums(layers, 2, ["k"], on_duplicate=modes)
    assert rows(added, "k", "u", "_delete") == sorted(
        [(1, "one", False), (1, None, True), (2, "p", False), (2, "q", False), (3, None, False), (9, "r", False), (9, "s", False), (None, "t", False)],
        key=repr,
    )
    assert rows(overlay.overlay_addendums(base, added, ["k"]), "k", "v", "w", "u") == expected
    # A layer above the repeated one meets all its versions; those below are folded as ever.
    third = frame("k int, w int", (2, 7), (1, 8))
    four = overlay.overlay_rows([base, first, second, third], ["k"], on_duplicate=["fail", "fail", "each", "fail"])
    assert rows(four.filter("k < 3"), "k", "v", "w", "u") == sorted(
        [(1, "x", 8, "one"), (1, None, 8, None), (2, "b", 7, "p"), (2, "b", 7, "q")], key=repr
    )
    changed = frame("k int, v string", (1, "x"), (1, "y"), (7, "z"))
    assert rows(overlay.overlay_update_only(base, changed, ["k"], on_duplicate="each"), "k", "v") == sorted(
        [(1, "x"), (1, "y"), (2, "b"), (3, "c"), (None, "n")], key=repr
    )
    for copies in ([base, changed, second], [base, first, second, second]):
        with pytest.raises(Exception, match="not unique|one for each layer"):
            overlay.overlay_rows(copies, ["k"], on_duplicate=modes).collect()


def test_layer_queries_where_appended_keys_fall_on_orders(spark, tmp_path):
    orders = spark.range(0, 1_000_400, 5).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
        F.lit(1.5).alias("o_totalprice"), F.lit("2020-01-01").cast("timestamp").alias("o_orderdate"), F.lit("1").alias("o_orderpriority"),
    )
    orders.filter("o_orderkey < 1000 OR o_orderkey >= 1000000").write.parquet(f"{tmp_path}/orders.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    queries, oracles = load_all()
    for name in ("collect_addendums", "overlay_addendums", "overlay_rows", "overlay_update_only"):
        columns, found = spark_result(queries[name](spark, str(tmp_path)))
        assert (columns, found) == oracle_result(duck, oracles[name])
