import random
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowtide import ForeignKeySpec, TableSpec
from rowtide.operators import diff, options, setops
from rowtide.sources import sinks
from tests.conftest import rows

SCHEMA = "k int, a string, b int"


def ops(changes):
    return sorted(((tuple(r["key"]), r["op"]) for r in changes.collect()), key=repr)


def test_all_cases_in_one_pass(frame):
    old = frame(SCHEMA, (1, "x", 1), (2, "y", 2), (3, "z", 3), (4, "w", None))
    new = frame(SCHEMA, (1, "x", 1), (2, "Y", 2), (4, "w", 4), (5, "n", 5))
    changes = {r["key"]["k"]: r for r in diff.change_set(old, new, ["k"], table="t", dep_rank=3).collect()}
    assert sorted(changes) == [2, 3, 4, 5]
    assert (changes[2]["op"], changes[2]["changed"], changes[2]["stage"]) == ("U", ["a"], 4)
    assert (changes[3]["op"], changes[3]["stage"], changes[3]["after"]) == ("D", 2, None)
    assert changes[4]["changed"] == ["b"] and changes[4]["before"]["b"] is None
    assert changes[5]["op"] == "I" and changes[5]["before"] is None and changes[5]["dep_rank"] == 3


def test_null_keys_match_each_other(frame):
    old = frame("k1 int, k2 string, v int", (None, "a", 1), (1, None, 2), (None, None, 3))
    new = frame("k1 int, k2 string, v int", (None, "a", 1), (1, None, 9), (2, None, 4))
    assert ops(diff.change_set(old, new, ["k1", "k2"])) == [((1, None), "U"), ((2, None), "I"), ((None, None), "D")]
    assert rows(diff.rows_added(old, new, ["k1", "k2"])) == [(2, None, 4)]
    assert rows(diff.rows_removed(old, new, ["k1", "k2"])) == [(None, None, 3)]


def test_repeated_keys_stop_the_job(frame):
    old, new = frame(SCHEMA, (1, "x", 1), (1, "y", 1)), frame(SCHEMA, (1, "x", 1))
    with pytest.raises(Exception, match="old state: key .k. is not unique"):
        diff.change_set(old, new, ["k"]).collect()
    with pytest.raises(Exception, match="new state: key .k. is not unique"):
        diff.change_set(new, old, ["k"]).collect()


def test_null_keys_stop_the_job_where_none_are_expected(frame):
    old, new = frame(SCHEMA, (1, "x", 1)), frame(SCHEMA, (None, "x", 1))
    with pytest.raises(Exception, match="holds NULL"):
        diff.change_set(old, new, ["k"], null_keys=False).collect()


def test_a_key_with_a_third_of_all_rows_is_one_flagged_row(spark):
    old = spark.range(3000).select(F.when(F.col("id") < 1000, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    found = diff.change_set(old, old, ["k"], on_duplicate="flag")
    assert rows(found, "op", "old_copies", "new_copies") == [("X", 1000, 1000)]


def test_tombstones_on_both_sides(frame):
    schema = "k int, v int, _delete boolean"
    old = frame(schema, (1, 1, None), (2, 2, False), (3, 3, True), (4, 4, True))
    new = frame(schema, (1, 1, True), (2, 5, False), (3, 3, False), (5, 5, True))
    # 1 is flagged, 3 was not there before, 4 stays away, 5 never was.
    assert ops(diff.change_set(old, new, ["k"])) == [((1,), "D"), ((2,), "U"), ((3,), "I")]
    found = rows(diff.tombstones(old, new, ["k"]))
    assert found == [(1, True, "D"), (2, False, "U"), (3, False, "I"), (5, True, "N")]


@pytest.mark.parametrize("old_rows,new_rows,expected", [
    ([], [(1, "a", 1)], [((1,), "I")]),
    ([(1, "a", 1)], [], [((1,), "D")]),
    ([], [], []),
])
def test_empty_states(frame, old_rows, new_rows, expected):
    old, new = frame(SCHEMA, *old_rows), frame(SCHEMA, *new_rows)
    assert ops(diff.change_set(old, new, ["k"])) == expected
    assert rows(diff.round_trip_check(old, new, ["k"])) == [(0, 0)]


def test_columns_match_by_name_whatever_case_and_order(frame):
    old = frame("K int, a string, B int", (1, "x", 1), (2, "y", 2))
    new = frame("b int, k int, A string", (1, 1, "x"), (3, 2, "y"))
    changes = diff.change_set(old, new, ["k"])
    assert [(r["op"], r["changed"]) for r in changes.collect()] == [("U", ["b"])]


def test_new_columns_always_count_and_lost_ones_never(frame):
    old = frame("k int, gone int, v int", (1, 1, 1))
    assert rows(diff.rows_changed(old, frame("k int, v int", (1, 1)), ["k"])) == []
    changed = diff.changed_columns(old, frame("k int, v int, extra int", (1, 1, None)), ["k"])
    assert [r["changed"] for r in changed.collect()] == [["extra"]]


def test_generated_column_is_the_only_update(frame):
    old = frame("test_string string, test_number int", ("testtest", 12345))
    new = frame("test_string string, test_number int, test_serial int", ("testtest", 12345, 1))
    changes = diff.change_set(old, new, ["test_string"]).collect()
    assert [(r["op"], r["changed"]) for r in changes] == [("U", ["test_serial"])]


def test_text_mode_sees_null_and_blank_as_one(frame):
    old, new = frame("k int, v string", (1, None), (2, "")), frame("k int, v string", (1, ""), (2, "x"))
    assert ops(diff.change_set(old, new, ["k"], mode="text")) == [((2,), "U")]
    assert ops(diff.change_set(old, new, ["k"])) == [((1,), "U"), ((2,), "U")]


def test_row_equal_needs_the_same_columns(frame):
    old = frame("k int, a int, b int", (1, 1, 2))
    assert rows(diff.row_equal(old, frame("b int, k int, a int", (2, 1, 1)), ["k"])) == [(1, True)]
    assert rows(diff.row_equal(old, frame("k int, a int", (1, 1)), ["k"])) == [(1, False)]


def test_tables_of_keys_only(frame):
    old, new = frame("a int, b int", (1, 1), (1, 2)), frame("a int, b int", (1, 2), (1, 3))
    assert ops(diff.change_set(old, new, ["a", "b"])) == [((1, 1), "D"), ((1, 3), "I")]
    assert rows(diff.round_trip_check(old, new, ["a", "b"])) == [(0, 0)]


def test_rename_guards(frame):
    old, new = frame("k int, a int", (1, 1)), frame("k int, b int", (1, 1))
    assert ops(diff.diff_column_renames(old, new, ["k"], {"a": "b"})) == []
    with pytest.raises(ValueError, match="not in the old state"):
        diff.diff_column_renames(old, new, ["k"], {"x": "b"})
    with pytest.raises(ValueError, match="still has"):
        diff.diff_column_renames(old, frame("k int, a int, b int", (1, 1, 1)), ["k"], {"a": "b"})


def test_table_rename_guards(frame):
    state = frame("k int, v int", (1, 1))
    spec = TableSpec("b", (), ("k",), old_name="a")
    assert diff.match_tables({"public.a": state}, {"public.b": state}, {"public.b": spec}) == [
        ("public.b", "public.a", "public.b")
    ]
    with pytest.raises(ValueError, match="has no table"):
        diff.match_tables({}, {"public.b": state}, {"public.b": spec})
    with pytest.raises(ValueError, match="still has"):
        diff.match_tables({"public.a": state}, {"public.b": state, "public.a": state}, {"public.b": spec})


def test_key_change_without_a_shared_column(frame):
    with pytest.raises(ValueError, match="no column of the new key"):
        diff.diff_key_change(frame("a int", (1,)), frame("b int", (1,)), ["b"])


def test_many_tables_can_be_limited(frame):
    specs = {n: TableSpec(n.split(".")[1], (), ("k",)) for n in ("public.a", "public.b", "public.c")}
    a, b, c = frame("k int, v int", (1, 1)), frame("k int, w string", (1, "x")), frame("k int", (7,))
    changes = diff.diff_many_tables({"public.a": a, "public.c": c}, {"public.a": a, "public.b": b}, specs)
    assert rows(changes, "table", "op") == [("public.b", "I"), ("public.c", "D")]
    limited = diff.diff_many_tables({"public.c": c}, {"public.b": b}, specs, tables=["b"])
    assert rows(limited, "table", "op") == [("public.b", "I")]


def test_order_of_a_change_set(frame):
    specs = {n: TableSpec(n, (), ("k",)) for n in ("parent", "child")}
    old = {"parent": frame("k int, v int", (1, 1), (2, 2)), "child": frame("k int, v int", (1, 1))}
    new = {"parent": frame("k int, v int", (2, 3), (3, 3)), "child": frame("k int, v int", (4, 4))}
    changes = diff.diff_many_tables(old, new, specs, ranks={"parent": 0, "child": 1})
    order = [(r["table"], r["op"]) for r in diff.ordered_change_set(changes).collect()]
    assert order == [("child", "D"), ("parent", "D"), ("parent", "U"), ("parent", "I"), ("child", "I")]


def test_reverse_takes_the_new_state_back(frame):
    old = frame(SCHEMA, (1, "x", 1), (2, "y", None), (3, "z", 3))
    new = frame(SCHEMA, (1, "X", 1), (2, "y", 2), (4, None, 4))
    back = diff.reverse_change_set(diff.change_set(old, new, ["k"]))
    assert rows(diff.apply_change_set(new, back, ["k"])) == rows(old)


@pytest.mark.parametrize("seed", range(6))
def test_round_trip_holds_for_random_states(spark, seed):
    rng = random.Random(seed)

    def state():
        keys = {(rng.choice([None, 0, 1, 2, 3, 4]), rng.choice(["a", "b", "", None])) for _ in range(14)}
        return [(*k, rng.choice([None, "", "p", "q"]), rng.choice([None, 1.5, 2.5]), rng.random() < 0.2) for k in keys]

    schema = "k1 int, k2 string, v string, w double, _delete boolean"
    old, new = spark.createDataFrame(state(), schema), spark.createDataFrame(state(), schema)
    assert rows(diff.round_trip_check(old, new, ["k1", "k2"])) == [(0, 0)]
    back = diff.reverse_change_set(diff.change_set(old, new, ["k1", "k2"]))
    restored = diff.apply_change_set(diff.live_rows(new), back, ["k1", "k2"])
    assert rows(restored) == rows(diff.live_rows(old))


def test_set_operations_keep_multiplicity(frame):
    left = frame("v string", ("A",), ("a",), ("a",), ("b",), ("c",))
    right = frame("v string", ("a",), ("A",), ("C",), ("d",), ("D",))
    assert rows(setops.set_union_ci(left, right, "v")) == [("A", 1), ("D", 1), ("a", 2), ("b", 1), ("c", 1)]
    assert rows(setops.set_intersect_ci(left, right, "v")) == [("A", 2), ("a", 4), ("c", 1)]
    assert rows(setops.set_difference_ci(left, right, "v")) == [("b", 1)]
    expanded = setops.expand_copies(setops.set_intersect_ci(left, right, "v"))
    assert rows(expanded) == [("A",)] * 2 + [("a",)] * 4 + [("c",)]


def test_options(frame):
    old = frame("t int, o string", (1, "(oids=true,fillfactor=70)"), (2, "(a=1)"), (3, "(a=1=2)"))
    new = frame("t int, o string", (1, "(OIDS=TRUE,fillfactor=80,x)"), (3, "(a=1)"))
    assert rows(options.options_diff(old, new, ["t"], "o")) == [
        (1, "fillfactor", "update", "70", "80"),
        (1, "x", "create", None, ""),
        (2, "a", "delete", "1", None),
    ]


# -- change sets of many tables -----------------------------------------------


def upgrade(frame):
    old = {"public.achild": frame("id int, p int, note string", (1, 1, "x"), (2, 1, None), (11, 1, "k")),
           "public.zparent": frame("id int, at timestamp, price decimal(9,2)", (1, datetime(2020, 1, 1, 0, 0, 0, 123456), Decimal("1.10")))}
    new = {"public.achild": frame("id int, p int, note string", (2, 2, "y"), (None, 2, None), (11, 1, None), (3, 1, "z")),
           "public.zparent": frame("id int, at timestamp, price decimal(9,2)", (1, datetime(2020, 1, 1, 0, 0, 0, 123457), None), (2, None, Decimal("7.00")))}
    specs = {"public.achild": TableSpec("achild", (), ("id",), foreign_keys=(ForeignKeySpec(("p",), "zparent", ("id",), "fk"),)),
             "public.zparent": TableSpec("zparent", (), ("id",))}
    return old, new, specs


def test_changes_of_many_tables_lose_nothing(frame):
    old, new, specs = upgrade(frame)
    changes = diff.diff_many_tables(old, new, specs)
    for name, state in diff.apply_many(old, changes, specs, new).items():
        assert rows(state, *new[name].columns) == rows(new[name])
    typed = diff.table_changes(changes, "public.achild", ["id"], old["public.achild"], new["public.achild"])
    single = diff.change_set(old["public.achild"], new["public.achild"], ["id"], table="public.achild", dep_rank=1)
    assert rows(typed, *single.columns) == rows(single)


def test_ranks_follow_foreign_keys(frame):
    old, new, specs = upgrade(frame)
    order = [(r["table"], r["op"], r["key"]) for r in diff.ordered_change_set(diff.diff_many_tables(old, new, specs)).collect()]
    assert order == [
        ("public.achild", "D", '{"id":1}'), ("public.zparent", "U", '{"id":1}'), ("public.zparent", "I", '{"id":2}'),
        ("public.achild", "U", '{"id":2}'), ("public.achild", "U", '{"id":11}'),
        ("public.achild", "I", '{"id":null}'), ("public.achild", "I", '{"id":3}'),
    ]
    circle = {"public.a": TableSpec("a", (), ("id",), foreign_keys=(ForeignKeySpec(("x",), "b"),)),
              "public.b": TableSpec("b", (), ("id",), foreign_keys=(ForeignKeySpec(("x",), "a"),))}
    with pytest.raises(ValueError, match="cycle"):
        diff.foreign_key_ranks(circle)


def test_statements_of_many_tables(frame):
    old, new, specs = upgrade(frame)
    found = diff.ordered_change_set(sinks.render_many_sql(diff.diff_many_tables(old, new, specs), specs, old, new))
    texts = [r["sql"] for r in found.collect()]
    assert texts[0] == "DELETE FROM public.achild\nWHERE id = 1;"
    assert texts[2] == "INSERT INTO public.zparent (id, at, price) VALUES (2, NULL, 7.00);"
    assert texts[4] == "UPDATE public.achild\nSET note = NULL\nWHERE id = 11;"
    assert texts[5] == "INSERT INTO public.achild (id, p, note) VALUES (NULL, 2, NULL);"


@pytest.mark.parametrize("kind,values", [
    ("int", [None, -(2**31), -7, 0, 3, 11, 2**31 - 1]), ("string", [None, "", "B", "a", "a b", "aa"]),
    ("double", [None, -1e300, -2.5, -1e-9, 0.0, 1e-9, 2.5, 1e300, float("inf")]), ("boolean", [None, False, True]),
    ("double", [-float("inf"), -1.0000000000000002, -1.0, -1e-100, -5e-324, 0.0, 5e-324, 1e-200, 1e-100, 0.1, 0.30000000000000004, 1e22, 1.7976931348623157e308]),
    ("decimal(9,2)", [None, Decimal("-12.30"), Decimal("-2.00"), Decimal("0.01"), Decimal("9.99"), Decimal("10.00")]),
    ("date", [None, date(1960, 1, 1), date(2000, 1, 1), date(2000, 10, 1)]),
    ("timestamp", [None, datetime(1960, 1, 1), datetime(2000, 1, 1, 0, 0, 0, 5), datetime(2000, 1, 1, 0, 0, 1)]),
])
def test_sort_keys_sort_as_the_values(frame, kind, values):
    df = frame(f"i int, v {kind}", *enumerate(values))
    text = diff.sortable_text(F.col("v"), df.schema["v"].dataType)
    assert [r["i"] for r in df.orderBy(text).collect()] == list(range(len(values)))


def test_repeated_keys_are_not_dropped_unreported(frame):
    old, new = frame("k int, v int", (1, 1), (1, 2)), frame("k int, v int", (1, 3))
    for run in (diff.rows_changed, diff.changed_columns, diff.cell_changes):
        with pytest.raises(ValueError, match="change_set"):
            run(old, new, ["k"], on_duplicate="flag")


def test_applying_changes_of_a_key_with_a_third_of_all_rows(spark, frame):
    state = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit("a").alias("v"))
    changes = diff.change_set(frame("k long, v string", (0, "a")), frame("k long, v string", (0, "b")), ["k"])
    found = diff.apply_change_set(state, changes, ["k"])
    assert rows(found.groupBy("v").count()) == [("a", 20_000), ("b", 10_000)]
