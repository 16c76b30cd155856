import datetime

import pytest
from pyspark.sql import functions as F

from rowtide import CheckSpec, ColumnSpec, DomainSpec, EnumSpec, TableSpec
from rowtide.operators import assemble, catalog, evolve
from tests.conftest import rows


def spec(*columns, name="t"):
    return TableSpec(name, columns, ("id",))


ID = ColumnSpec("id", "int", False)

# -- evolution ----------------------------------------------------------------


def test_rename_is_only_done_where_declared():
    old = spec(ID, ColumnSpec("Foo", "text"))
    assert evolve.declared_renames(old, spec(ID, ColumnSpec("foo", "text"))) == {}
    with pytest.raises(ValueError, match="ambiguous"):
        evolve.declared_renames(old, spec(ID, ColumnSpec("foo", "text")), case_sensitive=True)
    renamed = spec(ID, ColumnSpec("foo", "text", old_name="Foo"))
    assert evolve.declared_renames(old, renamed, case_sensitive=True) == {"Foo": "foo"}
    with pytest.raises(ValueError, match="still has"):
        evolve.declared_renames(old, spec(ID, ColumnSpec("Foo", "text"), ColumnSpec("bar", "text", old_name="foo")))
    with pytest.raises(ValueError, match="had no column"):
        evolve.declared_renames(old, spec(ID, ColumnSpec("bar", "text", old_name="baz")))


def test_claimed_columns_are_not_dropped(frame):
    old = spec(ID, ColumnSpec("a", "int"), ColumnSpec("b", "int"))
    new = spec(ID, ColumnSpec("c", "int", old_name="a"))
    df = frame("id int, a int, b int", (1, 2, 3))
    assert evolve.drop_columns(df, old, new).columns == ["id", "a"]
    assert evolve.drop_columns(df, old, new, ignore_old_names=True).columns == ["id"]


def test_required_columns_are_filled_or_fail(frame):
    df = frame("id int, v string", (1, None), (2, "x"))
    assert rows(evolve.set_not_null(df, ColumnSpec("v", "text", False, "'d'"))) == [(1, "d"), (2, "x")]
    with pytest.raises(Exception, match="column v holds NULL"):
        evolve.set_not_null(df, ColumnSpec("v", "text", False)).collect()
    with pytest.raises(Exception, match="column w holds NULL"):
        evolve.add_column_default(df, ColumnSpec("w", "int", False)).collect()
    with pytest.raises(ValueError, match="exists already"):
        evolve.add_nullable_column(df, ColumnSpec("V", "int"))


def test_lost_values_are_reported(frame):
    df = frame("id int, v string", (1, "7"), (2, "x"), (3, None))
    column = ColumnSpec("v", "int")
    assert rows(evolve.change_column_type(df, column)) == [(1, 7), (2, None), (3, None)]
    assert rows(evolve.failed_conversions(df, column)) == [(2, "x")]
    using = ColumnSpec("v", "int", using="length(v)")
    assert rows(evolve.change_column_type(df, using)) == [(1, 1), (2, 1), (3, None)]


def test_serial_is_a_one_way_street(frame):
    df = frame("id int", (1,))
    assert rows(evolve.serial_to_int(df, ColumnSpec("id", "serial"), ColumnSpec("id", "int"))) == [(1,)]
    with pytest.raises(ValueError, match="cannot be changed"):
        evolve.serial_to_int(df, ColumnSpec("id", "int"), ColumnSpec("id", "serial"))
    with pytest.raises(ValueError, match="cannot be changed"):
        evolve.evolve_table(df, spec(ColumnSpec("id", "int")), spec(ColumnSpec("id", "serial")))


def test_whole_table(frame):
    old = spec(ID, ColumnSpec("somecol", "text"), ColumnSpec("n", "text"), ColumnSpec("gone", "int"))
    new = spec(
        ID, ColumnSpec("somecol1", "text", False, "'none'", old_name="somecol"), ColumnSpec("n", "bigint"),
        ColumnSpec("email", "text"), ColumnSpec("level", "int", False, "3"), ColumnSpec("at", "timestamp", default="now()"),
    )
    now = datetime.datetime(2024, 1, 2, 3, 4, 5)
    df = frame("ID int, somecol string, n string, gone int", (1, None, "5", 9), (2, "x", "y", 8))
    found = evolve.evolve_table(df, old, new, run_ts=now)
    assert found.columns == ["id", "somecol1", "n", "email", "level", "at"]
    assert rows(found) == [(1, "none", 5, None, 3, now), (2, "x", None, None, 3, now)]
    with pytest.raises(ValueError, match="run_ts"):
        evolve.evolve_table(df, old, new)
    with pytest.raises(ValueError, match="unknown hooks"):
        evolve.evolve_table(df, old, new, hooks={"later": lambda d: d}, run_ts=now)


def test_hooks_run_in_stage_order(frame):
    seen = []

    def note(name):
        return lambda df: (seen.append((name, tuple(df.columns))), df)[1]

    old, new = spec(ID, ColumnSpec("a", "int")), spec(ID, ColumnSpec("b", "int"))
    evolve.evolve_table(frame("id int, a int", (1, 1)), old, new, hooks={h: note(h) for h in evolve.HOOKS})
    assert seen == [
        ("before_stage1", ("id", "a")), ("after_stage1", ("id", "b", "a")),
        ("before_stage3", ("id", "b", "a")), ("after_stage3", ("id", "b")),
    ]


DOMAIN = DomainSpec("d", "int", True, "5", (CheckSpec("gt", "CHECK (VALUE > 3)"),))


@pytest.mark.parametrize("new,steps", [
    (DOMAIN, []),
    (DomainSpec("d", "bigint", True, "5", DOMAIN.checks), [("recreate", "bigint")]),
    (DomainSpec("d", "int", True, None, DOMAIN.checks), [("drop default", "5")]),
    (DomainSpec("d", "int", True, "10", DOMAIN.checks), [("set default", "10")]),
    (DomainSpec("d", "int", False, "5", DOMAIN.checks), [("set not null", "d")]),
    (DomainSpec("d", "int", True, "5", (*DOMAIN.checks, CheckSpec("lt", "VALUE < 9"))), [("add check", "lt")]),
    (DomainSpec("d", "int", True, "5", (CheckSpec("GT", "CHECK (VALUE > 4)"),)), [("change check", "GT")]),
    (DomainSpec("d", "int", True, "5"), [("drop check", "gt")]),
])
def test_domain_steps(new, steps):
    assert evolve.domain_changes(DOMAIN, new) == steps


def test_domain_and_enum_migration(frame):
    df = frame("v string", ("4",), ("2",), ("x",), (None,))
    tighter = DomainSpec("d", "int", False, None, (CheckSpec("gt", "VALUE > 3"), CheckSpec("even", "VALUE % 4 <> 0")))
    # 2 breaks "gt" before as after, and x does not fit either type.
    assert rows(evolve.migrate_domain(df, "v", DOMAIN, tighter)) == [("4", "even"), (None, "not_null")]
    as_text, lost = evolve.migrate_enum(df, "v", EnumSpec("e", ("4", "2")))
    assert as_text.count() == 4 and rows(lost) == [("x",)]


# -- drift --------------------------------------------------------------------


def test_identity_that_occurs_twice_is_ambiguous(frame):
    old = frame("db int, n string, v int", (1, "A", 1), (1, "a", 2), (1, "b", 1), (1, "c", 1))
    new = frame("db int, n string, v int", (1, "a", 1), (1, "B", 2), (1, "d", 1))
    found = catalog.catalog_diff(old, new, ["db"], ["n"], {"v": catalog.exact})
    assert rows(found, "n", "action", "changed") == [
        ("B", "changed", ["v"]), ("a", "ambiguous", []), ("c", "drop", []), ("d", "create", []),
    ]


def test_constraints_compare_target_and_column_names(frame):
    schema = ("db int, table_name string, constraint_name string, constraint_type string, definition string, "
              "on_delete string, on_update string, columns array<string>, ref_table string, ref_columns array<string>, "
              "ref_types array<string>")
    base = (1, "t", "fk", "foreign key", None, "CASCADE", "CASCADE", ["a"], "p", ["x"], ["int"])
    old = frame(schema, base, (1, "t", "pk", "primary key", None, None, None, ["a", "b"], None, None, None))
    new = frame(schema, (*base[:8], "q", *base[9:]), (1, "T", "PK", "PRIMARY KEY", None, None, None, ["B", "A"], None, None, None))
    assert rows(catalog.drift_constraints(old, new, ["db"]), "constraint_name", "action", "changed") == [
        ("PK", "recreate", ["columns"]), ("fk", "recreate", ["ref_table"]),
    ]


def test_views_functions_and_triggers(frame):
    schema = "db int, view_name string, owner string, query string"
    old = frame(schema, (1, "v", "me", " SELECT 1; "), (1, "w", "me", "select 1"))
    new = frame(schema, (1, "V", "ME", "select 1"), (1, "w", "you", "select 1"))
    assert rows(catalog.drift_views(old, new, ["db"]), "view_name", "action", "stage") == [("w", "recreate", 3)]
    assert len(rows(catalog.drift_views(old, new, ["db"], always=True))) == 2

    schema = "db int, table_name string, trigger_name string, function_name string, events array<string>, for_each string, timing string, dialect string"
    same = (1, "t", "x", "f()", ["INSERT", "update"], "ROW", "BEFORE", "pgsql")
    other = (1, "t", "x", "F()", ["UPDATE", "insert"], "row", "before", "pgsql")
    assert rows(catalog.drift_triggers(frame(schema, same), frame(schema, other), ["db"])) == []
    twice = (*same[:4], ["INSERT", "INSERT"], *same[5:])
    assert len(rows(catalog.drift_triggers(frame(schema, same), frame(schema, twice), ["db"]))) == 1


def test_function_bodies_and_returned_types(frame):
    schema = ("db int, function_name string, params array<string>, dialect string, owner string, returns string, "
              "language string, body string, force boolean")
    f = (1, "f", ["int"], "pgsql", "me", "mood", "sql", "select 1", False)
    old = frame(schema, f, (1, "g", ["int"], *f[3:]), (1, "h", ["int"], *f[3:]))
    new = frame(schema, f, (1, "g", ["text"], *f[3:]), (1, "h", ["INT"], *f[3:7], "select 2", False))
    found = rows(catalog.drift_functions(old, new, ["db"]), "function_name", "params", "action", "stage")
    assert found == [("g", ["int"], "drop", 3), ("g", ["text"], "create", 1), ("h", ["INT"], "replace", 1)]
    changed = frame("db int, type_name string", (1, "MOOD"))
    assert ("f", "replace") in rows(catalog.drift_functions(old, new, ["db"], changed), "function_name", "action")
    forced = frame(schema, (*f[:8], True))
    assert rows(catalog.drift_functions(frame(schema, f), forced, ["db"]), "action", "changed") == [("replace", [])]


def test_a_plain_column_rename_and_its_other_changes(frame):
    old = frame("db int, table_name string, column_name string, data_type string, nullable boolean, dflt string",
                (1, "t", "a", "int", True, None), (1, "t", "B", "text", False, "0"))
    new = frame("db int, table_name string, column_name string, data_type string, nullable boolean, dflt string, old_column_name string",
                (1, "t", "c", "bigint", False, "1", "A"), (1, "T", "b", "text", False, "0", None), (1, "t", "x", "int", True, None, "nope"))
    assert rows(catalog.drift_columns(old, new, ["db"]), "column_name", "action", "stage") == [
        ("c", "alter type", 1), ("c", "fill default", 1), ("c", "rename", 1), ("c", "set default", 1),
        ("c", "set not null", 3), ("x", "invalid rename", 1),
    ]


def test_two_tables_with_one_former_name(frame):
    old = frame("db int, schema_name string, table_name string", (1, "public", "a"))
    new = frame("db int, schema_name string, table_name string, old_schema_name string, old_table_name string",
                (1, "public", "a", None, None), (1, "public", "b", None, "a"))
    assert rows(catalog.drift_tables(old, new, ["db"]), "action") == [("invalid rename",)]


def test_report_totals(frame):
    drift = frame("db int, action string", (1, "create"), (1, "create"), (2, "drop"))
    found = rows(catalog.drift_report({"view": drift}))
    assert (None, "*", "*", 3) in found and (1, "*", "*", 2) in found and (2, "view", "drop", 1) in found


# -- assembly -----------------------------------------------------------------


def test_lists_follow_position_and_ignore_repeats(frame):
    schema = "db int, constraint_name string, local_table string, foreign_table string, update_rule string, delete_rule string, position int, local_column string, foreign_column string"
    row = lambda p, c: (1, "fk", "t", "p", "a", "d", p, c, c.upper())
    keys, inline = assemble.assemble_foreign_keys(frame(schema, row(10, "x"), row(2, "y"), row(10, "x")), ["db"])
    assert rows(keys, "local_columns", "foreign_columns", "on_update", "on_delete") == [
        (["y", "x"], ["Y", "X"], "NO ACTION", "SET DEFAULT")
    ]
    assert rows(inline) == []
    odd = frame(schema, row(5000, "z"), row(2, "y"), row(10, "x"))
    keys, _ = assemble.assemble_foreign_keys(odd, ["db"])
    assert rows(keys, "local_columns") == [(["y", "x"],)]
    assert rows(assemble.rows_out_of_bounds(odd), "position", "error") == [(5000, "position out of bounds: 5000")]


def test_an_unknown_trigger_event_is_reported(frame):
    schema = "db int, table_name string, trigger_name string, event string, timing string, orientation string, statement string"
    odd = frame(schema, *[(1, "t", "g", e, "AFTER", "ROW", "EXECUTE FUNCTION f()") for e in ("insert", "EXPLODE", None)])
    assert rows(assemble.assemble_triggers(odd, ["db"]), "events") == [(["INSERT"],)]
    assert rows(assemble.unknown_events(odd), "error") == [("unknown trigger event: EXPLODE",), ("unknown trigger event: none",)]


def test_owned_sequences_go_with_or_without_their_schema(frame):
    columns = frame("db int, column_name string, data_type string, nullable boolean, dflt string",
                    (1, "a", "integer", False, "nextval('public.t_a_seq'::regclass)"),
                    (1, "b", "integer", False, "nextval('\"S x\".\"T_b_seq\"'::regclass)"),
                    (1, "c", "integer", False, "nextval(('public.t_c_seq'::text)::regclass)"))
    sequences = frame("db int, sequence_name string", (1, "t_a_seq"), (1, "T_b_seq"), (1, "t_c_seq"), (1, "free"))
    assert rows(assemble.collapse_serials(columns, sequences, ["db"])[1], "sequence_name") == [("free",)]


@pytest.mark.parametrize("name,modifier,text", [
    ("varchar", 44, "varchar(40)"), ("bpchar", 5, "bpchar(1)"), ("numeric", (10 << 16) + 2 + 4, "numeric(10,2)"),
    ("timestamptz", 3, "timestamptz(3)"), ("bit", 8, "bit(8)"), ("text", -1, "text"), ("varchar", -1, "varchar"),
    ("interval", 2147418115, "interval(3)"), ("interval", (7176 << 16) + 2, "interval day to second(2)"), ("interval", (4 << 16) + 0xFFFF, "interval year"),
])
def test_type_modifiers(frame, name, modifier, text):
    found = frame("n string, m int", (name, modifier)).select(assemble.formatted_type(F.col("n"), F.col("m")).alias("t"))
    assert rows(found) == [(text,)]


def test_a_type_that_becomes_that_of_its_reference(frame):
    schema = "db int, table_name string, column_name string, data_type string, nullable boolean, dflt string"
    old, new = frame(schema, (1, "t", "c", "int", None, None)), frame(schema, (1, "t", "c", None, True, None))
    assert rows(catalog.drift_columns(old, new, ["db"]), "action") == [("alter type",)]
    same = [d.withColumn("resolved_type", F.lit("int")) for d in (old, new)]
    assert rows(catalog.drift_columns(*same, ["db"])) == []


def test_serials_are_told_by_type_default_and_nullability(frame):
    columns = frame("db int, column_name string, data_type string, nullable boolean, dflt string",
                    (1, "a", "integer", False, "nextval('t_a_seq'::regclass)"), (1, "b", "BIGINT", False, "nextval('t_b_seq'::regclass)"),
                    (1, "c", "integer", True, "nextval('t_c_seq'::regclass)"), (1, "d", "text", False, "nextval('t_d_seq')"))
    sequences = frame("db int, sequence_name string", (1, "t_a_seq"), (1, "t_b_seq"), (1, "t_c_seq"), (1, "free"))
    found, left = assemble.collapse_serials(columns, sequences, ["db"])
    assert [r[1:3] for r in rows(found)] == [("a", "serial"), ("b", "bigserial"), ("c", "integer"), ("d", "text")]
    assert rows(left, "sequence_name") == [("free",), ("t_c_seq",)]
