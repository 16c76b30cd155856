import re
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from rowtide import CheckSpec, ColumnSpec, EnumSpec, ForeignKeySpec, TableSpec
from rowtide.functions import text
from rowtide.functions.times import interval_microseconds
from rowtide.functions.types import length_limit, spark_type
from rowtide.operators import diff, grants, verify
from rowtide.sources import rowsets, sinks
from rowtide.streaming import changes as feeds
from tests.conftest import plan_of, rows

# -- cells and row sets -------------------------------------------------------

CELL = "null boolean, empty boolean, sql boolean, text string"
NO = False


@pytest.mark.parametrize("cell,column,value", [
    ((True, NO, NO, "x"), ColumnSpec("v", "text", default="'d'"), None),
    ((NO, True, NO, ""), ColumnSpec("v", "text", default="'d'"), ""),
    ((NO, NO, True, " DEFAULT "), ColumnSpec("v", "text", default="'d'"), "d"),
    ((NO, NO, True, "now()"), ColumnSpec("v", "text", default="'d'"), None),
    ((NO, NO, NO, ""), ColumnSpec("v", "text", default="'d'"), "d"),
    ((NO, NO, NO, ""), ColumnSpec("v", "text", default=" NULL "), None),
    ((NO, NO, NO, ""), ColumnSpec("v", "int"), None),
    ((NO, NO, NO, "42"), ColumnSpec("v", "int"), 42),
    ((NO, NO, NO, "99999999999999"), ColumnSpec("v", "int"), None),
    ((NO, NO, NO, "it's"), ColumnSpec("v", "varchar(9)"), "it's"),
])
def test_resolution(spark, cell, column, value):
    df = spark.createDataFrame([(cell,)], f"v struct<{', '.join(c.replace(' ', ': ') for c in CELL.split(', '))}>")
    found = rowsets.resolve_cells(df, TableSpec("t", (column,))).first()
    assert found["v"] == value
    assert found["v_expression"] == ("now()" if cell[3] == "now()" else None)


def test_delimiters(frame):
    df = frame("line string", ("a\tb\t\\N",), ("x\t\ty",))
    assert rows(rowsets.decode_tabrows(df, "line", ["p", "q", "r"])) == [("a", "b", None), ("x", "", "y")]
    assert rows(rowsets.decode_tabrows(df, "line", ["p", "q", "r"], "\\t")) == [("a", "b", None), ("x", "", "y")]
    dots = frame("line string", ("a.b.c",))
    assert rows(rowsets.decode_tabrows(dots, "line", ["p", "q"], ".")) == [("a", "b")]


def test_declared_files(spark, tmp_path):
    (tmp_path / "rows.xml").write_text("""<definition><table name="t">
<rows columns="id, name  Note" tabrowDelimiter="|">
<row><col>1</col><col>one</col><col null="true"/></row>
<row delete="true"><col>2</col><col empty="true"/><col sql="true">default</col></row>
<row><col>3</col><col></col><col>a &lt; b</col></row>
<tabrow>4|four|\\N</tabrow>
</rows>
<rows columns="name,id"><row><col>five</col><col>5</col></row></rows>
</table></definition>""")
    spec = TableSpec("t", (ColumnSpec("id", "int"), ColumnSpec("name", "text", default="'dflt'"), ColumnSpec("note", "text", default="'n'")))
    found = rowsets.declared_table(rowsets.read_declared_rows(spark, str(tmp_path / "rows.xml")), spec)
    assert rows(found) == [
        (1, "one", None, False), (2, "", "n", True), (3, "dflt", "a < b", False), (4, "four", None, False), (5, "five", None, False),
    ]


def test_declared_files_with_a_known_header_are_split(spark, tmp_path):
    body = "\n".join(f"<row><col>{i}</col><col>n{i}</col></row>" for i in range(500))
    (tmp_path / "rows.xml").write_text(f'<rows columns="id, name">\n{body}\n</rows>')
    spec = TableSpec("t", (ColumnSpec("id", "int"), ColumnSpec("name", "text")))
    found = rowsets.read_declared_rows(spark, str(tmp_path / "rows.xml"), ["id", "name"])
    assert rows(rowsets.declared_table(found, spec)) == sorted(((i, f"n{i}", False) for i in range(500)), key=repr)


def test_rows_over_several_lines_need_no_header(spark, tmp_path):
    (tmp_path / "rows.xml").write_text('<rows columns="id">\n<row>\n<col>1</col>\n</row>\n</rows>')
    spec = TableSpec("t", (ColumnSpec("id", "int"),))
    path = str(tmp_path / "rows.xml")
    assert rows(rowsets.declared_table(rowsets.read_declared_rows(spark, path), spec)) == [(1, False)]
    assert rows(rowsets.declared_table(rowsets.read_declared_rows(spark, path, ["id"]), spec)) == [(1, False)]


def test_delimited_lines_with_a_given_header(spark, tmp_path):
    (tmp_path / "rows.xml").write_text('<rows columns="a, b">\n<row><col>1</col><col>x</col></row>\n<tabrow>2\ty</tabrow>\n<tabrow>3\t\\N</tabrow>\n</rows>')
    spec = TableSpec("t", (ColumnSpec("a", "int"), ColumnSpec("b", "text")))
    path = str(tmp_path / "rows.xml")
    want = [(1, "x", False), (2, "y", False), (3, None, False)]
    assert rows(rowsets.declared_table(rowsets.read_declared_rows(spark, path), spec)) == want
    assert rows(rowsets.declared_table(rowsets.read_declared_rows(spark, path, ["a", "b"]), spec)) == want


MARKUP = r"""<?xml version="1.0"?>
<!-- <rows columns="x"><row><col>gone</col></row></rows> -->
<definition><table name='t'><column name="col"/>
 <rows tabrowDelimiter='&#124;'
       columns='id  note, flag'>
  <row><col>1</col><col>a &lt;b&gt; &amp; "c" &#233;</col><col null="true"/>  </row><row
    delete="true"><col>2</col>
    <col empty="1"></col><col sql='true'>default</col></row>
  <row><col>3</col><col><![CDATA[<row><col>x</col> & y]]> end<!-- no
  <row> --> tail</col><col>two
lines</col></row><row/>
  <tabrow>4|n%d|\N</tabrow><!-- --><tabrow>5|<![CDATA[a<b]]>|</tabrow><tabrow/>
 </rows><rows columns="flag,id"><row><col>z</col><col>6</col></row></rows>
 <row><col>outside</col></row><rows columns="id"/><row><col>outside</col></row>
</table></definition>"""


def by_element_tree(text):
    """columns, cells and delete flag of every row, by a parser that holds the file."""
    out = []
    for element in ElementTree.fromstring(text).iter("rows"):
        header = [c for c in re.split(r"[\s,]+", element.get("columns", "").strip()) if c]
        for child in element:
            said = "".join(child.itertext())
            if child.tag == "tabrow":
                cells = [(p == "\\N", False, False, "" if p == "\\N" else p) for p in said.split(element.get("tabrowDelimiter", "\t"))]
                out.append((header, cells, False))
            else:
                marks = [[c.get(m) in ("true", "1") for m in ("null", "empty", "sql")] for c in child]
                cells = [(*m, "".join(c.itertext())) for m, c in zip(marks, child, strict=True)]
                out.append((header, cells, child.get("delete") == "true"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", ["64", "257", "128m"])
def test_files_of_any_shape_cut_anywhere(spark, tmp_path, block):
    texts = [MARKUP % 1, "<a>" + "\n".join(re.sub("<.xml.*?>", "", MARKUP % n) for n in range(3)) + "</a>"]
    for n, text in enumerate(texts):
        (tmp_path / f"{n}.xml").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        found = rowsets.read_declared_rows(spark, str(tmp_path))
        got = [(list(r["columns"]), [tuple(c) for c in r["cells"]], r["_delete"]) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got, key=repr) == sorted((r for t in texts for r in by_element_tree(t)), key=repr)


def test_one_element_is_read_by_many_tasks(spark, tmp_path):
    body = "".join(f"<row><col>{i}</col><col>n{i}</col></row><tabrow>{-i}|m</tabrow>" for i in range(1, 4000))
    (tmp_path / "rows.xml").write_text(f'<rows columns="id, name" tabrowDelimiter="|">{body}</rows>')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        spec = TableSpec("t", (ColumnSpec("id", "int"), ColumnSpec("name", "text")))
        raw = spark.read.option("lineSep", "<").text(str(tmp_path / "rows.xml"))
        assert raw.rdd.getNumPartitions() > 8
        found = rows(rowsets.declared_table(rowsets.read_declared_rows(spark, str(tmp_path / "rows.xml")), spec))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted([(i, f"n{i}", False) for i in range(1, 4000)] + [(-i, "m", False) for i in range(1, 4000)], key=repr)


def test_overlapping_sections_are_refused(spark, tmp_path):
    (tmp_path / "rows.xml").write_text('<rows columns="a"><!-- <![CDATA[ <row><col>1</col></row> --></rows>')
    with pytest.raises(Exception, match="overlap"):
        rowsets.read_declared_rows(spark, str(tmp_path / "rows.xml")).collect()


def test_alignment(frame):
    spec = TableSpec("t", (ColumnSpec("id", "bigint"), ColumnSpec("Name", "text"), ColumnSpec("x", "int")))
    found = rowsets.align_rowset(frame("NAME string, id int", ("a", 1)), spec)
    assert found.columns == ["id", "Name", "x"] and rows(found) == [(1, "a", None)]
    with pytest.raises(ValueError, match="already has"):
        rowsets.add_rowset_column(found, "name", 1)


# -- sinks --------------------------------------------------------------------


def test_statements(frame):
    old = frame("k1 int, k2 string, v string, n double", (1, "a", "x", 1.5), (2, None, "y", 2.0), (3, "c", "z", 3.0))
    new = frame("k1 int, k2 string, v string, n double", (1, "a", "it's", None), (3, "c", "z", 3.0), (4, "d", None, 4.5))
    changes = diff.change_set(old, new, ["k1", "k2"], table="s.t")
    found = {r["op"]: r["sql"] for r in sinks.render_change_sql(changes).collect()}
    assert found == {
        "U": "UPDATE s.t\nSET v = 'it''s',\n    n = NULL\nWHERE k1 = 1  AND\n  k2 = 'a';",
        "D": "DELETE FROM s.t\nWHERE k1 = 2  AND k2 IS NULL;",
        "I": "INSERT INTO s.t (k1, k2, v, n) VALUES (4, 'd', NULL, 4.5);",
    }


def test_files_hold_their_share(spark, tmp_path):
    old = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    new = spark.range(50, 400).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    changes = diff.change_set(old, new, ["k"], table="t")
    path = str(tmp_path / "out")
    sinks.write_change_set(changes, path, max_per_file=40)
    written = spark.read.parquet(path)
    assert written.count() == 350
    per_file = written.groupBy(F.input_file_name()).count()
    assert per_file.agg(F.max("count")).first()[0] <= 40
    stages = {(r["stage_dir"], r["op"]) for r in written.select("stage_dir", "op").distinct().collect()}
    assert stages == {(2, "D"), (4, "I")}
    files = sorted(sinks.written_files(spark, path).collect(), key=lambda r: (r["stage"], r["file"]))
    assert {s: sum(r["n"] for r in files if r["stage"] == s) for s in (2, 4)} == {2: 50, 4: 300}
    assert all(r["n"] <= 40 and r["out_of_order"] == 0 for r in files)
    for a, b in zip(files, files[1:]):
        assert a["stage"] < b["stage"] or a["last_key"] < b["first_key"]
    whole = str(tmp_path / "whole")
    sinks.write_change_set(changes, whole, partitions=1)
    assert sinks.written_files(spark, whole).count() == 2
    only = str(tmp_path / "only")
    sinks.write_change_set(changes, only, kinds=("D",), single_stage=True)
    assert rows(spark.read.parquet(only).groupBy("stage_dir", "op").count()) == [(0, "D", 50)]


# -- text ---------------------------------------------------------------------


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("literal,items", [
    ("{}", []), ("{a}", ["a"]), ("{a,b}", ["a", "b"]), ('{a,"b,c"}', ["a", "b,c"]), ('{"x\\"y",z}', ['x"y', "z"]),
    ('{"a\\\\b"}', ["a\\b"]), ("{a,,b}", ["a", "", "b"]),
])
def test_array_literals(spark, literal, items):
    assert one(spark, text.parse_array_literal(F.lit(literal))) == items


def test_text_helpers(spark):
    assert one(spark, text.split_names(F.lit(" a, b  c"))) == ["a", "b", "c"]
    assert one(spark, text.first_non_blank(F.lit(None).cast("string"), F.lit(""), F.lit("x"))) == "x"
    assert one(spark, text.join_non_blank(",", F.lit("a"), F.lit(""), F.lit("b"))) == "a,b"
    assert one(spark, text.name_schema(F.lit("s.t.u"))) == "s" and one(spark, text.name_object(F.lit("s.t.u"))) == "t.u"
    assert one(spark, text.name_schema(F.lit("t"))) == "public"
    assert one(spark, text.zero_pad(F.lit(3), 12)) == "03"
    assert one(spark, text.is_truthy(F.lit("YES"))) and not one(spark, text.is_truthy(F.lit("maybe")))
    assert one(spark, text.is_falsey(F.lit("No"))) and not one(spark, text.is_falsey(F.lit(None).cast("string")))
    assert one(spark, text.encode_pairs(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))) == "a=1,b=2"
    assert one(spark, text.normalise_check(F.lit(" check ( a > 1 ) "))) == "a > 1"
    assert one(spark, text.same_strings_any_order(F.array(F.lit("a"), F.lit("B")), F.array(F.lit("b"), F.lit("A"))))
    assert one(spark, text.contains_ci(F.lit("nextVAL(x)"), "NEXTval")) and one(spark, text.starts_with_ci(F.lit("Abc"), "aB"))
    assert one(spark, text.same_ci(F.lit(None).cast("string"), F.lit(None).cast("string")))


def test_declared_types():
    assert [spark_type(t) for t in ("bigserial", "character varying(5)", "numeric(10,2)", "text[]", "double precision")] == [
        "bigint", "string", "decimal(10,2)", "array<string>", "double",
    ]
    assert length_limit("varchar(20)") == 20 and length_limit("text") is None


@pytest.mark.parametrize("a,b", [
    ("@ 2 hours 30 minutes", "02:30:00"), ("1 day 02:00", "26 hours"), ("@ 1 mon", "30 days"), ("1 year", "12 months"),
    ("@ 5 mins ago", "-00:05:00"), ("1.5 hours", "90 m"), ("00:00:01.5", "1500 ms"),
])
def test_intervals(spark, a, b):
    assert one(spark, interval_microseconds(F.lit(a))) == one(spark, interval_microseconds(F.lit(b)))


def test_unreadable_intervals(spark):
    for words in ("", "soon", "5 parsecs"):
        assert one(spark, interval_microseconds(F.lit(words))) is None


# -- verification -------------------------------------------------------------


@pytest.mark.parametrize("declared,live,kind,equal", [
    ("t", "true", "boolean", True), ("no", "false", "bool", True), ("T", "f", "boolean", False),
    ("2024-01-02", "2024-01-02 00:00:00", "timestamp", True), ("2024-01-02", "", "timestamp", False),
    ("2 hours", "02:00:00", "interval", True), ("08:00", "08:00:00", "time", True), ("1.0", "1", "numeric", False),
    (None, "", "text", True), ("x", "X", "text", False),
])
def test_values_agree_by_type(spark, declared, live, kind, equal):
    found = one(spark, verify.typed_compare(F.lit(declared).cast("string"), F.lit(live).cast("string"), kind))
    assert found is equal


def test_a_live_key_with_many_copies_is_one_verdict(spark, frame):
    live = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).cast("int").alias("k"), F.lit("x").alias("v"))
    declared = frame("k int, v string, _delete boolean", (7, "x", False), (2000, "x", False), (2001, "y", None), (9999, "x", False), (2002, "x", True), (9998, "x", True))
    assert rows(verify.verify_rows(declared, live, ["k"])) == [
        (2000, "match", 1), (2001, "mismatch", 1), (2002, "tombstone_present", 1), (7, "duplicate", 1000),
        (9998, "match", 0), (9999, "missing", 0),
    ]
    assert rows(verify.verify_cells(declared, live, ["k"])) == [(2001, "v", "y", "x")]


def test_missing_live_columns(frame):
    with pytest.raises(ValueError, match="has no columns"):
        verify.verify_rows(frame("k int, v int", (1, 1)), frame("k int", (1,)), ["k"])


# -- grants -------------------------------------------------------------------


def test_access_lists(frame):
    df = frame("o string, acl string", ("s", "boss=UC/boss\n=U/boss\nnobody"), ("q", '{"a b=rw/boss",c=q/boss}'))
    assert rows(grants.explode_acl(df, ["o"], "acl")) == [
        ("q", "a b", "SELECT", None), ("q", "a b", "UPDATE", None), ("q", "c", None, "unknown code q"),
        ("s", "boss", "CREATE", None), ("s", "boss", "USAGE", None), ("s", "public", "USAGE", None),
    ]


def test_unknown_permissions_are_not_gathered(frame):
    granted = frame("o string, grantee string, permission string, grantable boolean", ("t", "a", "JUGGLE", False))
    found = grants.effective_permissions(granted, frame("o string, owner string", ("t", "x")), ["o"])
    assert rows(found, "grantee", "permissions") == [("a", [])]
    assert rows(grants.unknown_permissions(granted, ["o"])) == [("t", "a", "JUGGLE", "unknown permission JUGGLE")]
    letters = grants.explode_acl(frame("o string, acl string", ("t", "a=rm/boss")), ["o"], "acl").withColumn("grantable", F.lit(False))
    assert rows(grants.effective_permissions(letters, frame("o string, owner string"), ["o"]), "permissions") == [(["SELECT"],)]
    assert rows(grants.unknown_permissions(letters, ["o"]), "error") == [("unknown code m",)]


def test_only_grantees_are_read_only(frame):
    owners = frame("db int, role string", (1, "x_ro"), (1, "X_RO"), (1, "y"), (1, "pg_monitor"))
    given = frame("db int, role string", (1, "r_readonly"), (1, "b"), (1, "a"))
    assert rows(grants.infer_roles(owners, given, ["db"])) == [
        (1, "application", "a"), (1, "custom", "b"), (1, "custom", "y"), (1, "owner", "x_ro"), (1, "read_only", "r_readonly"),
    ]


def test_grant_options_are_kept(frame):
    schema = "o string, role string, permission string, grantable boolean"
    target = frame(schema, ("t", "A", "select", True), ("t", "b", "SELECT", False), ("t", "c", "ODD", False))
    have = frame(schema, ("t", "a", "SELECT", False), ("t", "B", "select", True))
    assert rows(grants.missing_grants(target, have, ["o"])) == [("t", "a", "GRANT OPTION")]
    assert rows(grants.incomparable_grants(target, ["o"])) == [("t", "c", "ODD", "not compared: ODD")]


# -- feeds --------------------------------------------------------------------


def feed(spark, path):
    return spark.readStream.schema("k int, v string, op string, seq long").option("maxFilesPerTrigger", 1).parquet(path)


def put(frame, path, *changes):
    frame("k int, v string, op string, seq long", *changes).coalesce(1).write.mode("append").parquet(path)


def test_feed_keeps_the_last_change_whatever_the_order(spark, frame, tmp_path):
    source, state, progress = (str(tmp_path / n) for n in ("in", "state", "progress"))
    put(frame, source, (1, "a", "I", 1), (2, "b", "I", 2), (1, "c", "U", 9))
    feeds.run_available(feeds.stream_apply_changes(feed(spark, source), state, progress, ["k"]))
    put(frame, source, (1, "late", "U", 5), (2, None, "D", 10), (3, "n", "I", 11))
    feeds.run_available(feeds.stream_apply_changes(feed(spark, source), state, progress, ["k"]))
    base = frame("k int, v string", (1, "old"), (8, "kept"))
    expected = [(1, "c", 9), (3, "n", 11), (8, "kept", None)]
    assert rows(feeds.current_state(spark, state, ["k"], base=base), "k", "v", "seq") == expected
    # The same batches again, as after a lost progress file: nothing changes.
    feeds.run_available(feeds.stream_apply_changes(feed(spark, source), state, str(tmp_path / "again"), ["k"]))
    assert rows(feeds.current_state(spark, state, ["k"], base=base), "k", "v", "seq") == expected


def test_compaction_remembers_deletes(spark, frame, tmp_path):
    source, state, progress, packed = (str(tmp_path / n) for n in ("in", "state", "progress", "packed"))
    put(frame, source, (1, "a", "I", 1), (2, "b", "I", 2), (2, None, "D", 7))
    feeds.run_available(feeds.stream_apply_changes(feed(spark, source), state, progress, ["k"]))
    held = feeds.compact(spark, state, packed, ["k"])
    assert list(held.values()) == [0]
    put(frame, source, (2, "late", "U", 5), (1, "new", "U", 8))
    feeds.run_available(feeds.stream_apply_changes(feed(spark, source), state, progress, ["k"]))
    found = feeds.current_state(spark, state, ["k"], base=spark.read.parquet(packed), after=held)
    assert rows(found, "k", "v") == [(1, "new")]


def test_a_base_retires_its_log(spark, frame, tmp_path):
    source, state, progress, packed = (str(tmp_path / n) for n in ("in", "state", "progress", "packed"))
    put(frame, source, (1, "a", "I", 1), (1, "b", "U", 1), (2, "b", "I", 2))
    feeds.run_available(feeds.stream_apply_changes(feed(spark, source), state, progress, ["k"]))
    held = feeds.compact(spark, state, packed, ["k"])
    put(frame, source, (3, "c", "I", 3))
    feeds.run_available(feeds.stream_apply_changes(feed(spark, source), state, progress, ["k"]))
    assert feeds.retire(spark, state, held) == 1 and feeds.retire(spark, state, held) == 0
    found = feeds.current_state(spark, state, ["k"], base=spark.read.parquet(packed), after=held)
    assert rows(found, "k", "v") == [(1, "b"), (2, "b"), (3, "c")]  # of equal numbers the greatest row


def test_literals_without_digits(frame):
    df = frame("d double, b binary", (float("nan"), b"\x00\xff"), (float("-inf"), b""), (1.5, None))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    found = df.select(*[sinks.literal(F.col(c), kinds[c]).alias(c) for c in kinds])
    assert [tuple(r) for r in found.collect()] == [("'NaN'", r"'\x00ff'"), ("'-Infinity'", r"'\x'"), ("1.5", "NULL")]


def test_two_feeds_into_one_state_lose_nothing(spark, frame, tmp_path):
    state = str(tmp_path / "state")
    base = frame("k int, v string", (7, "base"))
    assert rows(feeds.current_state(spark, state, ["k"], base=base), "k", "v") == [(7, "base")]
    with pytest.raises(ValueError, match="no changes yet"):
        feeds.current_state(spark, state, ["k"])
    for name, changes in (("one", [(1, "a", "I", 1), (2, "b", "I", 2)]), ("two", [(3, "c", "I", 3), (2, "late", "U", 1)])):
        put(frame, str(tmp_path / name), *changes)
        writer = feeds.stream_apply_changes(feed(spark, str(tmp_path / name)), state, str(tmp_path / f"progress-{name}"), ["k"])
        feeds.run_available(writer)
    expected = [(1, "a"), (2, "b"), (3, "c"), (7, "base")]
    found = feeds.current_state(spark, state, ["k"], base=base)
    assert rows(found, "k", "v") == expected
    assert len(feeds.positions(spark, state)) == 2


def test_reading_a_state_does_not_fold_its_base(spark, frame, tmp_path):
    source, state, path = (str(tmp_path / n) for n in ("in", "state", "base"))
    put(frame, source, (1, "a", "I", 1))
    feeds.run_available(feeds.stream_apply_changes(feed(spark, source), state, str(tmp_path / "progress"), ["k"]))
    spark.range(1000).selectExpr("CAST(id AS int) AS k", "'x' AS v").write.parquet(path)
    plan = plan_of(feeds.current_state(spark, state, ["k"], base=spark.read.parquet(path)))
    above = [part for part in plan.split("\n") if "Aggregate" in part]
    # Two references to the folded log, each partial and final: none over the base.
    assert len(above) <= 6 and "SortMergeJoin" not in plan


def test_violations_of_a_table_and_of_a_stream_agree(spark, frame, tmp_path):
    rules = dict(
        not_null=("v",), checks=(CheckSpec("low", "seq < 3"),), enums={"op": EnumSpec("ops", ("I", "U"))},
        foreign_keys=((ForeignKeySpec(("k",), "p", ("id",), "fk"), frame("id int", (1,), (1,))),),
    )
    data = [(1, "a", "I", 1), (1, None, "D", 5), (2, "b", "U", 2), (None, "c", "U", 2)]
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    put(frame, source, *data)
    feeds.run_available(feeds.stream_constraint_check(feed(spark, source), out, progress, **rules))
    expected = [(1, "low"), (1, "ops"), (1, "v_not_null"), (2, "fk")]
    assert rows(spark.read.parquet(out), "k", "constraint_name") == expected
    table = frame("k int, v string, op string, seq long", *data)
    assert rows(feeds.constraint_violations(table, **rules), "k", "constraint_name") == expected
