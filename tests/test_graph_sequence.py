import random

import pytest
from pyspark.sql import functions as F

from rowtide import ColumnSpec, PartitionSpec, SequenceSpec, TableSpec
from rowtide.functions.lexing import _tokens, statement_tables
from rowtide.operators import graph, inheritance, partitions, sequences
from rowtide.operators.inheritance import inherited_columns
from tests.conftest import plan_of, rows

EDGES = "grp int, child int, parent int"
NODES = "grp int, node int"


def levels(nodes, edges):
    return {(r["grp"], r["node"]): r["level"] for r in graph.dependency_levels(nodes, edges, ["grp"], "node").collect()}


def brute_levels(nodes, edges):
    """Peel level by level; what is left gets None."""
    found, level = {}, 0
    todo = set(nodes) | {(g, x) for g, c, p in edges for x in (c, p)}
    needs = {n: {(g, p) for g, c, p in edges if (g, c) == n and c != p} for n in todo}
    while True:
        ready = {n for n in todo if needs[n] <= set(found)}
        if not ready:
            return {**found, **{n: None for n in todo}}
        found.update({n: level for n in ready})
        todo -= ready
        level += 1


def test_the_documented_graph(frame):
    a, b, c, d, e, f, g = range(7)
    edges = [(1, a, b), (1, b, c), (1, b, g), (1, d, b), (1, d, f), (1, e, f), (1, f, g)]
    found = levels(frame(NODES, *[(1, n) for n in range(7)]), frame(EDGES, *edges))
    assert {n: l for (_, n), l in found.items()} == {a: 2, b: 1, c: 0, d: 2, e: 2, f: 1, g: 0}


def test_a_deep_chain_takes_few_rounds(spark):
    nodes = spark.range(1000).select(F.lit(1).alias("grp"), F.col("id").alias("node"))
    edges = spark.range(1, 1000).select(F.lit(1).alias("grp"), F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    found = graph.dependency_levels(nodes, edges, ["grp"], "node")
    assert found.filter("level = node").count() == 1000


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_graphs(frame, seed):
    rng = random.Random(seed)
    nodes = [(g, n) for g in (1, 2) for n in range(9)]
    # Mostly downwards; a few edges that may close a cycle or refer to their own node.
    edges = [(g, c, rng.randrange(c)) for g, c in nodes if c for _ in range(rng.choice([0, 1, 1, 2]))]
    edges += [(rng.choice([1, 2]), rng.randrange(9), rng.randrange(9)) for _ in range(seed * 2)]
    assert levels(frame(NODES, *nodes), frame(EDGES, *edges)) == brute_levels(nodes, edges)


def test_cycles_and_what_stands_on_them(frame):
    edges = frame(EDGES, (1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 4, 4), (1, 5, 4), (2, 1, 0))
    nodes = frame(NODES, *[(1, n) for n in range(1, 6)])
    assert rows(graph.dependency_cycles(nodes, edges, ["grp"], "node"), "grp", "node", "reason") == [
        (1, 1, "cycle"), (1, 2, "cycle"), (1, 3, "cycle"), (1, 4, "self"),
    ]


def test_no_edges_at_all(frame):
    assert levels(frame(NODES, (1, 1), (2, 1)), frame(EDGES)) == {(1, 1): 0, (2, 1): 0}


def test_driver_side_order():
    assert graph.dependency_order({"c": {"b"}, "b": {"a"}, "a": set()}) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        graph.dependency_order({"a": {"b"}, "b": {"a"}})


def test_pointers_that_never_end(frame):
    links = frame("node int, target int", (1, 2), (2, 1), (3, 4), (4, 5))
    assert rows(graph.follow_pointers(links, [], "node", "target"), "node", "last", "steps") == [
        (1, None, None), (2, None, None), (3, 5, 2), (4, 5, 1),
    ]


def test_foreign_key_to_an_inherited_column(frame):
    # footoo refers to child.foo, which the child has from its parent.
    own = frame("db int, table_name string, column_name string, data_type string",
                (1, "parent", "foo", "int"), (1, "child", "bar", "text"), (1, "baz", "footoo", None))
    parents = frame("db int, table_name string, parent string", (1, "child", "parent"))
    found = inheritance.inherited_columns(own, parents, ["db"], "table_name", "parent")
    assert rows(found.filter("table_name = 'child'"), "column_name", "defined_in", "depth") == [
        ("bar", "child", 0), ("foo", "parent", 1),
    ]
    columns = frame("db int, column_id string, data_type string, references_id string",
                    (1, "baz.footoo", None, "child.foo"), (1, "child.foo", "serial", None), (1, "x", None, "nowhere"))
    assert rows(graph.terminal_reference(columns, ["db"]), "column_id", "terminal_id", "resolved_type") == [
        ("baz.footoo", "child.foo", "int"), ("child.foo", "child.foo", "serial"), ("x", "nowhere", None),
    ]


def test_parents_in_a_circle(frame):
    columns = frame("t int, column_name string", (1, "a"), (2, "b"), (3, "c"))
    with pytest.raises(ValueError, match="cycle"):
        inherited_columns(columns, frame("t int, p int", (3, 1), (1, 2), (2, 1)), [], "t", "p")


def test_a_forest_of_1500_levels_has_no_cycle(spark, frame):
    parents = spark.range(1, 1500).select(F.col("id").alias("t"), (F.col("id") - 1).alias("p"))
    columns = frame("t long, column_name string, kind string", (0, "A", "root"), (0, "b", "root"), (700, "a", "middle"))
    found = inherited_columns(columns, parents, [], "t", "p")
    assert found.count() == 3000
    deep = rows(found.filter("t = 1499"), "column_name", "kind", "defined_in", "depth")
    assert deep == [("a", "middle", 700, 799), ("b", "root", 0, 1499)]


def checkpoints(monkeypatch):
    """Counts the rounds, two checkpoints each."""
    made, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: made.append(1) or cut(df))
    return made


def levels_by_hand(edges):
    """Level of each node, None on or above a circle."""
    asks, out = {}, {}
    for child, parent in edges:
        asks.setdefault(child, set()).update({parent} - {child})
        asks.setdefault(parent, set())
    while ready := [n for n in asks if n not in out and all(p in out for p in asks[n])]:
        out.update({n: 1 + max((out[p] for p in asks[n]), default=-1) for n in ready})
    return {n: out.get(n) for n in asks}


DEEP = {
    "tree": [(i, i - 1) for i in range(1, 2000)] + [(10_000 + i, i * 7 % 2000) for i in range(1500)],
    "caterpillar": [(i, i - 1) for i in range(1, 2000)] + [(i, 10_000 + i) for i in range(2000)] + [(10_000 + i, 20_000 + i) for i in range(0, 2000, 3)],
    "turned": [(i - 1, i) for i in range(1, 2000)] + [(i * 7 % 2000, 10_000 + i) for i in range(1500)],
}


@pytest.mark.parametrize("shape", DEEP)
def test_deep_graphs_take_few_rounds(frame, monkeypatch, shape):
    made = checkpoints(monkeypatch)
    found = graph.dependency_levels(frame("n int", (0,)), frame("child int, parent int", *DEEP[shape]), [], "n")
    assert {r["n"]: r["level"] for r in found.collect()} == levels_by_hand(DEEP[shape])
    assert len(made) / 2 <= 15


def test_random_graphs_against_a_plain_version(frame):
    rng = random.Random(11)
    edges = []
    for grp in range(120):
        size = rng.choice([2, 5, 12, 30])
        for _ in range(rng.choice([size // 2, size, 2 * size])):
            child, parent = rng.randrange(size), rng.randrange(size)
            edges.append((grp, child, parent) if rng.random() < 0.1 else (grp, max(child, parent), min(child, parent)))
    found = graph.dependency_levels(frame(NODES), frame(EDGES, *edges), ["grp"], "node")
    want = {(g, n): level for g in {e[0] for e in edges} for n, level in levels_by_hand([e[1:] for e in edges if e[0] == g]).items()}
    assert {(r["grp"], r["node"]): r["level"] for r in found.collect()} == want


def ladder(height, grp=0):
    """Each node depends on the two below it, so nothing can be folded."""
    return [(grp, i, i - d) for i in range(1, height) for d in (1, 2) if i >= d]


def test_levels_of_a_ladder_and_of_many_graphs(spark, frame):
    edges = ladder(60, 0) + [e for g in range(1, 300) for e in ladder(3 + g % 6, g)]
    edges += [(300, 1, 2), (300, 2, 1), (300, 3, 1), (300, 3, 0), (300, 4, 0), (300, 4, 0), (300, 5, 5)]
    links = frame("grp int, child int, parent int", *edges)
    nodes = links.select("grp", F.col("child").alias("n"))
    found = {(r["grp"], r["n"]): r["level"] for r in graph.dependency_levels(nodes, links, ["grp"], "n").collect()}
    assert all(found[g, n] == n for g, n in found if g < 300)
    assert [found[300, n] for n in range(6)] == [0, None, None, None, 1, 0]


def test_a_hub_that_everything_points_to(spark):
    links = spark.range(1, 20_001).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") - 1).alias("t"))
    links = links.filter("n > 1")
    ends = graph.follow_pointers(links, [], "n", "t")
    assert ends.count() == 19_999 and rows(ends.select("last").distinct()) == [(1,)]


@pytest.mark.parametrize("text,table", [
    ("UPDATE only_things SET a = 1", "public.only_things"),
    ("update ONLY x.t set a = 1", "x.t"),
    ("SELECT a\n  FROM x.t1\n WHERE b IN (SELECT c FROM y.t2)", "x.t1"),
    ("DELETE FROM only s.t", "s.t"),
    ("DELETE FROM onlytable", "public.onlytable"),
    ('INSERT INTO "S"."T" VALUES (1)', "S.T"),
    ("CALL nothing()", None),
])
def test_statement_forms(frame, text, table):
    found = graph.statement_lineage(frame("s string", (text,)), "s").first()
    assert (found["table_schema"] and f"{found['table_schema']}.{found['table_name']}") == table


STATEMENTS = [
    ("SELECT extract(year FROM d) FROM t", "r:t"),
    ("SELECT trim(both ' ' FROM name), substring(a from 2) FROM s.t2", "r:s.t2"),
    ("SELECT a IS NOT DISTINCT FROM b, c is distinct from d FROM t3", "r:t3"),
    ("/* SELECT * FROM no */ SELECT 'x FROM no', $$ from no $$, $q$ from $$ no $q$ -- from no\n FROM t, u v, w", "r:t r:u r:w"),
    ("SELECT * FROM a LEFT JOIN b.c ON a.x = c.x, d JOIN LATERAL f(1) ON true JOIN e USING (x, y)", "r:a r:b.c r:d r:e"),
    ("SELECT * FROM (SELECT 1 FROM a, b) x, c WHERE y IN (SELECT z FROM d) GROUP BY p, q", "r:a r:b r:c r:d"),
    ("WITH w AS (SELECT * FROM w), v(a, b) AS NOT MATERIALIZED (SELECT 1 FROM w, t) SELECT * FROM v, u", "r:w r:t r:u"),
    ("WITH RECURSIVE w AS (SELECT 1 FROM a UNION SELECT 2 FROM w, b) INSERT INTO c SELECT * FROM w", "r:a r:b w:c"),
    ("SELECT cast(a AS timestamp WITH time zone) FROM t", "r:t"),
    ("INSERT INTO log.t1 (a, b) SELECT c, d FROM live RETURNING a, b", "w:log.t1 r:live"),
    ("INSERT INTO t VALUES (1, 'it''s from x') ON CONFLICT (a) DO UPDATE SET b = excluded.b", "w:t"),
    ("UPDATE ONLY a.b x SET c = y.d, e = 1 FROM y WHERE x.i = y.i", "w:a.b r:y"),
    ("DELETE FROM ONLY t USING u, v WHERE a = b", "w:t r:u r:v"),
    ("MERGE INTO t USING (SELECT 1 FROM s) q ON t.i = q.i WHEN MATCHED THEN UPDATE SET a = 1 WHEN NOT MATCHED THEN INSERT VALUES (1)", "w:t r:s"),
    ("TRUNCATE TABLE ONLY a.t", "w:a.t"),
    ('SELECT * FROM "My Schema" . "T.x" FOR UPDATE OF t', "r:My Schema.T.x"),
    ("SELECT a FROM generate_series(1, 3), lateral unnest(x), t", "r:t"),
    ("BEGIN FOR r IN SELECT * FROM t LOOP UPDATE u SET a = r.a; END LOOP; DELETE FROM v; END", "r:t w:u w:v"),
    ("EXECUTE 'x' USING a, b", ""),
    ("SELECT E'it\\' FROM no' FROM t", "r:t"),
    ("SELECT 'open FROM t", ""),
    ("", ""),
    (None, ""),
]


def test_all_tables_of_statements(frame):
    df = frame("n int, s string", *[(n, s) for n, (s, _) in enumerate(STATEMENTS)])
    found = df.select("n", statement_tables(F.col("s")).alias("t")).collect()
    got = {r["n"]: " ".join(f"{'r' if t['via'] in ('from', 'join', 'using') else 'w'}:{t['name']}" for t in r["t"] or []) for r in found}
    assert [(s, got[n]) for n, (s, _) in enumerate(STATEMENTS)] == STATEMENTS


def plain_tokens(text):
    """Tokens without comments and strings, character by character."""
    out, i = [], 0
    while i < len(text):
        c, end = text[i], i + 1
        if text.startswith("--", i):
            i = (text + "\n").index("\n", i)
            continue
        if text.startswith("/*", i):
            i = (text + "*/").index("*/", i + 2) + 2
            continue
        if c == "'":
            i = (text + "'").index("'", i + 1) + 1
            continue
        if c == '"':
            end = (text + '"').index('"', i + 1) + 1
        elif c.isalpha() or c == "_":
            while end < len(text) and (text[end].isalnum() or text[end] in "_$"):
                end += 1
        if not c.isspace():
            out.append(text[i:end])
        i = end
    return out


def test_tokens_against_a_plain_lexer(frame):
    rng = random.Random(8)
    parts = ["a", "From", "_x1", " ", "\n", "'", '"', "--", "/*", "*/", ",", "(", ".", "é", "-", "/"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    df = frame("n int, s string", *enumerate(texts))
    got = {r["n"]: r["t"] for r in df.select("n", _tokens(F.col("s")).alias("t")).collect()}
    assert [got[n] for n in range(len(texts))] == [plain_tokens(t) for t in texts]


def test_renames_reach_all_forms_of_references(frame):
    texts = [
        ("a", None, None, "FOREIGN KEY (x) REFERENCES public.t (id) ON DELETE CASCADE"),
        ("b", None, None, "FOREIGN KEY (x) REFERENCES t(id)"),
        ("c", None, None, 'foreign key (x)\nreferences "Public" . "T"'),
        ("d", "public", "T", None),
        ("e", None, None, "FOREIGN KEY (x) REFERENCES other.t (id)"),
        ("f", None, None, "something else"),
        ("g", None, None, None),
    ]
    constraints = frame("constraint_name string, ref_schema string, ref_table string, definition string", *texts)
    renames = frame("schema_name string, table_name string", ("public", "t"))
    assert [r[0] for r in rows(graph.affected_by_rename(constraints, renames, []), "constraint_name")] == list("abcd")
    told = rows(graph.affected_by_rename(constraints, renames, [], reason="why"), "constraint_name", "why")
    assert told[4:] == [("f", "unreadable"), ("g", "unreadable")] and len(told) == 6


# -- sequences ----------------------------------------------------------------


def test_serial_is_dense_and_in_order(spark):
    df = spark.range(5000).select(F.col("id"), F.pmod(F.hash("id"), F.lit(97)).alias("v"))
    found = sequences.assign_serial(df, ["v", "id"], start=10, step=2).collect()
    assert [r["serial"] for r in sorted(found, key=lambda r: (r["v"], r["id"]))] == list(range(10, 10010, 2))


def test_serial_of_nothing(frame):
    assert sequences.assign_serial(frame("a int"), ["a"]).collect() == []


def calls(spec, n):
    value, out = spec.start, []
    for _ in range(n):
        out.append(value)
        if value is None:
            continue
        value += spec.increment
        if not spec.minimum <= value <= spec.maximum:
            value = (spec.minimum if spec.increment > 0 else spec.maximum) if spec.cycle else None
    return out


@pytest.mark.parametrize("spec", [
    SequenceSpec(5, 3, 2, 50, True), SequenceSpec(5, 3, 2, 50), SequenceSpec(10, -4, 2, 20, True),
    SequenceSpec(10, -4, 2, 20), SequenceSpec(1, 100, 1, 50, True), SequenceSpec(-5, 1, -5, 5, True),
])
def test_sequence_values(spark, spec):
    df = spark.range(1, 61).withColumnRenamed("id", "n")
    found = sequences.sequence_values(df, "n", spec).orderBy("n").collect()
    assert [r["value"] for r in found] == calls(spec, 60)
    assert [r["exhausted"] for r in found] == [v is None for v in calls(spec, 60)]


def test_sequence_bounds(spark):
    with pytest.raises(ValueError):
        sequences.sequence_value(F.lit(1), SequenceSpec(5, 1, 10, 20))


def test_sequence_position_leaves_out_what_has_none(frame):
    specs = {"a": TableSpec("a", (ColumnSpec("id", "serial"),), ("id",)),
             "b": TableSpec("b", (ColumnSpec("id", "int"),), ("id",)),
             "c": TableSpec("c", (ColumnSpec("id", "bigserial", serial_start=5),), ("id",))}
    df = frame("id int", (3,), (7,))
    assert rows(sequences.sequence_position({n: df for n in specs}, specs)) == [("a", "id", 7)]


# -- partitions ---------------------------------------------------------------


def test_partition_names(frame):
    df = frame("k bigint", (0,), (-1,), (15,), (None,))
    assert rows(partitions.modulo_partition(df, PartitionSpec("k", 8))) == [
        (-1, "partition_7"), (0, "partition_0"), (15, "partition_7"), (None, "unroutable"),
    ]
    assert rows(partitions.modulo_partition(df, PartitionSpec("k", 12)), "part")[0] == ("partition_00",)


def test_reading_one_partition_touches_its_folder_only(spark, tmp_path):
    spec, path = PartitionSpec("id", 8), str(tmp_path / "p")
    partitions.write_partitioned(spark.range(200), spec, path)
    found = partitions.read_partition(spark, path, spec, 21)
    assert rows(found, "id", "part") == [(21, "partition_5")]
    assert "PartitionFilters: [isnotnull(part" in plan_of(found, "formatted")
