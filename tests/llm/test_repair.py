"""Conversation repair against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowtide.llm import queries, repair
from tests.conftest import SMALL


def cheapest(rows):
    """(cost, letters) of rows (initial, must go, cut off), by plain dynamic programming over whole strings."""
    follow = {0: 2, 1: 2, 2: 3, 3: 2}
    best = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    for initial, gone, cut in reversed(rows):
        new = []
        for state in range(4):
            ways = [(3 + best[state][0], "D" + best[state][1])]
            if not gone:
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))
                if to is not None:
                    ways.append((cut + best[to][0], "K" + best[to][1]))
                ways.append((2 + cut + best[follow[state]][0], "R" + best[follow[state]][1]))
            new.append(min(ways))
        for _ in range(4):
            new = [min(new[q], (2 + new[follow[q]][0], "I" + new[follow[q]][1])) for q in range(4)]
        best = new
    return best[0]


def by_hand(rows):
    """Report of one conversation from its rows (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    seen, marks = set(), []
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        marks.append(fault)
    initials = [role[:1] for _, role, _ in rows]
    cost, audit = cheapest([(i, m in ("blank", "duplicate"), m == "truncated") for i, m in zip(initials, marks, strict=True)])
    out, left = [], list(rows)
    for letter in audit:
        role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            out.append((role, ""))
            continue
        _, own, text = left.pop(0)
        if letter != "D":
            out.append((own if letter == "K" else role, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and not left
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{f: marks.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    }


def ordered(rows):
    """Rows (turn, role, text) of a conversation by turn, nulls first."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


SYMBOLS = st.lists(st.integers(0, 8), max_size=30)


@given(SYMBOLS, st.integers(1, 5), st.integers(0, 30))
@settings(max_examples=500, deadline=None)
def test_tables_and_segments(symbols, block, cut):
    table = repair.tables(block)
    whole = np.array(symbols, np.uint8)
    want = cheapest([("suax"[(s - 1) // 2], s == 0, (s - 1) % 2 if s else 0) for s in symbols])
    to, cost = table.function(whole)
    assert (int(cost[0]) + table.vectors[to[0]][0], table.trace(whole, 0, [0], True)[0][1]) == want
    # the same through two segments
    a, b = whole[:cut], whole[cut:]
    middle, right = (x[0] for x in table.function(b))
    to, left = (x[middle] for x in table.function(a))
    state, first = table.trace(a, middle, [0], False)[0]
    second = {q: w[1] for q, w in zip(range(4), table.trace(b, 0, [0, 1, 2, 3], True), strict=True)}[state]
    assert (int(left) + int(right) + table.vectors[to][0], first + second) == want


def test_few_vectors():
    table = repair.tables()
    assert len(table.vectors) < 40 and all(min(v) == 0 for v in table.vectors)


def reports(df, **settings):
    return {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in repair.repair_report(df, **settings).collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment", [3, 4096])
def test_random_conversations(spark, segment):
    rng = random.Random(segment)
    rows = []
    for conv in range(60):
        turn = 0
        for _ in range(rng.choice([1, 2, 5, 8, 40])):
            turn += rng.choice([1, 1, 1, 2, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u"])
            rows.append((conv, turn, role, rng.choice(["Yes.", "no", " ", "\t\n", "What? ", "ok!\n", "", "so. ", "1", "2."])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = reports(df, segment=segment)
    assert got == {c: by_hand(ordered([r[1:] for r in rows if r[0] == c])) for c in range(60)}


def test_one_long_conversation(spark):
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "again.", " "])) for t in range(9000)]
    rows += [(c, 0, "user", "hi.") for c in range(2, 9)]
    got = reports(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got[1] == by_hand([r[1:] for r in rows if r[0] == 1])
    assert got[5] == by_hand([(0, "user", "hi.")])


def test_edge_rows(spark):
    long = "word " * 100_000
    rows = [
        (None, None, None, None),
        (None, 3, "user", "a."),
        (1, None, "user", "x."),
        (1, None, "user", "x."),
        (1, 9, "user", "x."),
        (2, 5, "system", long),
        (2, 5, "system", long),
        (3, None, "assistant", None),
        (3, None, None, "y"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", COST int")
    got = reports(df)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in (None, 1, 2):
        assert got[conv] == by_hand([r[1:] for r in plain if r[0] == conv])
    assert {got[3]["cost"], got[3]["gaps"]} <= {0, 3, 5, 6}
    assert reports(df.where("conv_id > 99")) == {}


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 3, "assistant", " "), (2, 0, "assistant", "c."), (3, 0, "assistant", "")]
    own = repair.lines(spark.createDataFrame(rows, SCHEMA), "conv_id", "turn", "role", "text")
    found = repair.report(own)
    got = sorted(tuple(r) for r in repair.repaired(own, found).collect())
    want = []
    for conv in (1, 2, 3):
        _, audit = cheapest([(r[2][:1], not r[3].strip(), 0) for r in rows if r[0] == conv])
        assert next(r.audit for r in found.collect() if r.conv == conv) == audit
        want += [(conv, i) for i in range(len(audit) - audit.count("D"))]
    assert [g[:2] for g in got] == want
    assert [g[2][:1] for g in got if g[0] == 1] == ["u", "a"] * (sum(g[0] == 1 for g in got) // 2)


@pytest.mark.parametrize("sf", [SMALL, "/root/testdata/sf0.01"])
def test_query(spark, sf):
    convs = {}
    for r in queries.table(spark, sf, "conversations").collect():
        role, text = (" " if x is None else x for x in (r.role, r.text))
        kept = convs.setdefault(r.conv_id, [])
        harm = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        kept += [(r.turn, "user" if harm == 4 else role, text)] * (1 + (harm == 3))
    got = {r["conv_id"]: r.asDict() for r in queries.QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert len(got) == len(convs)
    for conv, rows in convs.items():
        assert got[conv] == {"conv_id": conv, **by_hand(ordered(rows))}
