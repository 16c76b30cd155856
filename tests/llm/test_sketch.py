"""Near duplicates against all pairs compared by brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowtide.llm import sketch
from rowtide.llm.common import components

SCHEMA = "doc_id long, text string"


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not found:
        return set()
    return {tuple(found)} if len(found) < words else {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def brute(rows, words, percent):
    """component of each id, ids being unique"""
    sets = {i: shingles(t, words) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    pairs = [
        (a, b)
        for n, a in enumerate(ids)
        for b in ids[n + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return sorted((i, len(sets[i]), label[i], label[i] == i) for i in ids)


def corpus(seed, groups=12, size=9):
    """Groups of copies at growing distance from their first, in chains, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 400))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(3, 120))]
        for j in range(size):
            if rng.random() < 0.3:
                base = list(base)  # a chain: drift goes on from here
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                text[rng.randrange(len(text))] = word()
            if j % 4 == 3:
                base = text
            rows.append(" ".join(text) if rng.random() < 0.8 else "  ".join(text).upper() + "\n")
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,words", [(1, 4), (2, 5), (3, 1)])
def test_components_equal_brute_force(spark, seed, words):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    found = sketch.near_duplicates(df, words=words)
    assert sorted(map(tuple, found.collect())) == brute(rows, words, 80)


@pytest.mark.parametrize("rounds", [0, 2])
def test_blocks_equal_brute_force(spark, monkeypatch, rounds):
    """With a low similarity, buckets hold several components, and clusters take many small blocks."""
    monkeypatch.setattr(sketch, "BLOCK", 5)
    monkeypatch.setattr(sketch, "PIVOT_ROUNDS", rounds)
    rows = corpus(4, groups=5, size=14)
    found = sketch.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=2, percent=60, bands=64, rows=1)
    assert sorted(map(tuple, found.collect())) == brute(rows, 2, 60)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c d"), (7, long), (8, long + " x"), (9, long), (9, long), (None, "a b"), (None, None), (10, "ä Ä"), (11, "Ä ä")]
    df = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, component_id string, Kept boolean")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in sketch.near_duplicates(df, words=4).collect()), key=repr)
    want = [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True), (8, 7, False), (9, 7, False), (9, 7, False)]
    want += [(None, None, True), (None, None, True), (10, 10, True), (11, 11, True)]
    assert found == sorted(want, key=repr)
    kept = sketch.drop_near_duplicates(df, words=4)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 7, None, None, 10, 11], key=repr)


def test_one_id_with_several_texts_joins_their_groups(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (2, two), (3, one), (3, two)]
    found = {(r.doc_id, r.component_id) for r in sketch.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {(1, 1), (2, 1), (3, 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sketch.near_duplicates(df).collect() == []
    assert sketch.drop_near_duplicates(df).collect() == []


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for n in (3, 40, 700):
        a = rng.integers(0, 1 << 62, 2 * n).astype(np.uint64)
        sets = [np.unique(a[: n + n // 2]), np.unique(a[n // 2 :])]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        values, bounds = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
        s = sketch.sketches(values, bounds, 512)
        assert (s < np.uint64(0xFFFFFFFFFFFFFFFF)).all()  # every coordinate is filled
        assert abs((s[0] == s[1]).mean() - true) < 0.12


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0b é,", max_size=30), max_size=6), st.integers(1, 5))
def test_shingle_sets(texts, words):
    values, bounds = sketch.Shingler(words).sets([t.encode() for t in texts])
    assert [b - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [len(shingles(t, words)) for t in texts]


def test_components_of_paths_stars_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(100, 164)] + [(500, i) for i in range(300, 340)] + [(9, 8), (8, 7), (7, 9), (5, 5)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {found[i] for i in range(100, 165)} == {100}
    assert {found[i] for i in (*range(300, 340), 500)} == {300}
    assert {found[i] for i in (7, 8, 9)} == {7}
