"""Manifests against trees built by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rowtide.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_by_hand(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_by_hand(nodes, fanout):
    """Root of some nodes, and for each of them its siblings before and after, level by level."""
    proofs = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for start in range(0, len(nodes), fanout):
            run = nodes[start : start + fanout]
            for k in range(len(run)):
                for i in below[start + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(h("".join(run)))
            owners.append([i for own in below[start : start + fanout] for i in own])
        nodes, below = above, owners
    return nodes[0], proofs


def manifest_by_hand(rows, fanout):
    """(id, leaf, subroot, root, proof) of rows (id, group, digest)."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    lower = [tree_by_hand([r[2] for r in groups[g]], fanout) for g in names]
    root, upper = tree_by_hand([x[0] for x in lower], fanout)
    out = []
    for name, (subroot, proofs), over in zip(names, lower, upper, strict=True):
        out += [(r[0], r[2], subroot, root, p + over) for r, p in zip(groups[name], proofs, strict=True)]
    return sorted(out, key=repr)


def made(df, **settings):
    found = merkle.manifest(df, "id", "grp", "digest", **settings).collect()
    return sorted([(r["id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["proof"]]) for r in found], key=repr)


@pytest.mark.parametrize(("fanout", "height"), [(2, 1), (2, 3), (3, 1), (4, 2), (2, 12)])
def test_trees(spark, fanout, height):
    rng = random.Random(fanout * 100 + height)
    sizes = {"en": 61, "de": 17, "fr": 8, "é": 1, None: 5, "": 2, "es": 9}
    rows = [(rng.randint(0, 10**9), g, h(str(rng.random()))) for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "id long, grp string, digest string")
    assert made(df, fanout=fanout, height=height) == manifest_by_hand(rows, fanout)


def test_repeated_and_null_rows(spark):
    rows = [(1, "a", h("x"))] * 5 + [(1, "a", h("y")), (None, "a", h("z")), (None, "a", h("z")), (2, None, h("x"))]
    df = spark.createDataFrame(rows, "id long, grp string, digest string")
    assert made(df, height=1) == manifest_by_hand(rows, 2)


def test_single_row_and_empty_table(spark):
    df = spark.createDataFrame([(7, "a", h("x"), 3)], "id long, grp string, digest string, ROOT int")
    assert made(df) == [(7, h("x"), h("x"), h("x"), [])]
    assert merkle.manifest(df.where("id < 0"), "id", "grp", "digest").collect() == []


def test_leaf_and_folding(spark):
    values = [(1, "é" * 70_000, None), (None, "", "x"), (-12, "a:b", "-")]
    df = spark.createDataFrame(values, "i int, s string, t string")
    assert [r[0] for r in df.select(merkle.leaf(F.col("i"), F.col("s"), F.col("t"))).collect()] == [leaf_by_hand(v) for v in values]
    rows = [(i, "ab"[i % 3 == 0], h(str(i))) for i in range(23)]
    df = spark.createDataFrame(rows, "id long, grp string, digest string")
    found = merkle.manifest(df, "id", "grp", "digest", fanout=3, height=1)
    checked = found.select(
        "root", "proof",
        merkle.folded(F.col("leaf"), F.col("proof")).alias("same"),
        merkle.folded(F.lit(h("other")), F.col("proof")).alias("other"),
        merkle.proof_digest(F.col("proof")).alias("digest"),
    ).collect()
    assert all(r.same == r.root != r.other for r in checked)
    assert all(r.digest == h("".join(b + a for b, a in r.proof)) for r in checked)


def test_kept_columns(spark):
    df = spark.createDataFrame([(1, "a", h("x"), 2.5, "q"), (2, "a", h("y"), None, None)], "id long, grp string, digest string, proof double, at string")
    found = merkle.manifest(df.withColumnRenamed("proof", "weight"), "id", "grp", "digest", keep=["weight", "at"]).collect()
    assert sorted((r["id"], r["weight"], r["at"]) for r in found) == [(1, 2.5, "q"), (2, None, None)]
