"""Mixing sources to target weights by budgets that run down a tree.

A tree of weights (domain, language, source) gives each leaf a share of the token budget.
Where a leaf has less than its share, even over all allowed epochs, its siblings take what
is short in proportion to their weights; only what they cannot hold either goes to
the siblings of the parent, and so on up. A leaf takes whole epochs of its documents and,
of one more epoch, the longest prefix in that epoch's seeded order that fits.

The prefix needs no sorting of a leaf in one task. Documents are counted by the first
bits of their hash, which are even whatever the source; only the one bucket in which the
budget runs out is counted by the next bits, and the documents of the last bucket are
ordered. What the driver sees is bounded by the leaves of the tree that is passed in.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rowtide.llm.common import free_name, slices, utf8, written

OTHER = "*"
#: Leaves of a tree; they are handled on the driver and broadcast.
MAX_LEAVES = 100_000
BITS = 12


@dataclass(frozen=True)
class Node:
    """A weight and, above the leaves, the children by value of the next level; `*` stands for any other value."""

    weight: float
    children: Mapping[str, Node] = field(default_factory=dict)


def leaves(root: Node, depth: int) -> dict[tuple[str, ...], tuple[float, ...]]:
    """Weights along the path of each leaf."""
    level = {(): ((), root)}
    for _ in range(depth):
        level = {(*path, name): ((*weights, child.weight), child) for path, (weights, node) in level.items() for name, child in node.children.items()}
    if any(node.children for _, node in level.values()):
        raise ValueError(f"the tree is deeper than {depth} levels")
    if len(level) > MAX_LEAVES:
        raise ValueError(f"the tree has over {MAX_LEAVES} leaves")
    return {path: weights for path, (weights, _) in level.items()}


def share_out(total: int, weights: list[float], room: list[int]) -> list[int]:
    """Whole parts of total in proportion to weights, none above its room.

    What one cannot hold is dealt to the others again by weight; rounding goes to the
    largest remainders, ties to the first. Parts of weight 0 get nothing.
    """
    parts = [0] * len(weights)
    exact = [Fraction(w) for w in weights]
    open_ = [i for i, w in enumerate(exact) if w > 0 and room[i] > 0]
    left = total
    while open_ and left > 0:
        whole = sum(exact[i] for i in open_)
        full = [i for i in open_ if exact[i] * left / whole >= room[i]]
        if full:
            for i in full:
                parts[i] = room[i]
            left -= sum(room[i] for i in full)
            open_ = [i for i in open_ if i not in full]
            continue
        fair = {i: exact[i] * left / whole for i in open_}
        for i in open_:
            parts[i] = int(fair[i])
        spare = left - sum(parts[i] for i in open_)
        for i in sorted(open_, key=lambda i: (parts[i] - fair[i], i))[:spare]:
            parts[i] += 1
        break
    return parts


def budgets(root: Node, depth: int, supply: Mapping[tuple[str, ...], int], total: int, epochs: int) -> dict[tuple[str, ...], int]:
    """Tokens of each leaf."""
    leaves(root, depth)

    def room(node: Node, path: tuple[str, ...]) -> int:
        if len(path) == depth:
            return supply.get(path, 0) * epochs
        return sum(room(child, (*path, name)) for name, child in node.children.items() if child.weight > 0)

    out: dict[tuple[str, ...], int] = {}

    def deal(node: Node, path: tuple[str, ...], tokens: int) -> None:
        if len(path) == depth:
            out[path] = tokens
            return
        names = list(node.children)
        parts = share_out(tokens, [node.children[n].weight for n in names], [room(node.children[n], (*path, n)) for n in names])
        for name, part in zip(names, parts, strict=True):
            deal(node.children[name], (*path, name), part)

    deal(root, (), min(total, room(root, ())))
    return out


def with_leaf(docs: DataFrame, root: Node, levels: list[Column], out_col: str) -> DataFrame:
    """Rows of docs that have a leaf, with its number in the order of the tree.

    One broadcast join for each level with the names under each node; their number is bounded by
    the tree's leaves. A name that a node lacks, or null, goes to the node's `*`.
    """
    spark, depth = docs.sparkSession, len(levels)
    nodes: list[tuple[int, Node]] = [(0, root)]
    at = free_name([*docs.columns, out_col], "mix_node")
    out = docs.withColumn(at, F.lit(0))
    for level in range(depth):
        named = [(number, name, child) for number, node in nodes for name, child in node.children.items()]
        nodes = [(i, child) for i, (_, _, child) in enumerate(named)]
        up, name, down, star = (free_name([*out.columns, out_col], x) for x in ("mix_up", "mix_name", "mix_down", "mix_star"))
        rows = [(parent, n, i) for i, (parent, n, _) in enumerate(named)]
        exact = spark.createDataFrame([r for r in rows if r[1] != OTHER], f"`{up}` int, `{name}` string, `{down}` int")
        rest = spark.createDataFrame([(r[0], r[2]) for r in rows if r[1] == OTHER], f"`{up}` int, `{star}` int")
        out = out.join(F.broadcast(exact), (F.col(at) == exact[up]) & (levels[level].cast("string") == exact[name]), "left").drop(exact[up], exact[name])
        out = out.join(F.broadcast(rest), F.col(at) == rest[up], "left").drop(rest[up])
        out = out.withColumn(at, F.coalesce(down, star)).drop(down, star).where(F.col(at).isNotNull())
    return out.withColumnRenamed(at, out_col)


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@F.arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Runs of anything but ASCII white space; null counts as none."""
    out = np.zeros(len(texts), np.int64)
    raw = utf8(texts)
    for a, b in slices(raw):
        data = np.frombuffer(b" ".join([b"", *raw[a:b]]), np.uint8)
        solid = ~_BLANK[data]
        starts = np.flatnonzero(solid[1:] & ~solid[:-1])
        ends = np.cumsum([len(x) + 1 for x in raw[a:b]])
        out[a:b] = np.diff(np.searchsorted(starts, ends), prepend=0)
    return pa.array(out)


def order_key(seed: int, epoch: Column, ident: Column) -> Column:
    """Place of a document in an epoch's order: 60 bits of a hash, never negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("int"), ident.cast("string")), 4)


def mix(
    docs: DataFrame,
    root: Node,
    levels: list[Column],
    total: int | float,
    id_col: str = "doc_id",
    tokens: Column | None = None,
    epochs: int = 1,
    seed: int = 0,
    copies_col: str | None = None,
) -> DataFrame:
    """The rows of docs that the mixture takes, with all their columns.

    total is a number of tokens, or a share (a float) of the supply of all leaves times
    epochs. copies_col, if given, holds how many epochs a row is taken in, once per row;
    without it such a row is repeated. Rows whose levels lead to no leaf, and leaves of
    weight 0, take no part. Null levels go to `*`. Documents stay whole: the prefix ends before the first one
    that does not fit. Rows of one id in one leaf (repeated rows, or null ids) share a place in
    the order and go together. Rows of no tokens follow the place of their id.
    """
    depth = len(levels)
    paths = list(leaves(root, depth))
    leaf = free_name([*docs.columns, copies_col or ""], "leaf_number")
    count = word_count(F.col("text").cast("string")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    placed = with_leaf(docs, root, levels, leaf)
    slim = placed.select(F.col(leaf).alias("leaf"), F.col(id_col).cast("string").alias("ident"), count.alias("tokens"))
    slim = written(slim, "mix")  # some 20 bytes for each document
    supply = {paths[r["leaf"]]: r["n"] for r in slim.groupBy("leaf").agg(F.sum("tokens").alias("n")).collect()}
    if isinstance(total, float):
        total = int(total * sum(supply.values()) * epochs)
    dealt = budgets(root, depth, supply, total, epochs)
    plans = []
    for number, path in enumerate(paths):
        have, want = supply.get(path, 0), dealt.get(path, 0)
        whole = min(epochs, want // have) if have else (epochs if path in supply and want else 0)
        plans.append((number, int(whole), want - whole * have if have else 0))
    spark = docs.sparkSession
    partial = [p for p in plans if p[2] > 0]
    cuts = last_places(spark, slim, partial, seed)
    table = [(n, whole, *cuts.get(n, (-1, None))) for n, whole, _ in plans]
    ends = spark.createDataFrame(table, "leaf int, whole int, last long, last_ident string")
    names = {c: free_name([*docs.columns, leaf, copies_col or ""], f"mix_{c}") for c in ("leaf", "whole", "last", "last_ident")}
    ends = ends.toDF(*[names[c] for c in ("leaf", "whole", "last", "last_ident")])
    joined = placed.join(F.broadcast(ends), F.col(leaf) == F.col(names["leaf"]))  # as many rows as the tree has leaves
    ident, whole, last = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(names["whole"]), F.col(names["last"])
    at = order_key(seed, whole, ident)
    inside = (at < last) | ((at == last) & (ident < F.col(names["last_ident"])))
    copies = whole + F.coalesce(inside, F.lit(False)).cast("int")
    mark = copies_col or free_name([*docs.columns, *names.values(), leaf], "mix_copies")
    taken = joined.withColumn(mark, copies).where(F.col(mark) > 0).drop(leaf, *names.values())
    if copies_col:
        return taken
    if epochs == 1:
        return taken.drop(mark)
    turn = free_name(taken.columns, "mix_turn")
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(mark)))).drop(mark, turn)


def last_places(spark, slim: DataFrame, partial: list[tuple[int, int, int]], seed: int) -> dict[int, tuple[int, str]]:
    """The first (place, id) that no longer fits, for each leaf with a part of an epoch."""
    if not partial:
        return {}
    plan = F.broadcast(spark.createDataFrame(partial, "leaf int, whole int, budget long"))  # one row per leaf of the tree
    placed = slim.withColumn("ident", F.coalesce("ident", F.lit(""))).join(plan, "leaf")
    placed = placed.select("leaf", "budget", "ident", "tokens", order_key(seed, F.col("whole"), F.col("ident")).alias("place"))
    scope = placed.withColumn("before", F.lit(0).cast("long"))
    for depth in (1, 2):
        width = 60 - BITS * depth
        bucket = F.shiftright("place", width)
        sums = scope.groupBy("leaf", "budget", "before", bucket.alias("bucket")).agg(F.sum("tokens").alias("n"))
        run = Window.partitionBy("leaf").orderBy("bucket")  # at most 4096 buckets of a leaf
        ends = sums.withColumn("upto", F.col("before") + F.sum("n").over(run))
        cut = ends.where("upto > budget").groupBy("leaf").agg(F.min("bucket").alias("bucket"), F.min("upto").alias("upto_min"))
        cut = ends.join(F.broadcast(cut), ["leaf", "bucket"]).select("leaf", "bucket", (F.col("upto") - F.col("n")).alias("start"))
        rows = cut.collect()  # one row per leaf at most
        if not rows:
            return {}
        at = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], "leaf int, bucket long, start long"))
        scope = placed.join(at, (placed.leaf == at.leaf) & (F.shiftright(placed.place, width) == at.bucket)).select(
            placed.leaf, "budget", "ident", "tokens", "place", F.col("start").alias("before")
        )
    ties = scope.groupBy("leaf", "budget", "before", "place", "ident").agg(F.sum("tokens").alias("n"))
    run = Window.partitionBy("leaf").orderBy("place", "ident")  # one of 16 million parts of a leaf
    fits = ties.withColumn("upto", F.col("before") + F.sum("n").over(run))
    first_out = fits.where("upto > budget").groupBy("leaf").agg(F.min(F.struct("place", "ident")).alias("x"))
    out = {}
    for r in first_out.collect():  # one row per leaf at most
        out[r["leaf"]] = (r["x"]["place"], r["x"]["ident"])
    return out
