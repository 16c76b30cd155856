"""Merkle manifest of a table: roots and proofs by butterfly exchange.

Every row is a leaf. The leaves of a group stand in order, and a run of `fanout` consecutive nodes
becomes their hash, level by level, until one node, the subroot, is left; the subroots of
the groups, in order, make the root in the same way.

The leaves of a group are dealt into aligned partitions of `fanout` ** `height` rows, and each hashes
its own subtree. The roots of these subtrees are then swapped in rounds: in round r the
partitions whose numbers differ in the r-th digit to the base `fanout` alone meet, and each of them
hashes their common ancestor and notes the others' nodes. An ancestor is so hashed by every
partition below it, but after as many rounds as the numbers have digits each holds the upper part
of its own proofs, and nothing has to be sent down again. Numbers are padded with empty partitions to a
power of the fanout; an empty one takes over what it meets, so a ragged end needs no rule.

Only the leaf digests are moved, never texts; a partition holds `fanout` ** `height` of them, a
round's groups `fanout` roots.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import runs, written
from rowtide.operators.sequences import assign_serial
from rowtide.session import cut_lineage

FANOUT = 2
#: Levels that a partition hashes by itself.
HEIGHT = 12
#: Rounds of exchange between two cuts of the lineage.
ROUNDS_AT_ONCE = 8

STEP = pa.struct([("before", pa.string()), ("after", pa.string())])
STEPS = "array<struct<before string, after string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """Digest of a row: of each value its UTF-8 length, a colon and itself, of a null a dash."""
    texts = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*fields), 256)


def folded(digests: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    return F.aggregate(proof, digests, lambda below, step: F.sha2(F.concat(step["before"], below, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings of a proof, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def levels(n: Column, fanout: int) -> Column:
    """Levels above n nodes: the least t with fanout ** t >= n."""
    powers = [F.lit(fanout**t).cast("long") for t in range(63) if fanout**t < 1 << 63]
    return F.size(F.filter(F.array(*powers), lambda p: p < n))


def subtree(digests: Sequence[str], height: int, fanout: int) -> list[list[str]]:
    """Nodes of each level above some leaves."""
    nodes = [list(digests)]
    for _ in range(height):
        below = nodes[-1]
        nodes.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return nodes


def swap(state: DataFrame, r: int, fanout: int) -> DataFrame:
    """Round r: partitions that differ in digit r alone learn each other's roots and hash their common ancestor."""
    unit = F.lit(fanout**r).cast("long")
    active = F.col("rounds") > r
    digit = F.when(active, F.expr(f"block div {fanout**r}") % fanout).otherwise(F.lit(0).cast("long"))
    numbered = state.withColumn("digit", digit)
    meeting = numbered.groupBy("grp", (F.col("block") - F.col("digit") * unit).alias("meeting"), "rounds")
    members = meeting.agg(F.collect_list(F.struct("digit", "block", "root", "steps")).alias("members"))
    members = members.select("grp", "rounds", F.array_sort("members").alias("members"))
    joined = F.array_join(F.transform("members", lambda m: m["root"]), "")
    one = members.withColumn("all", joined).select("grp", "rounds", "all", "members", F.explode("members").alias("m"))

    def others(left: bool) -> Column:
        beside = F.filter("members", lambda o: (o["digit"] < F.col("m.digit")) if left else (o["digit"] > F.col("m.digit")))
        return F.array_join(F.transform(beside, lambda o: o["root"]), "")

    step = F.struct(others(True).alias("before"), others(False).alias("after"))
    above = F.when(F.col("all") != "", F.sha2(F.col("all"), 256))
    return one.select(
        "grp",
        F.col("m.block").alias("block"),
        "rounds",
        F.when(active, above).otherwise(F.col("m.root")).alias("root"),
        F.when(active, F.concat(F.col("m.steps"), F.array(step))).otherwise(F.col("m.steps")).alias("steps"),
    )


def subtrees(leaves: DataFrame, fanout: int, height: int) -> DataFrame:
    """(grp, block, root, steps): for every partition of leaves (grp, at, n, digest) the root of its group and the upper part of its proofs."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 2):
            top = subtree(run.column("digest").to_pylist(), run.column("local")[0].as_py(), fanout)[-1]
            first = run.slice(0, 1).select(["grp", "block", "blocks", "rounds"]).to_batches()[0]
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(top)], names=["grp", "block", "blocks", "rounds", "root"])

    dealt = leaves.select("grp", block(height, fanout).alias("block"), "at", "digest", "n")
    height_of = levels(F.col("n"), fanout)
    dealt = dealt.select(
        "grp", "block", "at", "digest",
        F.least(height_of, F.lit(height)).alias("local"),
        F.greatest(height_of - height, F.lit(0)).alias("rounds"),
        F.expr(f"(n - 1) div {fanout**height} + 1").alias("blocks"),
    )
    sorted_ = dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "at")
    state = cut_lineage(sorted_.mapInArrow(hashed, "grp long, block long, blocks long, rounds int, root string"))
    rounds = state.agg(F.max("rounds")).first()[0] or 0
    if rounds:
        width = F.lit(fanout).cast("double") ** F.col("rounds")
        copies = F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda j: F.col("block") + j * F.col("blocks"))
        padded = state.withColumn("own", F.col("block")).withColumn("block", F.explode(copies)).where(F.col("block") < width)
        state = padded.withColumn("root", F.when(F.col("block") == F.col("own"), F.col("root")))
    state = state.withColumn("steps", F.array().cast(STEPS)).select("grp", "block", "rounds", "root", "steps", "blocks")
    kept = state.select("grp", "block", "blocks")
    state = state.drop("blocks")
    for r in range(rounds):
        state = swap(state, r, fanout)
        if r % ROUNDS_AT_ONCE == ROUNDS_AT_ONCE - 1:
            state = cut_lineage(state)
    if rounds:
        state = state.join(kept.where("block < blocks").drop("blocks"), ["grp", "block"])
    return state.select("grp", "block", "root", "steps")


def block(height: int, fanout: int) -> Column:
    """Number of the partition of a leaf in its group."""
    return F.expr(f"at div {fanout**height}")


def with_proofs(leaves: DataFrame, upper: DataFrame, fanout: int, height: int) -> DataFrame:
    """All rows and columns of leaves (grp, at, n, digest, ...) with `proof`, and the other columns of upper (grp, block, steps, ...)."""
    carried = [c for c in leaves.columns if c not in ("grp", "at", "digest", "n")]
    shared = [c for c in upper.columns if c not in ("grp", "block", "steps")]

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, 2):
            head, rows = run.slice(0, 1), run.slice(1)
            above = head.column("steps")[0].as_py()
            local = rows.column("local")[0].as_py()
            nodes = subtree(rows.column("digest").to_pylist(), local, fanout)
            before, after, bases = [], [], []
            for level in nodes[:-1]:
                bases.append(len(before))
                for i in range(len(level)):
                    start = i - i % fanout
                    before.append("".join(level[start:i]))
                    after.append("".join(level[i + 1 : start + fanout]))
            bases.append(len(before))
            before += [s["before"] for s in above]
            after += [s["after"] for s in above]
            n = rows.num_rows
            at = [bases[k] + np.arange(n) // fanout**k for k in range(local)]
            at += [np.full(n, bases[-1] + k) for k in range(len(above))]
            picks = pa.array(np.stack(at, axis=1).ravel() if at else np.zeros(0, np.int64))
            steps = pa.StructArray.from_arrays([pa.array(before, pa.string()).take(picks), pa.array(after, pa.string()).take(picks)], fields=list(STEP))
            proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(at), pa.int32()), steps)
            rest = [rows.column(c).combine_chunks() for c in ("grp", "at", "digest", "n", *carried)]
            same = [pa.array([head.column(c)[0].as_py()] * n, head.schema.field(c).type) for c in shared]
            yield pa.RecordBatch.from_arrays([*rest, *same, proof], names=["grp", "at", "digest", "n", *carried, *shared, "proof"])

    own = leaves.withColumn("block", block(height, fanout)).withColumn("local", F.least(levels(F.col("n"), fanout), F.lit(height)))
    both = own.unionByName(upper.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True)
    both = both.select("grp", "block", "at", "digest", "n", "local", "steps", *shared, *carried)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*leaves.select("grp", "at", "digest", "n", *carried).schema, *upper.select(*shared).schema])
    return both.repartition("grp", "block").sortWithinPartitions("grp", "block", "at").mapInArrow(proved, f"{schema}, proof {STEPS}")


def manifest(
    rows: DataFrame, id_col: str, group_col: str, leaf_col: str, keep: Sequence[str] = (), fanout: int = FANOUT, height: int = HEIGHT
) -> DataFrame:
    """One row for each row: the id, the columns in `keep`, leaf, subroot, root and proof.

    leaf_col holds the leaves' digests (see `leaf`). Groups stand in ascending order, a null one first;
    the leaves of a group by id, nulls first, rows with equal ids by their digest. Equal rows
    are leaves each. proof has one step for each level, from the leaf through the subroot to the
    root: the digests of the run's other nodes before and after the own one, joined, empty if there
    are none; `folded` leads from a leaf and its proof to the root. A single leaf is its own subroot, a
    single group's subroot the root. An empty table has no rows and no root. Columns
    that are not named are not read, so their names may be any; the names of the named ones are kept,
    and the others that come out are `leaf`, `subroot`, `root` and `proof`.
    """
    if fanout < 2 or height < 1:
        raise ValueError("fanout must be at least 2 and height at least 1")
    packed = rows.select(
        F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).alias("row"),
        F.col(group_col).alias("name"),
        F.col(leaf_col).alias("digest"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.asc_nulls_first("name"), F.asc_nulls_first("row.id"), F.asc("digest"), F.asc("tie")]
    numbered = written(assign_serial(packed, order, start=0, name="place").drop("tie"), "merkle-leaves")
    groups = numbered.groupBy("name").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = cut_lineage(assign_serial(groups, [F.asc_nulls_first("name")], start=0, name="grp"))
    leaves = numbered.alias("l").join(groups.alias("g"), F.col("l.name").eqNullSafe(F.col("g.name")))
    leaves = leaves.select("grp", (F.col("place") - F.col("first")).alias("at"), "digest", "n", "row")
    lower = cut_lineage(subtrees(leaves, fanout, height))
    n = F.lit(groups.count()).cast("long").alias("n")
    tops = lower.where("block = 0").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("at"), F.col("root").alias("digest"), n)
    top = with_proofs(tops, subtrees(tops, fanout, height), fanout, height)
    top = cut_lineage(top.select(F.col("at").alias("grp"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("over")))
    upper = lower.drop("root").join(top, "grp").withColumn("steps", F.concat("steps", "over")).drop("over")
    kept = [F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep)]
    proved = with_proofs(leaves, upper, fanout, height)
    return proved.select(F.col("row.id").alias(id_col), *kept, F.col("digest").alias("leaf"), "subroot", "root", "proof")
