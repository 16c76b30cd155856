"""Near duplicates by fast similarity sketching.

A document's set holds its distinct word shingles. The sketch has t coordinates. In
round i every element of the set is thrown into one of the t bins and offers its value;
a bin keeps the least value of the first round that reached it. A round after the
first works only on sketches that still have an empty bin. If t rounds leave a bin empty,
round t + j throws every element into bin j, so that each coordinate is filled. Unlike
one permutation of the bins, the coordinates concentrate like independent ones, at the
cost of about max(n, t log t) steps instead of n * t.

Bands of coordinates give candidate buckets; links are confirmed on the full sets.
Rows with equal sets are one class first, so copies never meet in pairs.

Buckets are never expanded into pairs of their members. First every bucket names one pivot, and
members that are not yet joined to it are compared with it; what is joined already
needs no further proof, because components are wanted. This joins most of each large
group. What buckets still hold in several components is then compared block by block, between
different components only, so that no link among candidates is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import components, free_name, mixed, seeds, slices, union_all, utf8, written

BANDS, ROWS = 32, 4
VALUE_BITS = 55
#: Documents of one block, which are compared with a pivot or with another block in one place.
BLOCK = 192
#: Rows in one group of comparisons, pivots included.
GROUP = 400
#: Owner of the blocks that a cluster's small components share.
SHARED = "shared"
#: Rounds with one pivot for each bucket, before what is left is compared in blocks.
PIVOT_ROUNDS = 2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = seeds(256, 11)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Hashed shingles of many texts at a time. Powers are kept for reuse."""

    def __init__(self, words: int):
        self.words, self.factors = words, seeds(words, 23)
        self._up = self._down = np.ones(1, np.uint64)

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles of all texts in a row, and where each text's begin."""
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.concatenate(([0], np.cumsum(lengths + 1)))
        low = _LOWER[raw]
        solid = ~_SPACE[low]
        edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(self._up) <= len(low):
            self._up, self._down = _powers(_BASE, len(low) + 1), _powers(_UNBASE, len(low) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[low] * self._up[: len(low)], dtype=np.uint64)))
        word = mixed((total[end] - total[start]) * self._down[start] + (end - start).astype(np.uint64))
        first = np.searchsorted(start, begins)
        count = np.diff(first)
        owner = np.repeat(np.arange(len(texts)), count)
        left = first[1:][owner] - np.arange(len(word))  # words from here to the text's end
        value = np.zeros(len(word), np.uint64)
        padded = np.concatenate((word, np.zeros(self.words, np.uint64)))
        for j in range(self.words):
            value += self.factors[j] * np.where(left > j, padded[j : j + len(word)], np.uint64(0))
        kept = (left >= self.words) | ((count[owner] < self.words) & (left == count[owner]))
        value, owner = mixed(value[kept]), owner[kept]
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        parts = [np.unique(value[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate(parts) if parts else value), np.concatenate(([0], np.cumsum(sizes)))


def sketches(values: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """Sketch of each set: rows of t coordinates. Rows of empty sets stay at the maximum."""
    n = len(bounds) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, empty, np.uint64)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(n), sizes)
    bits = np.uint64(64 - VALUE_BITS)
    salt = seeds(2 * t, 37)
    for i in range(2 * t):
        if not len(values):
            break
        h = mixed(values ^ salt[i])
        place = np.uint64(i) << np.uint64(VALUE_BITS)
        bins = (((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64) if i < t else np.int64(i - t)
        offer = (mixed(h + np.uint64(1)) >> bits) | place
        at = owner * t + bins
        free = out[at] >= place  # filled in an earlier round: stays
        np.minimum.at(out, at[free], offer[free])
        open_ = (out.reshape(n, t) == empty).any(axis=1)
        live = open_[owner]
        if not live.all():
            values, owner = values[live], owner[live]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` coordinates."""
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.zeros((len(sketch), bands), np.uint64)
    for j in range(rows):
        key = mixed(key * np.uint64(31) + parts[:, :, j])
    return key


def sketch_table(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands) of each row; the set's digest is set_a, set_b."""
    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, one, two = Shingler(words), seeds(1, 51), seeds(1, 53)
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            for a, b in slices(texts):
                values, bounds = shingler.sets(texts[a:b])
                totals = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values + one), dtype=np.uint64)))
                others = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values ^ two), dtype=np.uint64)))
                keys = band_keys(sketches(values, bounds, bands * rows), bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a).cast(pa.int64()),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array((totals[bounds[1:]] - totals[bounds[:-1]]).view(np.int64)),
                        pa.array((others[bounds[1:]] - others[bounds[:-1]]).view(np.int64)),
                        lists,
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def linked_pairs(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b): members and pivots with 100 * intersection >= percent * union over full sets.

    A pivot's members are dealt to blocks of about BLOCK, each with one copy of the pivot;
    small blocks share a task's group, of about GROUP rows.
    """
    blocks = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = pairs.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("a", "pivot"), F.col("blocks")).cast("int"))
    members = dealt.select(F.col("a").alias("doc_id"), "pivot", "block", F.lit(False).alias("is_pivot"))
    pivots = blocks.select(
        F.col("pivot").alias("doc_id"), "pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("is_pivot")
    )
    groups = max(1, pairs.count() * 2 // GROUP)
    wanted = members.unionByName(pivots).withColumn("dealt", F.pmod(F.xxhash64("pivot", "block"), F.lit(groups)))
    loaded = texts.join(wanted.hint("merge"), "doc_id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        shingler = Shingler(words)
        sets = text_sets(shingler, group["text"])
        flags = group["is_pivot"].to_numpy()
        places = list(zip(group["pivot"], group["block"], strict=True))
        heads: dict[tuple, list[np.ndarray]] = {}
        for i in np.flatnonzero(flags):
            heads.setdefault(places[i], []).append(sets[i])
        found = [i for i in np.flatnonzero(~flags) if any(close(head, sets[i], percent) for head in heads.get(places[i], ()))]
        return group.iloc[found][["doc_id", "pivot"]].rename(columns={"doc_id": "a", "pivot": "b"})

    return loaded.groupBy("dealt").applyInPandas(compare, "a long, b long").distinct()


def close(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets, neither of them empty."""
    small, large = sorted((len(one), len(other)))
    if not small or 100 * small < percent * large:
        return False
    at = np.searchsorted(one, other)
    at[at == len(one)] = 0
    both = int((one[at] == other).sum())
    return 100 * both >= percent * (small + large - both)


def still_open(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, doc_id, label) of the buckets that hold several components."""
    if labels is None:
        return members.withColumn("label", F.col("doc_id"))
    named = members.join(labels, members.doc_id == labels.node, "left").select("bucket", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    several = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    return written(named.join(several, "bucket"), "open")


def pivot_pairs(live: DataFrame, turn: int) -> DataFrame:
    """Distinct pairs (a, pivot) of members of a bucket with one pivot, of another component."""
    if turn:
        heads = live.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)), "doc_id", "label")).alias("head"))
        met = live.join(heads, "bucket").where("label <> head.label").select(F.col("doc_id").alias("a"), F.col("head.doc_id").alias("pivot"))
    else:  # the smallest document of each bucket
        heads = live.groupBy("bucket").agg(F.min("doc_id").alias("pivot"))
        met = live.join(heads, "bucket").where("doc_id <> pivot").select(F.col("doc_id").alias("a"), "pivot")
    # a document's least pivot: most of a group have the same one
    return written(met.groupBy("a").agg(F.min("pivot").alias("pivot")), "pairs")


def linked_in_blocks(live: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between different components of live buckets, enough of them to join all that are linked.

    Documents that buckets connect form a cluster. A cluster is cut into blocks of about BLOCK
    documents; a component larger than that has blocks of its own. Each pair of blocks, but not
    two of the same component, is compared in one place, where texts are sent once and not
    once for each pair of documents. Only documents of different components are compared.
    """
    # clusters of components: a large group that is joined already is one node
    heads = live.groupBy("bucket").agg(F.min("label").alias("b"))
    met = live.join(heads, "bucket").where("label <> b").select(F.col("label").alias("a"), "b").distinct()
    cluster = components(met).withColumnRenamed("label", "cluster")
    docs = live.select("doc_id", "label").distinct().join(cluster, F.col("label") == F.col("node"))
    docs = written(docs.select("doc_id", "label", "cluster"), "clusters")
    sizes = docs.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    large = F.col("n") > BLOCK
    small = sizes.where(~large).groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    # a large component is the owner of its blocks, all small ones of a cluster share others
    plan = sizes.join(small, "cluster", "left").select(
        "cluster",
        "label",
        F.when(large, F.col("label").cast("string")).otherwise(F.lit(SHARED)).alias("owner"),
        F.when(large, F.ceil(F.col("n") / BLOCK)).otherwise(F.col("parts")).cast("int").alias("parts"),
    )
    part = F.pmod(F.xxhash64(F.when(F.col("owner") == SHARED, F.col("label")).otherwise(F.col("doc_id"))), F.col("parts"))
    placed = docs.join(plan, ["cluster", "label"]).select("doc_id", "label", "cluster", F.concat_ws("/", "owner", part).alias("block"))
    # pairs of owners first: the blocks of one component never meet each other
    owners = plan.select("cluster", "owner", "parts").distinct()
    other = owners.select("cluster", F.col("owner").alias("owner_2"), F.col("parts").alias("parts_2"))
    pairs = owners.join(other, "cluster").where((F.col("owner") < F.col("owner_2")) | ((F.col("owner") == SHARED) & (F.col("owner_2") == SHARED)))
    tasks = pairs.select("cluster", "owner", "owner_2", "parts_2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    tasks = tasks.select("cluster", "owner", "owner_2", "part", F.explode(F.sequence(F.lit(0), F.col("parts_2") - 1)).alias("part_2"))
    tasks = tasks.where((F.col("owner") != F.col("owner_2")) | (F.col("part") <= F.col("part_2")))
    tasks = tasks.select("cluster", F.concat_ws("/", "owner", "part").alias("block"), F.concat_ws("/", "owner_2", "part_2").alias("block_2"))
    tasks = tasks.withColumn("task", F.xxhash64("cluster", "block", "block_2"))
    left = placed.join(tasks, ["cluster", "block"]).select("doc_id", "label", "task", (F.col("block") == F.col("block_2")).alias("alone"), F.lit(0).alias("side"))
    second = tasks.where("block <> block_2").select("cluster", F.col("block_2").alias("block"), "task")
    right = placed.join(second, ["cluster", "block"]).select("doc_id", "label", "task", F.lit(False).alias("alone"), F.lit(1).alias("side"))
    wanted = written(left.unionByName(right), "tasks")
    groups = max(1, wanted.count() // GROUP)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        shingler, found = Shingler(words), []
        for _, task in group.groupby("task"):
            found += spanning_links(shingler, task, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    loaded = texts.join(wanted.hint("merge"), "doc_id").withColumn("dealt", F.pmod("task", F.lit(groups)))
    return loaded.groupBy("dealt").applyInPandas(compare, "a long, b long").distinct()


def text_sets(shingler: Shingler, texts) -> list[np.ndarray]:
    raw = [x.encode() if x else b"" for x in texts]
    sets: list[np.ndarray] = []
    for a, b in slices(raw):
        values, bounds = shingler.sets(raw[a:b])
        sets += np.split(values, bounds[1:-1])
    return sets


def spanning_links(shingler: Shingler, task: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between components over a task's rows; pairs that are joined by now are left out."""
    task = task.drop_duplicates(["doc_id", "text"])
    sets = text_sets(shingler, task["text"])
    ids, labels, sides = task["doc_id"].tolist(), task["label"].tolist(), task["side"].tolist()
    alone = bool(task["alone"].iloc[0])
    parent: dict[int, int] = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    found = []
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break  # all later ones are larger still
            if (alone or sides[i] != sides[j]) and (x := root(labels[i])) != (y := root(labels[j])) and close(sets[i], sets[j], percent):
                parent[max(x, y)] = min(x, y)
                found.append((ids[i], ids[j]))
    return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| over their distinct
    word shingles; with the default bands a link at 0.8 has a chance of 5 in 100 million
    of never being a candidate. component_id is the smallest id reachable, kept marks the
    document with that id. Words are runs of anything but blank, tab, line feed, vertical
    tab, form feed and carriage return, with A-Z lower-cased; fewer words than a shingle
    make one shingle together. Null and empty texts have an empty set and no links; a row
    without id is its own component with a null id and is kept. Rows of one id count as one
    document with the links of any of them. Other columns are not read.
    """
    key = ["n_shingles", "set_a", "set_b"]
    rows_ = written(sketch_table(docs, id_col, text_col, words, bands, rows), "sketches")
    real = rows_.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets have equal bands: any row of the class gives them
    classes = written(real.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    entries = classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("doc_id"))
    crowded = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    # joined by a shuffle at every size: what a small input would broadcast, a large one could not
    members = written(entries.join(crowded.hint("merge"), "bucket"), "buckets")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the texts that comparisons need, moved once; later joins are with these only
    wanted = members.select("doc_id").distinct()
    texts = written(texts.join(wanted.hint("merge"), "doc_id", "left_semi"), "texts")
    # rows of one id with different sets tie their classes together
    ties = real.select("doc_id", *key).join(classes.select(*key, "rep"), key).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = real.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).where("x <> y").select(F.col("doc_id").alias("a"))
    links = [written(ties.join(several, "a", "left_semi"), "ties")]
    labels = components(links[0]) if links[0].limit(1).count() else None
    for turn in range(PIVOT_ROUNDS + 1):
        live = still_open(members, labels)
        members = live.select("bucket", "doc_id")
        if turn == PIVOT_ROUNDS:
            found = linked_in_blocks(live, texts, words, percent)
        else:
            found = linked_pairs(pivot_pairs(live, turn), texts, words, percent)
        links.append(written(found, "links"))
        labels = components(union_all(links))
    if labels is not None:
        classes = classes.join(labels, classes.rep == labels.node, "left").select(*key, F.coalesce("label", "rep").alias("component_id"))
    else:
        classes = classes.select(*key, F.col("rep").alias("component_id"))
    out = rows_.select("doc_id", *key).join(classes, key, "left")
    whole = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", whole.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, whose document stands for its component."""
    mark = free_name(docs.columns, "dropped_id")
    gone = near_duplicates(docs, id_col, text_col, **options).where("NOT kept").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(gone.hint("merge"), F.col(id_col).cast("long") == F.col(mark), "left_anti")
