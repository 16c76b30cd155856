"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.session import cut_lineage, scratch_path

#: Text handed to one vectorised step at a time; bounds the arrays of a worker.
SLICE_BYTES = 1 << 20


def free_name(columns: Iterable[str], wanted: str) -> str:
    """`wanted`, or the first of wanted_1, wanted_2, ... that is not taken (ignoring case)."""
    taken = {c.lower() for c in columns}
    name, n = wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, so that they are worked out once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together; a longer text makes a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node it is joined to.

    Each round takes the least label among the neighbours, then follows labels to
    labels, so a path of n nodes needs about log n rounds. Only aggregates and joins
    with one unique side: a hub with very many links is pre-aggregated or split.
    Labels are cut to the checkpoint folder in each round.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.where("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    while True:
        far = (
            both.join(labels, both.b == labels.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("far"))
        )
        near = labels.join(far, "node").select("node", F.least("label", "far").alias("near"), F.col("label").alias("was"))
        hop = labels.select(F.col("node").alias("near"), F.col("label").alias("next"))
        stepped = cut_lineage(near.join(hop, "near").select("node", F.least("near", "next").alias("label"), "was"))
        changed = stepped.where("label <> was").limit(1).count()
        labels = stepped.select("node", "label")
        if not changed:
            return labels


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The consecutive rows with equal values in the first `keys` columns, which hold integers without nulls.

    Holds one run at a time; rows have to come sorted by these columns.
    """
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in range(keys)], axis=1)
        starts = np.flatnonzero(np.append(True, (values[1:] != values[:-1]).any(axis=1)))
        for start, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            key = tuple(values[start])
            if held and key != current:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            current = key
    if held:
        yield pa.Table.from_batches(held)
