"""Nearest neighbours by collision counting over single projections.

Each block of vectors is projected on m random directions (orthonormal within each run of the
dimension), and each projection is kept as a sorted array. A query opens a window around its own projection in every array; a vector
collides where its projection lies in the window. Virtual rehashing widens all windows
together, so only the new rims are counted. A vector with enough collisions is verified by
its exact inner product. A query is done in a block once its k-th best verified neighbour
is nearer than the radius up to which the windows find nearly all neighbours.

Largest inner product becomes smallest distance by one more coordinate: candidates get
sqrt(M^2 - |x|^2) with M the largest length, queries get 0 and are scaled to length M.

Spark deals the vectors to blocks and the queries to groups; each pair of a block and a group
is one task's work, and the k best of all blocks are merged for each query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowtide.llm.common import written

PROJECTIONS = 64
#: Window's half width for a radius of 1.
HALF_WIDTH = 1.0
#: Radii grow by the first factor until k neighbours are verified, then by the second.
GROWTH = (1.4, 1.2)
#: Chance with which a vector at the radius reaches the threshold.
FOUND = 0.9
BLOCK_ROWS = 32_768
QUERY_ROWS = 1_024
SEED = 20_240_101


def directions(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """count unit vectors, orthonormal within each run of dim."""
    rng = np.random.default_rng(seed + dim)
    parts = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(math.ceil(count / dim))]
    return np.concatenate(parts, axis=1)[:, :count]


def threshold(count: int, dim: int, half_width: float, found: float) -> int:
    """Collisions that a vector at the radius reaches with chance `found`.

    The difference to it has length 1 and a random direction, so its projections are taken from such
    directions: a fixed simulation, as projections of one basis are not independent.
    """
    rng = np.random.default_rng(SEED)
    diff = rng.standard_normal((4000, dim))
    diff /= np.linalg.norm(diff, axis=1, keepdims=True)
    hits = (np.abs(diff @ directions(dim, count)) * math.sqrt(dim) <= half_width).sum(axis=1)
    return max(1, int(np.quantile(hits, 1 - found)))


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows give equal values wherever they stand."""
    return np.einsum("ij,j->i", rows, query)


@dataclass
class Block:
    """Sorted projections of a block's vectors."""

    ids: np.ndarray
    vectors: np.ndarray
    largest: float

    def __post_init__(self) -> None:
        n, dim = self.vectors.shape
        lift = np.sqrt(np.maximum(self.largest**2 - (self.vectors**2).sum(axis=1), 0.0))
        self.lifted = np.concatenate([self.vectors, lift[:, None]], axis=1)
        self.axes = directions(dim + 1, PROJECTIONS)
        self.unit = 1 / math.sqrt(dim + 1)  # projections of a unit difference are about this long
        flat = self.lifted @ self.axes
        self.order = np.argsort(flat, axis=0, kind="stable").T.copy()
        arrays = np.take_along_axis(flat, self.order.T, axis=0).T
        # the arrays one after the other, moved apart, so that one search finds a place in each
        self.low, self.span = float(arrays.min()), float(arrays.max() - arrays.min()) + 1.0
        self.shift = np.arange(PROJECTIONS) * self.span
        self.sorted = (arrays + self.shift[:, None]).ravel()
        self.enough = threshold(PROJECTIONS, dim + 1, HALF_WIDTH, FOUND)

    def places(self, values: np.ndarray, side: str) -> np.ndarray:
        """Place of one value in each sorted array."""
        inside = np.clip(values, self.low - 0.4, self.low + self.span - 0.6)
        return np.searchsorted(self.sorted, inside + self.shift, side) - np.arange(PROJECTIONS) * len(self.ids)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best that are found, best first; ties to the smaller id."""
        n = len(self.ids)
        length = math.sqrt(float((query * query).sum()))
        center = np.append(query * (self.largest / length), 0.0) @ self.axes
        counts = np.zeros(n, np.int16)
        checked = self.ids == own
        others = n - int(checked.sum())
        keep = min(k, others)
        low = high = None
        scores, places = np.zeros(0), np.zeros(0, np.int64)
        radius, far = 0.35 * self.largest, math.inf
        while True:
            reach = HALF_WIDTH * radius * self.unit
            lo, hi = self.places(center - reach, "left"), self.places(center + reach, "right")
            if low is None:
                rims = [o[a:b] for o, a, b in zip(self.order, lo, hi, strict=True)]
            else:
                rims = [o[a:b] for o, a, b in zip(self.order, lo, low, strict=True)] + [o[a:b] for o, a, b in zip(self.order, high, hi, strict=True)]
            low, high = lo, hi
            counts += np.bincount(np.concatenate(rims), minlength=n).astype(np.int16)
            new = np.flatnonzero((counts >= self.enough) & ~checked)
            if len(new):
                checked[new] = True
                scores = np.concatenate([scores, products(self.vectors[new], query)])
                places = np.concatenate([places, new])
                if len(scores) > k:
                    best = best_first(self.ids[places], scores, k)
                    scores, places = scores[best], places[best]
            if len(scores) >= keep:
                if not keep:
                    break
                # distance of the worst kept neighbour after the lift
                far = math.sqrt(max(0.0, 2 * self.largest**2 - 2 * self.largest * float(scores.min()) / length))
                if far <= radius or checked.all():
                    break
            if checked.all():
                break
            radius = min(radius * GROWTH[len(scores) >= keep], far)
        best = best_first(self.ids[places], scores, k)
        return self.ids[places[best]], scores[best]


def best_first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vector, dim, len2) of rows with an id and a vector that is neither null, empty nor zero and only holds finite numbers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id IS NOT NULL AND vector IS NOT NULL").where((F.size("vector") > 0) & finite)
    rows = rows.withColumns({"dim": F.size("vector"), "len2": F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)})
    return rows.where("len2 > 0").dropDuplicates(["vec_id", "vector"])


def nearest(
    vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that is_query (a Column) picks.

    Score is the inner product of the original vectors in double precision; nearest first, ties
    to the smaller id. Rows with the query's id are no candidates. Vectors that are
    null, empty or zero, or hold null or non-finite components, and rows without id take no part.
    Only vectors of the query's length of array are candidates. Rows of the same id with the same vector count
    once; with different vectors each is a candidate, and each a query whose neighbours are merged.
    """
    rows = written(usable(vectors, id_col, vec_col), "vectors")
    size = rows.groupBy("dim").agg(F.max("len2").alias("most"), F.count("*").alias("n"))
    sizes = size.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int"))
    asked = rows.withColumnRenamed("vec_id", id_col).where(is_query).withColumnRenamed(id_col, "vec_id")
    groups = asked.groupBy(F.col("dim").alias("q_dim")).agg(F.ceil(F.count("*") / query_rows).cast("int").alias("groups"))
    sizes = sizes.join(groups, F.col("dim") == F.col("q_dim")).drop("q_dim", "n")  # one row per length of array
    dealt = rows.join(F.broadcast(sizes), "dim")
    here = dealt.select(
        "vec_id", "vector", "dim", F.sqrt("most").alias("largest"), F.pmod(F.xxhash64("vec_id", "vector"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp")
    )
    there = asked.join(F.broadcast(sizes), "dim").select(
        F.col("vec_id").alias("own"),
        F.col("vector").alias("query"),
        F.col("dim").alias("q_dim"),
        F.pmod(F.xxhash64("vec_id", "vector", F.lit(1)), "groups").cast("int").alias("q_grp"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("q_block"),
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names})
        block = Block(left["vec_id"].to_numpy(), np.stack(left["vector"].to_numpy()), float(left["largest"].iloc[0]))
        parts = []
        for own, query in zip(right["own"], right["query"], strict=True):
            ids, scores = block.search(own, np.asarray(query), k)
            parts.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
        return pd.concat(parts)

    sides = here.groupBy("dim", "block", "grp").cogroup(there.groupBy("q_dim", "q_block", "q_grp"))
    found = sides.applyInPandas(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows from each block
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
