"""Quality by compression: two zstandard dictionaries, one from good and one from bad text.

A text is compressed in short pieces with either dictionary. The difference of the two
sizes, over their sum, says which of the two it resembles; the smaller size over the
plain size says how repetitive it is beyond either dictionary. A logistic curve fitted on
labelled texts that did not go into the dictionaries turns both into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import free_name, written

PIECE = 1024
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries and the curve; about half a megabyte, whatever the corpus."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        coders = []
        for content in (self.good, self.bad):
            kind = zstandard.ZstdCompressionDict(content)
            kind.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_checksum=False, write_content_size=False, write_dict_id=False))
        weights = np.array(self.weights)

        def score(texts: list[bytes]) -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(features(texts, *coders) @ weights, -30, 30)))

        return score


def features(texts: list[bytes], good, bad) -> np.ndarray:
    """1, difference, density and their squares and product for each text."""
    sizes = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        a = b = 0
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            a += len(good.compress(piece))
            b += len(bad.compress(piece))
        sizes[i] = a, b, len(text)
    g, b, n = sizes.T
    near = (b - g) / np.maximum(g + b, 1)
    dense = np.log((np.minimum(g, b) + 8) / (n + 8))
    return np.stack([np.ones(len(texts)), near, dense, near * near, dense * dense, near * dense], axis=1) * [1, 10, 1, 100, 1, 10]


def curve(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_column: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds, is 0; a null id is held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(True))


def coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_checksum=False, write_content_size=False, write_dict_id=False)


def least_pieces(texts: DataFrame, most: int) -> list[bytes]:
    """The `most` pieces, from anywhere in the texts (id, text), with the least hash of id and piece number."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (text or "").encode()
                for first in range(0, len(body), 4096 * PIECE):
                    pieces = [body[at : at + PIECE] for at in range(first, min(len(body), first + 4096 * PIECE), PIECE)]
                    marks = [xxhash.xxh64_intdigest(f"{ident}:{first // PIECE + n}") >> 1 for n in range(len(pieces))]
                    yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(pieces, pa.binary())], names=["mark", "piece"])

    found = texts.select(F.col("id").cast("string"), "text").mapInArrow(cut, "mark long, piece binary")
    return [bytes(r["piece"]) for r in found.orderBy("mark", "piece").limit(most).toLocalIterator()]


def least_features(texts: DataFrame, most: int, good: bytes, bad: bytes) -> np.ndarray:
    """Features of the `most` whole texts (id, text) with the least hash of their id, measured in the tasks."""
    names = [f"f{i}" for i in range(6)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = coder(good), coder(bad)
        for batch in batches:
            marks = [xxhash.xxh64_intdigest(f"{x}:") >> 1 for x in batch.column(0).to_pylist()]
            x = features([(t or "").encode() for t in batch.column(1).to_pylist()], *coders)
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), *[pa.array(c, pa.float64()) for c in x.T]], names=["mark", *names])

    found = texts.select(F.col("id").cast("string"), "text").mapInArrow(measure, "mark long, " + ", ".join(f"{n} double" for n in names))
    return np.array([[r[n] for n in names] for r in found.orderBy("mark", *names).limit(most).collect()]).reshape(-1, len(names))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    sample: int = 2000,
    pieces: int = 16384,
    dictionary_bytes: int = 262144,
) -> CompressionModel:
    """Fit on at most 2 * `sample` labelled rows of each class outside the held-out fold.

    The rows with the least hash of their id are taken; half of them (by another hash) make the
    dictionary, the other half the curve. Texts are read whole: a dictionary is made
    from at most `pieces` pieces of 1,024 bytes from anywhere in them, and the curve's texts are measured
    in the tasks, so the driver holds those pieces and six numbers for each text. Without rows of a class, or
    with too little text for a dictionary, the curve gives the share of label 1 (0.5 without
    any label). Only the text enters a score. An id labelled twice, or repeated, counts once for each pair.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("id"), folds))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = min(max(counts.get(1, 0) / total, 0.001), 0.999) if total else 0.5
    prior = CompressionModel(b"", b"", (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0, 0.0, 0.0))
    if not (counts.get(0) and counts.get(1)):
        return prior
    by_hash = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    chosen = [rows.where(F.col("y") == y).orderBy(*by_hash).limit(2 * sample) for y in (0, 1)]  # bounded
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    half = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(7)), F.lit(2)).alias("half")
    found = written(texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), "id").select("id", "y", half, "text"), "labelled")
    sizes = {(r["y"], r["half"]): r["n"] for r in found.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    if {y for y, _ in sizes} != {0, 1}:
        return prior

    def part(y: int, h: int) -> DataFrame:
        whole = found.where(F.col("y") == y)  # a class without rows in one half serves both with the other
        return (whole.where(F.col("half") == h) if (y, h) in sizes else whole).select("id", "text")

    made = {}
    for y in (0, 1):
        got = least_pieces(part(y, 0), pieces)
        try:
            made[y] = zstandard.train_dictionary(dictionary_bytes, got).as_bytes()
        except zstandard.ZstdError:
            made[y] = b"".join(got)[-dictionary_bytes:] or b"."  # too little to train on: the text itself
    x1, x0 = [least_features(part(y, 1), 2 * sample, made[1], made[0]) for y in (1, 0)]
    w = curve(np.concatenate([x1, x0]), np.concatenate([np.ones(len(x1)), np.zeros(len(x0))]))
    # the sample holds the classes alike; shift the curve to their true proportion
    w[0] += np.log(share / (1 - share)) - np.log(len(x1) / len(x0))
    return CompressionModel(made[1], made[0], tuple(map(float, w)))


def with_score(docs: DataFrame, model: CompressionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns and rows of docs, with a score from 0 to 1 (a column of that name is replaced).

    Null and empty texts get the curve's value at nothing. Texts of any length are read whole.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = model.scorer() if model.good else None
        for part in parts:
            if measure:
                yield pd.Series(measure([x.encode() if x else b"" for x in part]))
            else:
                yield pd.Series(1 / (1 + np.exp(-model.weights[0])), index=part.index)

    return docs.withColumn(score_col, score(F.col(text_col).cast("string")))


def keep_good(docs: DataFrame, model: CompressionModel, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of docs, with their own columns, that score at least `least`."""
    mark = free_name(docs.columns, "quality_score")
    return with_score(docs, model, text_col, mark).where(F.col(mark) >= least).drop(mark)
