"""Documents to packed training rows: quality, near duplicates, benchmark, mixture, packing.

Each stage is written as a table in the shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import compression, decontam, mixing, packing, queries, sketch
from rowtide.llm.common import written
from rowtide.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on labelled rows of the input, does not reject.

    Null and empty texts have the score of an empty text; equal texts have equal scores, so repeated
    rows stay or go together; all columns stay.
    """
    model = compression.train(docs, queries.table(spark, sf_dir, "labels"))
    return compression.keep_good(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (5-word shingles, 0.8).

    Null, empty and wordless texts are nobody's duplicates and stay; all columns stay.
    """
    return sketch.drop_near_duplicates(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay, as do repeated rows without one; all columns stay.
    """
    return decontam.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens that packing makes, by the target weights, each document once at most.

    Null and empty texts have no tokens and come along with their leaf's prefix; ties
    in its order go by id, repeated rows count each; further columns stay.
    """
    settings = queries.byte_pairs()
    tokens = packing.token_count(F.col("text"), settings["tokenizer_path"], settings["pattern"])
    return mixing.mix(docs, queries.MIXTURE, queries.mixture_levels(), 0.9, tokens=tokens, epochs=1, seed=17)


def packed_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of 2048 token ids, written as binary files and read back.

    Null and empty texts are an end alone, repeated rows are packed each, null ids stay null;
    other columns are not read.
    """
    return packing.through_files(docs, scratch_path(spark, "packed"), **queries.byte_pairs(), id_bytes=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("mixture", mixture),
    ("packing", packed_rows),
]

#: Trained, sketched and packed stages have no SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
