"""The registered queries on the smallest data, beside their SQL, and the pipeline's stages."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import canonical, connect, oracle_result, spark_result
from rowtide.llm import queries
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    columns, rows = spark_result(queries.QUERIES[name](spark, SMALL))
    assert rows
    if name in queries.ORACLES:
        expected_columns, expected = oracle_result(connect(SMALL), queries.ORACLES[name])
        assert columns == expected_columns
        assert rows == expected


def test_registered():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) < set(names) and "pipeline" in names


def test_recall_of_the_neighbours(spark):
    found = queries.QUERIES["op3_collision_neighbours"](spark, SMALL).toPandas()
    rows = duckdb.execute(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hits = total = 0
    for query, own in found.groupby("query_id"):
        scores = x @ x[ids == query][0]
        scores[ids == query] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]])
        hits, total = hits + len(best & set(own["vec_id"])), total + 20
        assert list(own.sort_values("rank")["rank"]) == list(range(1, 21))
        assert np.allclose(own["score"], scores[np.searchsorted(ids, own["vec_id"])])
    assert total == 20 * len(ids[ids % 20 == 0]) and hits >= 0.9 * total


def test_pipeline_stages_pass_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {d for r in last.select("doc_ids").collect() for d in r[0]} == {r[0] for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SMALL).count() == last.count()
    assert canonical
