"""Each stage of the pipeline against a plain version, on its own input."""

import duckdb

import corpus_pipeline
from rowtide.llm import compression, decontam, mixing, packing, queries
from rowtide.llm.common import written
from tests.conftest import SMALL
from tests.llm.test_mixing_search import order_by_hand
from tests.llm.test_page_operators import encoded, put_together
from tests.llm.test_sketch import brute
from tests.llm.test_text_operators import least_edits, plain

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")

    good = written(STAGES["quality"](spark, docs, SMALL), "t1")
    model = compression.train(docs, queries.table(spark, SMALL, "labels"))
    score = model.scorer()
    assert rows_of(good) == [(i, t) for i, t in rows_of(docs) if score([(t or "").encode()])[0] >= 0.3]

    single = written(STAGES["near_duplicates"](spark, good, SMALL), "t2")
    kept = {i for i, _, _, keep in brute(rows_of(good), 5, 80) if keep}
    assert [i for i, _ in rows_of(single)] == sorted(kept)

    clean = written(STAGES["decontamination"](spark, single, SMALL), "t3")
    items = [plain(r[0]) for r in duckdb.execute(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()]
    texts = {i: plain(t) for i, t in rows_of(single)}
    hit = {i for i, t in texts.items() if any(x in t for x in items)}
    left = {i for i, _ in rows_of(clean)}
    assert not left & hit
    for i in set(texts) - left - hit:  # no exact copy: some item has few edits
        assert any(least_edits(x, texts[i]) <= decontam.EDIT_SHARE * len(x) for x in items)

    mixed = written(STAGES["mixture"](spark, clean, SMALL), "t4")
    settings = queries.byte_pairs()
    encoder = packing.byte_pair_encoder(settings["tokenizer_path"], settings["pattern"])
    assert rows_of(mixed) == order_by_hand(spark, clean, queries.MIXTURE, 0.9, 17, lambda text: len(encoder.encode_ordinary(text)))

    packed = STAGES["packing"](spark, mixed, SMALL).collect()
    assert put_together(packed, 2048) == encoded(rows_of(mixed))


def test_weights_of_the_mixture():
    leaves = mixing.leaves(queries.MIXTURE, 3)
    assert len(leaves) == len(set(leaves)) and all(w > 0 for path in leaves.values() for w in path)
