"""Byte-pair ids by prefixes against the vocabulary's library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowtide.llm import prefixbpe, queries
from tests.conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
SETTINGS = {"path": PATH, "pattern": public_tokenizers.PATTERN}
MODEL = prefixbpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return prefixbpe.Encoder(prefixbpe.prefixes(PATH), public_tokenizers.PATTERN)


def as_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


def test_every_token_gives_itself(encoder):
    assert all(encoder.prefixes.encode(s) == [t] for t, s in MODEL.bytes.items() if s not in MODEL.special)


ODD = st.text(st.sampled_from("abehilnorst  \n\t'stremldvTHE019.,!?-—é漢🙂\x1c\x85 <|>_"), max_size=60)


@given(st.one_of(ODD, st.text(max_size=60)), st.booleans())
@settings(max_examples=400, deadline=None)
def test_fuzzed_texts(encoder, library, text, special):
    text = text[:7] + "<|endoftext|>" * special + text[7:]
    ids, back = as_library(library, text)
    assert encoder.ids(text) == ids
    assert prefixbpe.text_of(MODEL, ids) == back == text


@given(st.lists(st.integers(0, 50256), max_size=12))
@settings(max_examples=200, deadline=None)
def test_decoding_any_ids(encoder, library, ids):
    assert prefixbpe.text_of(MODEL, np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


@given(st.lists(st.integers(0, 50255), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_joined_tokens(encoder, ids):
    """Ids of any byte string by merging the lowest-ranked pair, leftmost first."""
    model = MODEL
    piece = b"".join(model.bytes[i] for i in ids)
    one = {s: t for t, s in model.bytes.items() if len(s) == 1}
    parts = [one[piece[i : i + 1]] for i in range(len(piece))]
    while True:
        ranked = [(model.rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in model.rank]
        if not ranked:
            break
        _, i = min(ranked)
        joined = model.bytes[parts[i]] + model.bytes[parts[i + 1]]
        parts[i : i + 2] = [next(t for t, s in model.bytes.items() if s == joined and t in model.made_by)]
    assert encoder.prefixes.encode(piece) == parts


def test_windows_cut_nothing(encoder):
    rng = random.Random(5)
    for size in (4, 7, 50):
        for _ in range(300):
            text = "".join(rng.choice("ab1 \n'srevl.é") for _ in range(200))
            found = [m for some in prefixbpe.pieces(encoder.pattern, text, size) for m in some]
            assert found == encoder.pattern.findall(text)


def test_long_runs_take_linear_time(encoder, library):
    for text in ("-" * 400_000, "a" * 100_000, " " * 400_000, "\n\t" * 50_000):
        ids = encoder.ids(text)
        assert prefixbpe.text_of(MODEL, ids) == text
    short = "-" * 3000
    assert encoder.ids(short) == as_library(library, short)[0]


def test_edge_rows(spark):
    rows = [(1, None, 7), (1, "", 7), (None, "x <|endoftext|>", 7), (2, "word " * 60_000, 7), (2, "word " * 60_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    got = prefixbpe.with_text(prefixbpe.with_ids(df, **SETTINGS), PATH).collect()
    assert [r["decoded"] for r in got] == [r[1] or "" for r in rows]
    assert [len(r["ids"]) // 4 for r in got[:3]] == [0, 0, 3]
    assert got[3]["ids"] == got[4]["ids"]
    assert prefixbpe.with_ids(df.limit(0), **SETTINGS).collect() == []
    both = prefixbpe.round_trip(df.withColumnRenamed("IDS", "other"), **SETTINGS).collect()
    assert [(r["doc_id"], r["other"], r["ids"], r["decoded"]) for r in both] == [(r["doc_id"], 7, g["ids"], g["decoded"]) for r, g in zip(both, got, strict=True)]
    assert prefixbpe.round_trip(df.limit(0), **SETTINGS).columns == ["doc_id", "ids", "decoded"]


def test_query(spark, library):
    got = {r.doc_id: r for r in queries.QUERIES["op13_prefix_bpe"](spark, SMALL).collect()}
    docs = queries.table(spark, SMALL, "documents").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids, back = as_library(library, doc.text or "")
        row = got[doc.doc_id]
        assert row.n_tokens == len(ids) // 4
        assert row.ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(prefixbpe, "PAIRS", 20)
    encoder = prefixbpe.Encoder(prefixbpe.Prefixes(MODEL), public_tokenizers.PATTERN, cache=4)
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("abenrst hiou") for _ in range(80))
        assert encoder.ids(text) == as_library(library, text)[0]
