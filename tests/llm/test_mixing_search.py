"""Mixtures and nearest neighbours."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowtide.llm import collision, mixing, packing, queries
from rowtide.llm.mixing import Node

# ---- mixtures -----------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 500), st.lists(st.tuples(st.integers(0, 5), st.integers(0, 120)), min_size=1, max_size=6))
def test_shares(total, parts):
    weights, room = [float(p[0]) for p in parts], [p[1] for p in parts]
    found = mixing.share_out(total, weights, room)
    usable = sum(r for w, r in zip(weights, room, strict=True) if w)
    assert sum(found) == min(total, usable)
    assert all(0 <= f <= r and (w or not f) for f, w, r in zip(found, weights, room, strict=True))
    open_ = [(f / w) for f, w, r in zip(found, weights, room, strict=True) if w and f < r]
    assert not open_ or max(open_) - min(open_) <= 1  # in proportion, but for rounding


def test_shortage_goes_to_siblings_before_ancestors():
    tree = Node(1, {"a": Node(1, {"x": Node(1), "y": Node(1)}), "b": Node(1, {"x": Node(1), "y": Node(3)})})
    supply = {("a", "x"): 10, ("a", "y"): 500, ("b", "x"): 20, ("b", "y"): 30}
    assert mixing.budgets(tree, 2, supply, 200, 1) == {("a", "x"): 10, ("a", "y"): 140, ("b", "x"): 20, ("b", "y"): 30}
    assert mixing.budgets(tree, 2, supply, 60, 1) == {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 8, ("b", "y"): 22}
    assert sum(mixing.budgets(tree, 2, supply, 10_000, 2).values()) == 1120


TREE = Node(1, {"web": Node(3, {"en": Node(2), "*": Node(1)}), "*": Node(1, {"en": Node(1), "de": Node(1), "zero": Node(0)})})


def leaf_of(domain, lang):
    top = domain if domain == "web" else "*"
    names = TREE.children[top].children
    return (top, lang) if lang in names and lang != "*" else ((top, "*") if "*" in names else None)


def brute_mix(spark, rows, total, epochs, seed):
    """Copies of each (id, leaf) by sorting whole leaves."""
    sizes = {}
    for i, domain, lang, text in rows:
        leaf = leaf_of(domain, lang)
        if leaf:
            key = (leaf, "" if i is None else str(i))
            sizes[key] = sizes.get(key, 0) + len((text or "").split())
    supply = {}
    for (leaf, _), n in sizes.items():
        supply[leaf] = supply.get(leaf, 0) + n
    if isinstance(total, float):
        total = int(total * sum(supply.values()) * epochs)
    budget = mixing.budgets(TREE, 2, supply, total, epochs)
    idents = sorted({k[1] for k in sizes})
    places = {}
    for e in range(epochs + 1):
        df = spark.createDataFrame([(x,) for x in idents], "x string")
        for r in df.select("x", mixing.order_key(seed, F.lit(e), F.col("x")).alias("p")).collect():
            places[e, r["x"]] = r["p"]
    out = {}
    for leaf, have in supply.items():
        whole = min(epochs, budget[leaf] // have) if have else 0
        rest = budget[leaf] - whole * have
        upto, fits = 0, True
        for _, ident in sorted((places[whole, i], i) for (x, i) in sizes if x == leaf):
            upto += sizes[leaf, ident]
            fits = fits and upto <= rest and rest > 0
            out[leaf, ident] = whole + int(fits)
    return {k: n for k, n in out.items() if n}


def corpus():
    rng = random.Random(4)
    rows = [(i, rng.choice(["web", "books", None]), rng.choice(["en", "de", "fr", "zero", None]), "w " * rng.randint(0, 40)) for i in range(700)]
    rows += [(1000 + i, "web", "en", "a b") for i in range(400)]  # a hot leaf
    return rows + [(5, "web", "en", "x y z")] * 3 + [(None, "web", "en", "n n")] * 2 + [(2000, "web", "fr", None), (2001, "web", "fr", "long " * 50_000)]


@pytest.mark.parametrize("total,epochs", [(3000, 1), (0.4, 2), (0.7, 3), (0, 1), (10**9, 2)])
def test_mixture_equals_brute_force(spark, total, epochs):
    rows = corpus()
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, domain string, lang string, text string, mix_copies string").repartition(5)
    levels = [F.col("domain"), F.col("lang")]
    found = mixing.mix(df, TREE, levels, total, epochs=epochs, seed=3, copies_col="copies")
    got = {}
    for r in found.collect():
        got[leaf_of(r.domain, r.lang), "" if r.doc_id is None else str(r.doc_id)] = r.copies
    assert got == brute_mix(spark, rows, total, epochs, 3)
    repeated = mixing.mix(df, TREE, levels, total, epochs=epochs, seed=3)
    assert repeated.columns == df.columns
    assert repeated.count() == (found.agg(F.sum("copies")).first()[0] or 0)


def test_deep_buckets_end_at_the_same_document(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, text string")
    run = lambda: sorted(map(str, mixing.mix(df, TREE, [F.col("domain"), F.col("lang")], 0.3, seed=9).collect()))
    first = run()
    monkeypatch.setattr(mixing, "BITS", 3)
    assert run() == first


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, domain string, lang string, text string")
    assert mixing.mix(df, TREE, [F.col("domain"), F.col("lang")], 0.5).collect() == []
    with pytest.raises(ValueError, match="deeper"):
        mixing.leaves(TREE, 1)


def test_word_counts(spark):
    rows = [(None,), ("",), (" a  b\n",), ("ä\tb",), ("one",)]
    df = spark.createDataFrame(rows, "text string").coalesce(1)
    assert [r[0] for r in df.select(mixing.word_count(F.col("text"))).collect()] == [0, 0, 2, 2, 1]


def test_registered_mixture_counts_tokens(spark, tmp_path, monkeypatch):
    settings_ = queries.byte_pairs()
    encoder = packing.byte_pair_encoder(settings_["tokenizer_path"], settings_["pattern"])
    rng = random.Random(5)
    rows = [(i, rng.choice(["en", "es", "zh"]), "src1", rng.choice(["the house ", "la años más ", "的一是\u3000"]) * rng.randint(1, 40)) for i in range(80)]
    rows += [(90, "en", "src1", "".join(rng.choice("abcXYZ019+/") for _ in range(30_000))), (91, "en", "src1", None), (92, "es", "src1", "")]
    tokens = {r[0]: len(encoder.encode_ordinary(r[3] or "")) for r in rows}
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    counted = df.select("doc_id", packing.token_count(F.col("text"), settings_["tokenizer_path"], settings_["pattern"]).alias("n"))
    assert {r.doc_id: r.n for r in counted.collect()} == tokens
    assert tokens[90] > 10_000
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.copies for r in queries.mix_sources(spark, str(tmp_path)).collect()}
    given_ = df.join(spark.createDataFrame(list(tokens.items()), "doc_id long, n long"), "doc_id")
    want = mixing.mix(given_, queries.MIXTURE, queries.mixture_levels(), 0.4, tokens=F.col("n"), epochs=2, seed=17, copies_col="copies")
    assert found == {r.doc_id: r.copies for r in want.collect()}
    words = mixing.mix(df, queries.MIXTURE, queries.mixture_levels(), 0.4, epochs=2, seed=17, copies_col="copies")
    assert found != {r.doc_id: r.copies for r in words.collect()}


# ---- nearest neighbours -------------------------------------------------------------------------------------------


def brute_nearest(rows, k):
    vectors = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in vectors:
        if q % 20 == 0:
            near = [(-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
            out[q] = sorted(near)[:k]
    return out


def recall(found, want):
    hits = total = 0
    for q, best in want.items():
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, len(best) + 1))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits, total = hits + len({i for _, i, _ in own} & {i for _, i in best}), total + len(best)
    return hits / max(total, 1)


@pytest.mark.parametrize("scale", [1.0, 7.0])
def test_neighbours(spark, scale):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, 24))
    x = centers[rng.integers(0, 6, 1500)] + 0.7 * rng.standard_normal((1500, 24))
    x *= scale * rng.uniform(0.5, 2, (1500, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    found = collision.nearest(df, F.col("vec_id") % 20 == 0, k=10, block_rows=400, query_rows=30).collect()
    want = brute_nearest(rows, 10)
    assert recall(found, want) >= 0.9
    scores = {(q, i): -s for q, best in want.items() for s, i in best}
    assert all(abs(r.score - scores[r.query_id, r.vec_id]) < 1e-9 for r in found if (r.query_id, r.vec_id) in scores)


def test_neighbour_edge_rows(spark):
    one = [1.0, 0.5, 0.0]
    rows = [(0, one), (20, one)] + [(i, one) for i in range(100, 160)]  # a vector with most of the rows
    rows += [(40, None), (60, []), (80, [0.0, 0.0, 0.0]), (1, [1.0, None, 2.0]), (2, [float("nan"), 1.0, 1.0]), (3, [float("inf"), 1.0, 1.0])]
    rows += [(None, one), (4, [-1.0, 0.0, 0.0]), (200, [1.0, 2.0]), (201, [2.0, 1.0]), (0, one), (220, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = collision.nearest(df, F.col("vec_id") % 20 == 0, k=5, block_rows=16, query_rows=2).collect()
    want = brute_nearest(dict(rows).items(), 5)
    got = {q: [(-r.score, r.vec_id) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in want}
    assert got == want and want[220] == [] and len(want[200]) == 1
    assert collision.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


# ---- the pipeline's mixture, by sorting whole leaves --------------------------------------------------------------


def order_by_hand(spark, docs, root, share, seed, tokens):
    """(doc_id, text) that the pipeline's mixture takes in one epoch; tokens counts those of a text."""
    rows = docs.select("doc_id", "lang", "source", "text", mixing.order_key(seed, F.lit(0), F.col("doc_id")).alias("place")).collect()
    refer = {f"src{i}" for i in range(1, 10)}
    by_leaf = {}
    for r in rows:
        domain = "web" if r.source == "src0" else "reference" if r.source in refer else "*"
        node, path = root, ()
        for name in (domain, r.lang, r.source):
            name = name if name in node.children else "*"
            node, path = node.children.get(name), (*path, name)
            if node is None:
                break
        if node is not None:
            by_leaf.setdefault(path, []).append((r.place, str(r.doc_id), tokens(r.text or ""), r.doc_id, r.text))
    supply = {p: sum(x[2] for x in xs) for p, xs in by_leaf.items()}
    budget = mixing.budgets(root, 3, supply, int(share * sum(supply.values())), 1)
    out = []
    for path, members in by_leaf.items():
        upto, whole = 0, supply[path] and budget[path] >= supply[path]
        for _, _, n, doc_id, text in sorted(members, key=lambda x: x[:2]):
            upto += n
            if not whole and upto > budget[path]:
                break
            if whole or budget[path] > 0:
                out.append((doc_id, text))
    return sorted(out)
