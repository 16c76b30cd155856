"""Quality, decontamination, token counts and licence notices."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowtide.llm import compression, decontam, licenses, rankmerge
from tests.conftest import SMALL, plan_of

WORDS = "in the house of my father there are many rooms and each has a window to the sea".split()


# ---- quality ------------------------------------------------------------------------------------------------------


def prose(rng, n=80):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def junk(rng, n=80):
    return " ".join(rng.choice(WORDS).upper() + rng.choice(["!!", "%%%", "$$$"]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = [(i, junk(rng) if i % 5 == 0 else prose(rng), int(i % 5 != 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], None) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels, dict((r[0], r[2]) for r in rows)


def test_held_out_quality(labelled):
    docs, labels, truth = labelled
    model = compression.train(docs, labels, sample=150)
    rows = compression.with_score(docs, model).withColumn("out", compression.held_out(F.col("doc_id"))).collect()
    out = [r for r in rows if r["out"]]
    assert 80 < len(out) < 160
    assert np.mean([(r["score"] >= 0.3) == truth[r["doc_id"]] for r in out]) > 0.97
    kept = {r["doc_id"] for r in compression.keep_good(docs, model).collect()}
    assert kept == {r["doc_id"] for r in rows if r["score"] >= 0.3}


def test_held_out_labels_are_not_learned_from(labelled):
    docs, labels, _ = labelled
    turned = labels.withColumn("quality", F.when(compression.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert compression.train(docs, labels, sample=150) == compression.train(docs, turned, sample=150)


def plain_features(text, good, bad):
    """The features of one text, worked out without numpy."""
    body = text.encode()
    coders = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (good, bad)]
    g, b = [sum(len(c.compress(body[i : i + 1024])) for i in range(0, len(body), 1024)) for c in coders]
    near, dense = (b - g) / max(g + b, 1), math.log((min(g, b) + 8) / (len(body) + 8))
    return 1, 10 * near, dense, 100 * near**2, dense**2, 10 * near * dense


def test_scores_equal_a_plain_version(spark, labelled):
    docs, labels, _ = labelled
    model = compression.train(docs, labels, sample=150)
    texts = ["", "x", prose(random.Random(5), 3000), junk(random.Random(6), 700), "same " * 9000, "\u00e9\u4e2d" * 3000]
    found = compression.with_score(spark.createDataFrame(enumerate(texts), "doc_id long, text string"), model).collect()
    for row, text in zip(sorted(found), texts, strict=True):
        z = sum(w * f for w, f in zip(model.weights, plain_features(text, model.good, model.bad), strict=True))
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


def test_curve_is_at_its_optimum():
    """No step in any direction lowers the penalised loss that the curve is the minimum of."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.ones((400, 1)), rng.normal(size=(400, 5))], axis=1)
    y = (x @ [0.5, 2, -1, 0, 0.3, 1] + rng.logistic(size=400) > 0).astype(float)

    def loss(w):
        z = x @ w
        return np.sum(np.log1p(np.exp(-z)) + (1 - y) * z) + 0.5e-2 * w @ w

    w = compression.curve(x, y)
    assert all(loss(w) <= loss(w + 1e-3 * step) for step in rng.normal(size=(200, 6)))


def test_training_reads_whole_texts(spark):
    """What tells the classes apart stands behind 40,000 characters that they share."""
    rng = random.Random(8)
    front = prose(rng, 6000)[:40_000]
    rows = [(i, front + (junk(rng, 2500) if i % 2 else prose(rng, 2500)), i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1 - r[2]) for r in rows], "doc_id long, quality int")
    model = compression.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in compression.with_score(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.5) == (y == 0) for i, _, y in rows]) > 0.97


def test_pieces_of_training_are_bounded_and_from_anywhere(spark):
    body = "".join(f"{i:08d}" for i in range(640_000))  # 5,000 pieces
    texts = spark.createDataFrame([(1, body), (2, None), (3, "")], "id long, text string")
    got = compression.least_pieces(texts, 300)
    at = sorted(body.index(x.decode()) // 1024 for x in got)
    assert len(got) == len(set(at)) == 300 and at[0] < 200 and at[-1] > 4800
    assert got == compression.least_pieces(texts.repartition(3), 300)
    assert len(compression.least_pieces(texts, 10_000)) == 5000


def test_quality_edge_rows(spark, labelled):
    docs, labels, _ = labelled
    model = compression.train(docs, labels, sample=150)
    rows = [(1, None, 9), (1, "", 9), (None, "x", 9), (2, prose(random.Random(1), 60_000), 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, SCORE int")
    found = compression.with_score(df, model).collect()
    assert len(found) == 4 and all(0 <= r["score"] <= 1 for r in found)
    assert found[0]["score"] == found[1]["score"]
    assert compression.keep_good(df, model).columns == df.columns
    empty = docs.limit(0)
    assert compression.with_score(empty, model).collect() == []


def test_quality_without_enough_labels(spark, labelled):
    docs, labels, _ = labelled
    none = compression.train(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in compression.with_score(docs, none).collect()} == {0.5}
    good = compression.train(docs, labels.where("quality = 1"))
    assert {r["score"] > 0.99 for r in compression.with_score(docs, good).collect()} == {True}
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    assert len(compression.with_score(docs, compression.train(docs, odd)).collect()) == docs.count()


# ---- decontamination ----------------------------------------------------------------------------------------------


def least_edits(item, text):
    """Edits of item against its best stretch of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def plain(text):
    return " ".join(text.lower().split())


def test_matches_equal_brute_force(spark):
    rng = random.Random(11)
    letters = "abcdefgh "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, text(rng.choice([8, 15, 40, 90, 160, 260]))) for i in range(14)]
    docs = []
    for d in range(90):
        body = text(rng.randint(0, 500))
        if d % 3:
            item = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, int(len(item) * 0.12))):
                at = rng.randrange(len(item))
                item[at : at + 1] = rng.choice([[], [rng.choice(letters)], [rng.choice(letters), item[at]]])
            at = rng.randint(0, len(body))
            body = body[:at] + "".join(item).upper() + body[at:]
        docs.append((d, body))
    found = decontam.benchmark_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = found.collect()
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in sorted(rows, key=lambda r: -r["edits"])}
    want = {}
    for d, body in docs:
        for i, item in items:
            item = plain(item)
            k = int(decontam.EDIT_SHARE * len(item))
            while k and len(item) - decontam.Q + 1 - k * decontam.Q < 1:
                k -= 1
            edits = least_edits(item, plain(body)) if item else 1
            if item and edits <= k:
                want[d, i] = edits
    assert got == want and len(want) > 25
    texts = dict(docs)
    for r in rows:  # places are those of the original text
        piece = plain(texts[r["doc_id"]][r["start_char"] : r["end_char"]])
        assert least_edits(plain(dict(items)[r["item_id"]]), piece) == r["edits"]


def test_items_cut_off_by_the_ends_of_a_text():
    rng = random.Random(2)
    item = "".join(rng.choice("abcdefgh ") for _ in range(200)).strip()
    index = decontam.Index([(1, item)], decontam.Q, decontam.EDIT_SHARE)
    k, m = index.edits[0], len(item)
    for cut in range(0, m, 3):
        for text in (item[cut:], item[: m - cut], "zz" + item[: m - cut], item[cut:] + "z"):
            found = index.matches(text)
            assert bool(found) == (least_edits(plain(item), plain(text)) <= k), cut


def test_decontamination_edge_rows(spark):
    item = "the quick brown fox jumps over the lazy dog and runs far away into the woods"
    wide = item.replace(" ", " \n\t ")
    rows = [(1, None), (2, ""), (3, "x " * 50_000 + wide + " y" * 50_000), (3, item), (None, item.title()), (4, "nothing here"), (5, item[:40])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, Benchmark_Matches int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (None, item), (10, "  ")], "item_id long, text string")
    found = sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in decontam.benchmark_matches(docs, bench).collect()), key=repr)
    assert found == sorted([(d, i, 0) for d in (3, 3, None) for i in (7, -1)], key=repr)
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 4, 5]
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 7
    assert decontam.benchmark_matches(docs.limit(0), bench).collect() == []
    assert sorted(r["item_id"] for r in decontam.benchmark_matches(docs, bench, block_chars=40).where("doc_id = 3").collect()) == [-1, -1, 7, 7]


def plain_ends(item, text):
    """(least edits, end) of item against stretches of text, for every end."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return [(e, j) for j, e in enumerate(row)]


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_every_place_of_an_item_is_found_in_repetitive_texts(data):
    """Equal places from the left are all found, and every near end outside them lies in or beside a match."""
    piece = st.sampled_from(["-", "--", "ab", "abc ", "-" * 30, "ab" * 20, "x", "abcdefgh"])
    made = lambda least, most: "".join(data.draw(st.lists(piece, min_size=least, max_size=most)))
    items = [x for _ in range(3) if (x := plain(made(2, 8)))]
    text = plain(made(0, 6) + (items[0] if items else "") + made(0, 30))
    index = decontam.Index(list(enumerate(items)), decontam.Q, decontam.EDIT_SHARE)
    found = index.matches(text)
    for i, item in enumerate(items):
        k = int(decontam.EDIT_SHARE * len(item))
        while k and len(item) - decontam.Q + 1 - k * decontam.Q < 1:
            k -= 1
        mine = [(a, b, e) for j, a, b, e in found if j == i]
        assert all(x[1] <= y[0] for x, y in zip(sorted(mine), sorted(mine)[1:], strict=False))
        covered = set().union(*(range(a, b) for a, b, _ in mine)) if mine else set()
        assert all(least_edits(item, text[a:b]) <= e <= k for a, b, e in mine)
        at = 0
        while (at := text.find(item, at)) >= 0:
            assert covered.intersection(range(at, at + len(item)))
            at += 1
        for edits, end in plain_ends(item, text):
            if edits <= k:  # its stretch holds the character before its end
                assert covered.intersection(range(max(0, end - len(item) - k), end)), (i, end)


def test_windows_of_a_text_change_nothing(monkeypatch):
    rng = random.Random(5)
    items = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([60, 200])))) for i in range(6)]
    items.append((6, "-" * 80))
    text = ""
    for _ in range(60):
        item = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 6)):
            item[rng.randrange(len(item))] = "z"
        text += "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 90))) + "".join(item)
    index = decontam.Index(items, decontam.Q, decontam.EDIT_SHARE)
    whole = index.matches(text)
    monkeypatch.setattr(decontam, "WINDOW", 97)
    monkeypatch.setattr(decontam, "ALIGNED", 41)
    assert index.matches(text) == whole and len(whole) > 20


def test_long_runs_against_items_of_runs():
    """A million dashes, and as many of a repeated pair, against a hundred items of them."""
    import resource
    import time

    items = [(i, "-" * (200 + i)) for i in range(50)] + [(50 + i, "ab" * (100 + i)) for i in range(50)]
    index = decontam.Index(items, decontam.Q, decontam.EDIT_SHARE)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.monotonic()
    dashes = index.matches("-" * 1_000_000)
    pairs = index.matches("ab" * 500_000)
    assert time.monotonic() - began < 60  # both texts; 30 s each
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # kB
    assert [x[1:] for x in dashes if x[0] == 0] == [(a, a + 200, 0) for a in range(0, 1_000_000, 200)]
    assert len([x for x in pairs if x[0] == 50]) == 5_000 and {x[0] for x in dashes + pairs} == set(range(100))
    assert len(decontam.Index([(1, "-")], decontam.Q, decontam.EDIT_SHARE).matches("-" * 100_000)) == 100_000


def test_blocks_of_a_benchmark_are_passes_of_their_own(spark):
    rng = random.Random(8)
    items = [(i % 17, "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 50, 120])))) for i in range(40)]
    items += [(1, items[1][1].upper()), (3, None), (None, "")]
    texts = [" ".join(rng.choice(items[:40])[1] for _ in range(3)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0], None, ""])), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontam.benchmark_matches(docs, bench).distinct().collect()))
    ten = sorted(map(tuple, decontam.benchmark_matches(docs, bench, block_chars=300).distinct().collect()))
    assert one == ten and len(one) > 60
    rows = [{r["doc_id"]: r["benchmark_matches"] for r in decontam.with_matches(docs, bench, block_chars=c).collect()} for c in (300, 2_000_000)]
    assert rows[0] == rows[1] and len(rows[0]) == 33
    clean = [sorted(r["doc_id"] for r in decontam.drop_contaminated(docs, bench, block_chars=c).collect()) for c in (300, 2_000_000)]
    assert clean[0] == clean[1] == [31, 32]
    path, blocks = decontam.item_blocks(bench, "item_id", "text", 300)
    parts = [decontam.block_items(path, b) for b in range(blocks)]
    assert blocks >= 8 and sum(map(len, parts)) == 41 and max(sum(len(t) for _, t in p) for p in parts) < 1_500


# ---- token counts -------------------------------------------------------------------------------------------------

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(VOCABULARY)
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdeinoth'sSTLVE  \n\t.!?123ΣσÀéüßİ日本한😀́ <|>½²_-"), max_size=60), max_size=4))
def test_counts_equal_the_library(texts):
    made = Tokenizer.from_file(VOCABULARY) if not hasattr(test_counts_equal_the_library, "made") else test_counts_equal_the_library.made
    test_counts_equal_the_library.made = made
    counter = rankmerge.Counter(rankmerge.merges(VOCABULARY), cache=50)
    assert counter.totals(texts) == [len(made.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_special_strings_and_runs(library):
    texts = ["a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "'s's'S don't we'll 'rest ''s !'s", "a" * 300, "lalala" * 100, "", "x" * 5000]
    assert rankmerge.Counter(rankmerge.merges(VOCABULARY)).totals(texts) == [library(t) for t in texts]


def test_counts_do_not_depend_on_parts(library, monkeypatch):
    text = " ".join(["Some words, and don't", "\n<|endoftext|> 12"] * 400)
    monkeypatch.setattr(rankmerge, "PART", 50)
    assert rankmerge.Counter(rankmerge.merges(VOCABULARY), cache=10).totals([text, text]) == [library(text)] * 2


def test_token_count_edge_rows(spark, library):
    rows = [(1, None, "q"), (2, "", "q"), (3, "one two", "q"), (3, "one two", "q"), (None, "three", "q"), (4, "word " * 100_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS string")
    found = rankmerge.with_token_counts(df, VOCABULARY)
    assert [r["n_tokens"] for r in found.collect()] == [0, 0, 2, 2, 1, 100_000]
    assert rankmerge.with_token_counts(df.limit(0), VOCABULARY).collect() == []


# ---- licence notices ----------------------------------------------------------------------------------------------


def test_notices(spark):
    mit = next(t for _, n, t in licenses.TEMPLATES if n == "mit-text")
    wrapped = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))
    rows = [
        (1, "some words\nLicensed under the Apache License, Version 2.0.\nmore"),
        (2, "intro here\n\n" + mit + "\n\nbye"),
        (3, "# This work is licensed under the GNU General Public License, version 2."),
        (4, "the licence of a fishing boat under the old version"),
        (5, None),
        (6, ""),
        (7, "MIT"),
        (8, "all rights reserved\n" * 3),
        (None, "Released under the MIT License."),
        (9, "word " * 40_000),
    ]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, dice double")
    found = sorted(((r.doc_id, r.unit, r.number, r.license) for r in licenses.notices(df).collect()), key=repr)
    want = [(1, "line", 1, "Apache-2.0"), (2, "line", 1, "MIT"), (3, "line", 0, "GPL-2.0"), (None, "line", 0, "MIT")]
    want += [(8, "line", i, "all-rights-reserved") for i in range(3)] + [(8, "paragraph", 0, "all-rights-reserved")]
    # the whole paragraph of 1 (0.82) and the whole text of 2 (0.99) are near enough too
    want += [(1, "paragraph", 0, "Apache-2.0"), (2, "text", 0, "MIT")]
    assert [x for x in found if x[0] != 8 or x[1] == "line"] == sorted([x for x in want if x[0] != 8 or x[1] == "line"], key=repr)
    parts = licenses.notices(spark.createDataFrame([(1, "intro\n\n" + wrapped.replace(" \n", "\n"))], "doc_id long, text string")).where("unit = 'paragraph'").collect()
    assert [(r.license, r.dice > 0.8) for r in parts] == [("MIT", True)]
    assert licenses.notices(df.limit(0)).collect() == []
    assert licenses.notices(df, templates=[]).collect() == []


def test_notices_inside_other_words(spark):
    mit = next(t for _, n, t in licenses.TEMPLATES if n == "mit-text")
    apache = next(t for _, n, t in licenses.TEMPLATES if n == "apache-header")
    cut = mit.index("The above"), mit.index("THE SOFTWARE IS")
    parts = [mit[: cut[0]], mit[cut[0] : cut[1]], mit[cut[1] :]]
    commented = "\n#\n".join("\n".join("# " + p[i : i + 60] for i in range(0, len(p), 60)) for p in parts)
    code = "".join(f"def f{i}(x{i}):\n    return x{i} + {i}\n\n" for i in range(100))
    rows = [
        (1, "Copyright 2021 Foo Inc. All rights reserved."),
        (2, "Released under the MIT License. All rights reserved."),
        (3, "The tool was written in 2019 and is licensed under the Apache License, Version 2.0, as many others are, so take it."),
        (4, code + "\n\n".join(parts) + "\n\n" + code),
        (5, f"#!/bin/sh\n{commented}\n{code}"),
        (6, code + "".join(f" * {x}\n" for x in apache.split(". ")) + code + "Licensed under CC BY 4.0.\n"),
        (7, "words of the software to be in the software " * 300),
        (8, "All rights reserved.\nCopyright Foo. All rights reserved. Copyright Bar. All rights reserved."),
    ]
    found = licenses.notices(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r.doc_id, r.unit, r.template) for r in found)
    every = "all-rights-reserved"
    want = [(1, "window", every), (2, "window", every), (2, "window", "mit-released"), (3, "window", "apache-licensed"), (4, "window", "mit-text"), (5, "window", "mit-text")]
    want += [(6, "line", "cc-by-short"), (6, "paragraph", "apache-header"), (8, "line", every), (8, "window", every), (8, "window", every)]
    assert got == want
    assert {r.number for r in found if r.doc_id in (1, 2)} == {0, 4, 5}
    assert all(r.dice >= 0.8 for r in found) and {round(r.dice, 9) for r in found if r.doc_id in (1, 2, 3)} == {1.0}


def test_notices_stay_in_the_jvm(spark):
    plan = plan_of(licenses.notices(spark.read.parquet(f"{SMALL}/documents.parquet")))
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange", "Join"))
