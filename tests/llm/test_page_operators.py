"""Capture archives, site templates and packed rows."""

import base64
import hashlib
import random
import resource
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowtide.llm import boilerplate, packing, queries, warc

# ---- captures -----------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, record_type string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def written(df, path, **options):
    warc.build_index(warc.write_archives(df, path, **options), path, block_lines=3)
    keys = df.select(warc.url_key(F.coalesce(F.col("url"), F.lit(""))).alias("urlkey"))
    return warc.read_records(path, warc.lookup(df.sparkSession, path, keys))


def test_archives_come_back_whole(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://{rng.choice('abc')}.example.org/{rng.randint(0, 9)}?q={i % 7}", rng.choice(["", "ä<p>", f"x{i % 40}" * 50]), "z") for i in range(300)]
    rows += [(1000 + i, "http://hot.example.org/", "same", "z") for i in range(200)]
    rows += [(2000, None, None, "z"), (2001, "not a url", "\r\n\r\n", "z"), (2002, "http://[bad", "x" * 300_000, "z"), (2003, "http://é.example/ü b\n", "y", "z")]
    found = written(spark.createDataFrame(rows, PAGES).repartition(7), str(tmp_path / "w")).collect()
    last = {}
    for i, _, html, _ in rows:
        last[html or ""] = max(i, last.get(html or "", -1))
    want = {(i, len((h or "").encode()), digest(h), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, _, h, _ in rows}
    assert {(r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == want
    assert len(found) == len(rows)
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(r.payload == texts[r.record_id] for r in found if r.record_type == "response")


def test_small_payloads_and_repeated_rows(spark, tmp_path):
    rows = [(1, "http://a/", "ab", ""), (2, "http://a/", "ab", ""), (3, "http://a/", "abc", ""), (4, "http://a/", "abc", ""), (4, "http://a/", "abc", ""), (None, "http://a/", "abc", ""), (None, "http://a/", "q" * 9, "")]
    found = written(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), least_bytes=3).collect()
    kinds = sorted(((r.record_id, r.record_type, r.refers_to) for r in found), key=repr)
    want = [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (4, "response", None), (None, "revisit", 4), (None, "response", None)]
    assert kinds == sorted(want, key=repr)


def test_an_empty_table_has_an_empty_archive(spark, tmp_path):
    assert written(spark.createDataFrame([], PAGES), str(tmp_path / "w")).collect() == []


def test_lookup_of_absent_and_repeated_keys(spark, tmp_path):
    rows = [(i, f"http://h{i % 20:02d}.org/", f"p{i}", "") for i in range(100)]
    path = str(tmp_path / "w")
    warc.build_index(warc.write_archives(spark.createDataFrame(rows, PAGES), path), path, block_lines=2)
    keys = spark.createDataFrame([("org,h03)/",), ("org,h03)/",), ("org,h99)/",), ("",), (None,)], "urlkey string")
    assert sorted(r.record_id for r in warc.lookup(spark, path, keys).collect()) == [3, 23, 43, 63, 83]


@pytest.mark.parametrize("url,key", [
    ("http://www.Example.org:80/a?b=1#c", "org,example,www:80)/a?b=1"), ("https://u:p@x.de", "de,x)/"), (None, ")"), ("/p", ")/p"), ("http://a.b/c d", "b,a)/c%20d"),
])
def test_keys(url, key):
    assert warc.reversed_host_key(url) == key


# ---- site templates -----------------------------------------------------------------------------------------------


def text(html, templates=()):
    return boilerplate.main_text(boilerplate.kept_blocks(boilerplate.parse(html)), set(templates))


@pytest.mark.parametrize("html,want", [
    ("", ""),
    ("plain  text\n &amp; more", "plain text & more"),
    ("<p>one<p>two<br>three</p>", "one\n\ntwo three"),
    ("<article><h1>T</h1><p>a <b>b</b>c</p></article><footer>f</footer>", "T\n\na bc"),
    ("<nav>menu</nav><div>body</div><aside>side</aside>", "body"),
    ("<div class='ad banner'>buy</div><div class='adult'>kept</div>", "kept"),
    ("<body><form><article><p>in a form</p></article></form><form>out <input></form>", "in a form"),
    ("<article><header><h2>Head</h2><span>by me</span></header><p>x</p><div class=comments><p>c</p></div></article>", "Head\n\nx"),
    ("<article><div class='entry-header'><h1>T</h1><i>2020</i></div><p>x</p><article class='comment'><p>reader</p></article></article>", "T\n\nx"),
    ("<div class='Header'><h1>Site</h1></div><p>x", "x"),
    ("<article><h1 class='entry-header'>T</h1><p>x</article>", "T\n\nx"),
    ("<article><p>x<script>var t='</p><p>no';</script>y</p><!-- <p>hidden</p> --></article>", "xy"),
    ("<article><p>cut off in a ta", "cut off in a ta"),
    ("<article><p>cut <b", "cut"),
    ("<article><p>x &lt;b&gt; &#65;&nbsp;&unknown; &am", "x <b> A &unknown; &am"),
    ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nb\n\n1 2\n\n3"),
    ("<main><p>m</p><article><p>longer text of the article</p></article></main>", "longer text of the article"),
    ("</p></div>stray<//><>", "stray<>"),
    ("<p hidden>no<p style='display: none'>no<p role=navigation>no<p>yes", "yes"),
    ("<style>p{}</style><title>t</title><textarea><p>x</textarea>y", "y"),
])
def test_main_text(html, want):
    assert text(html) == want


@pytest.mark.parametrize("html,want", [
    ("<div class='content-sidebar-wrap'><main><article><h1>T</h1><p>x</p></article></main><div class='sidebar'>s</div></div>", "T\n\nx"),
    ("<div class='has-sidebar'><article><p>the whole article</p></article><div class='comments'><article><p>a reader</p></article></div></div>", "the whole article"),
    ("<div id='no-comments'><div class='related-layout'><article><p>x</p><div class='share'>s</div></article></div></div>", "x"),
    ("<div class='masthead-page'><main><p>x</p></main></div>", "x"),
    ("<main><h1>T</h1><div class='content-sidebar-wrap'><article><p>the article in it</p></article></div></main>", "T\n\nthe article in it"),
    ("<main><h1>Title</h1><p>lead</p><article><p>text of the article</p></article></main>", "Title\n\nlead\n\ntext of the article"),
    ("<main><article><p>one</p></article><div><article><p>number two</p></article></div><article class='post-teaser'>t</article></main>", "one\n\nnumber two"),
    ("<div><article><p>one</p></article><article><p>number two</p></article></div><div><article>far</article></div>", "one\n\nnumber two"),
    ("<p>the text of a page without article</p><div class='related'><article><p>teaser</p></article></div>", "the text of a page without article"),
    ("<article><p>x</p></article><div class='related'><article><p>a teaser that is longer</p></article></div>", "x"),
    ("<div class='sidebar' hidden><article><p>no</p></article></div><nav class='menu'><article>no</article></nav><p>yes</p>", "yes"),
    ("<form class='search-page'><article><p>x</p></article></form>", "x"),
])
def test_layouts_keep_their_text(html, want):
    assert text(html) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/!-=\"' pabdivscriptarticle&;#\n"), max_size=120))
def test_any_markup_is_read(html):
    page = boilerplate.parse(html)
    assert isinstance(boilerplate.main_text(boilerplate.kept_blocks(page), set(page.hashes)), str)


@pytest.mark.parametrize("unit", ["<div>", "<div>x", "<p><span>", "</i><ul><li>", "<article>y", "<main><div>z<td>"])
def test_deep_pages_take_linear_time(unit):
    html = unit * 200_000
    started, process = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    page = boilerplate.parse(html)
    kept = boilerplate.kept_blocks(page)
    boilerplate.main_text(kept, set(page.hashes[:100]))
    assert time.process_time() - started < 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - process < 700_000


def brute_main_texts(rows, min_pages):
    parsed = [(i, u, boilerplate.parse(h or "")) for i, u, h in rows]
    counts = {}
    for _, u, page in parsed:
        host = boilerplate.host_of(u)
        for x in set(page.hashes):
            counts[host, x] = counts.get((host, x), 0) + 1
    out = []
    for i, u, page in parsed:
        host = boilerplate.host_of(u)
        found = {x for x in page.hashes if counts[host, x] >= min_pages}
        out.append((i, u, boilerplate.main_text(boilerplate.kept_blocks(page), found)))
    return sorted(out, key=repr)


def test_repeated_subtrees_go(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        host = "hot.org" if i % 3 == 0 else f"h{i % 9}.org"
        own = f"<div><p>{'words of this page ' * 3}{i}</p><section>see {rng.randint(0, 5)}</section></div>"
        rows.append((i, f"http://{host}/{i}", f"<body><div>Welcome to {host}</div>{own}<div><ul><li>Home<li>About {host}</ul></div></body>"))
    rows += [(500 + i, "http://copy.org/", "<div><p>one long text that is a copy</p></div>") for i in range(30)]
    rows += [(600, None, None), (601, "http://[bad", ""), (None, "http://hot.org/x", "<p>last"), (602, "http://x.org", "w " * 200_000), (602, "http://x.org", "<p>repeated id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, TEXT int")
    found = sorted(((r.page_id, r.url, r.text) for r in boilerplate.main_texts(df.repartition(5), min_pages=8).collect()), key=repr)
    assert found == brute_main_texts(rows, 8)
    texts = {i: t for i, _, t in found}
    assert texts[3].startswith("words of this page") and "Welcome" not in texts[3] and "Home" not in texts[3]
    assert texts[500] == "one long text that is a copy"
    assert all(r.n_chars == len(r.text) for r in boilerplate.main_texts(df).collect())
    assert boilerplate.main_texts(df.limit(0)).collect() == []


def test_copies_of_a_page_are_no_template(spark):
    plain_page = "<body><h1>Title</h1><p>first paragraph of it</p><p>second paragraph of it</p><p>third one</p></body>"
    parts = "<article><section>one section</section><div>one box</div><ul><li>a<li>b</ul><details>more of it</details><table><tr><td>cell</table></article>"
    rows = [(i, f"http{'s' * (i % 2)}://a.org/x?utm={i}", plain_page) for i in range(10)]
    rows += [(100 + i, "http://b.org/y", f"<body><div class=nav>{i}</div>{parts}</body>") for i in range(12)]
    rows += [(200 + i, f"http://c.org/{i}", f"<body><div>Welcome</div><div>{'own words ' * 3}{i}</div></body>") for i in range(10)]
    rows += [(300 + i, "http://c.org/0", rows[22][2]) for i in range(1500)]
    found = {r.page_id: r.text for r in boilerplate.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {found[i] for i in range(10)} == {"Title\n\nfirst paragraph of it\n\nsecond paragraph of it\n\nthird one"}
    assert {found[100 + i] for i in range(12)} == {"one section\n\none box\n\na\n\nb\n\nmore of it\n\ncell"}
    assert all(found[200 + i].startswith("own words") for i in range(10))
    assert len(found) == len(rows) and found[1799] == found[200]


def test_template_of_a_section_of_a_large_host(spark):
    """A box on 12 of 2,000 pages of a host goes, as it does on a host of 100."""
    for n in (100, 2000):
        rows = [(i, f"http://big.org/{i}", f"<body><div>{'words of its own ' * 4}{i}</div>{'<div>in this section</div>' * (i < 12)}</body>") for i in range(n)]
        found = {r.page_id: r.text for r in boilerplate.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert all(found[i] == f"{'words of its own ' * 4}{i}" for i in range(n))


# ---- packed rows --------------------------------------------------------------------------------------------------


def brute_best_fit(sizes, length):
    rows, rooms = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = [r for r in range(len(rows)) if rooms[r] >= sizes[i]]
        if fit:
            r = min(fit, key=lambda r: rooms[r])
        else:
            rows.append([])
            rooms.append(length)
            r = len(rows) - 1
        rows[r].append(i)
        rooms[r] -= sizes[i]
    return rows, rooms


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60), st.integers(32, 40))
def test_best_fit_decreasing(sizes, length):
    rows = packing.best_fit_decreasing(sizes, length)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    rooms = sorted(length - sum(sizes[i] for i in r) for r in rows)
    assert rooms == sorted(brute_best_fit(sizes, length)[1])


def encoded(docs):
    settings_ = queries.byte_pairs()
    encoder = packing.byte_pair_encoder(settings_["tokenizer_path"], settings_["pattern"])
    return {i: [*encoder.encode_ordinary(t or ""), settings_["end_id"]] for i, t in docs}


def put_together(rows, length):
    """Documents from packed rows, checking each row's shape."""
    out = {}
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == len(positions) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        assert (ids[r.n_tokens :] == 50256).all() and (positions[r.n_tokens :] == 0).all()
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert list(positions[a:b]) == list(range(b - a))
            out.setdefault(doc, {})[start] = list(ids[a:b])
    return {d: [x for _, piece in sorted(p.items()) for x in piece] for d, p in out.items()}


def test_packing_loses_no_token(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["the", "house", "Ärger", "12", "\n"]) for _ in range(rng.choice([0, 1, 9, 60, 400])))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "word " * 70_000), (903, "x\n" * 200_000)]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, ids int").repartition(3)
    rows = packing.pack(df, **queries.byte_pairs(), length=64, group_tokens=5000).collect()
    assert put_together(rows, 64) == encoded(docs)
    assert len({r.pack_id for r in rows}) == len(rows)
    assert packing.pack(df.limit(0), **queries.byte_pairs()).collect() == []
    plain = packing.pack(df, **{**queries.byte_pairs(), "end_id": None}, length=64).collect()
    assert {d for r in plain for d in r.doc_ids} == {d for d, t in docs if t}


def test_repeated_rows_and_null_ids_are_packed_each(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, **queries.byte_pairs(), length=16).collect()
    assert sorted((d for r in rows for d in r.doc_ids), key=repr) == [1, 1, None]


def test_long_texts_are_encoded_in_parts():
    settings_ = queries.byte_pairs()
    encoder = packing.byte_pair_encoder(settings_["tokenizer_path"], settings_["pattern"])
    rng = random.Random(1)
    text = "".join(rng.choice(["word", " ", "\n", "\n\n", " \n", "don't", "  x", "é", "\r\n"]) for _ in range(5000))
    assert list(packing.encode_whole(encoder, text, part=50)) == encoder.encode_ordinary(text)


def test_binary_files_come_back(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words here " * (i % 30)) for i in range(80)], "doc_id long, text string").repartition(3)
    rows = packing.pack(df, **queries.byte_pairs(), length=32).persist()
    manifest = packing.write_binary(rows, str(tmp_path / "b"))
    assert manifest.agg(F.sum("rows")).first()[0] == rows.count()
    key = lambda r: (tuple(r[0]), tuple(r[1]), tuple(r[2]))
    want = sorted(key((np.frombuffer(r.ids, "<u4"), r.cu_seqlens, np.frombuffer(r.positions, "<u4"))) for r in rows.collect())
    found = sorted(key((r.ids, r.cu_seqlens, r.positions)) for r in packing.read_binary(spark, str(tmp_path / "b"), length=32).collect())
    assert found == want
    rows.unpersist()


def test_packed_rows_come_back_whole(spark, tmp_path):
    docs = [(i, "some words here " * (i % 30)) for i in range(90)] + [(None, "no id at all"), (91, None), (91, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = packing.pack(df, **queries.byte_pairs(), length=32).persist()
    plain = lambda df: sorted((tuple(r)[1:] for r in df.collect()), key=repr)
    packing.write_binary(rows, str(tmp_path / "b"))
    back = packing.read_packed(spark, str(tmp_path / "b"), length=32)
    short = packing.through_files(df, str(tmp_path / "c"), **queries.byte_pairs(), length=32, id_bytes=2)
    assert back.columns == rows.columns and plain(back) == plain(short) == plain(rows)
    assert back.select("pack_id").distinct().count() == rows.count()
    rows.unpersist()


@pytest.mark.parametrize("run", [" ", "\t", "\n", "x", "\u3000", "-="])
def test_runs_without_a_break_are_packed(run):
    settings_ = queries.byte_pairs()
    encoder = packing.byte_pair_encoder(settings_["tokenizer_path"], settings_["pattern"])
    for text in (run * 1_000_000, "a" + run * 600_000 + "b\n" + run * 500_000):
        ids = packing.encode_whole(encoder, text)
        assert encoder.decode(ids.tolist()) == text
    short = ("a" + run * 37 + " b") * 20
    assert list(np.concatenate(list(packing._encoded(encoder, short, 10)))) == encoder.encode_ordinary(short)
