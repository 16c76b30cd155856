"""Main text of web pages without the parts that a site repeats.

Every page is parsed once. Its container subtrees are hashed from their tags, text and
children. Spark counts on how many pages of a host each hash stands, copies of one main text
counted once; subtrees on many of them are the site's template and are deleted, unless they
hold most of the page's text.
What the template does not give away, such as a menu on a host with few pages, goes by its markup:
navigation, header, footer, sidebar, form, script, advert, notice and comment elements.
The text of the article element stays, with its sibling articles and what its main element
says under a heading of its own, or of the whole body if there is none. A class or id that only
wraps the page's article or main marks nothing.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import written

#: A subtree is template text on at least so many pages of its host, whatever the host's size;
#: pages with the same kept text are one page here, as copies are no evidence of a template.
MIN_PAGES = 10
#: A template subtree with more than this share of a page's remaining text is kept on it.
MOST_TEXT = 0.5

_TAG = re.compile(r"""<(?:(!--)|([!?]|/(?![a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+>|[^>]*>?))""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")

RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
#: Subtrees of these are hashed and counted.
CONTAINER = frozenset("aside blockquote details dialog div dl footer form header menu nav ol p section table ul h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video nav aside footer header form button select datalist textarea dialog menu search title head".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"body", "html", "tbody", "thead", "tfoot", "tr", "caption", "legend"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section div main body html form".split())

# Words of class and id values, and roles, that mark what is not the article.
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments commentlist disqus respond cookie cookies consent gdpr notice banner newsletter subscribe signup popup modal "
    "overlay share sharing social related recommended recommendations widget toolbar pagination pager skip login search copyright".split()
)
# Those that may stand around the article's own title.
TITLE = frozenset("header masthead".split())
# Class names of article elements that are not the article.
NOT_ARTICLE = frozenset("comment comments reply ad advert advertisement teaser related promo".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


@dataclass
class Element:
    tag: str
    dropped: bool
    by_form: bool = False
    by_header: bool = False
    article: int = -1
    container: int = -1  # the innermost hashed container it is in, or is
    number: int = -1  # among hashed containers
    fixed: bool = False  # dropped by more than class and id values
    wrap: int = -1  # the innermost element around it that is marked by class or id
    place: int = 0  # number of the element
    main_place: int = -1  # of the innermost main element that counts
    in_main: bool = False  # of the open article and main elements the innermost is a main
    parts: list = field(default_factory=list)


@dataclass
class Page:
    """Blocks as (text, container, article, is a heading, wrap), hashes and parents of the containers, and what is known of each article."""

    blocks: list
    hashes: list
    parents: list
    articles: list  # (main or parent element it stands in, is a main, is a comment or teaser) by number
    wrapped: bool  # an article was dropped only for class or id values around it


def words(value: str) -> list[str]:
    return _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())


def named(attributes: str) -> set[str]:
    """Words of the class and id values."""
    return {w for name, *values in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for w in words(next((v for v in values if v), ""))}


def marked(attributes: str, tag: str) -> str:
    """Why an element is not part of the article by its attributes: `other`, else by its class or id `name` or `header`, or nothing."""
    reason = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            if tag == "article":
                if NOT_ARTICLE.intersection(value.lower().split()):
                    return "other"
            elif tag not in ("body", "html", "main"):
                found = CHROME.intersection(words(value))
                if found - TITLE:
                    reason = "name"
                elif found:
                    reason = reason or "header"
        elif name == "role":
            if value.strip().lower() in ROLES:
                return "other"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return "other"
    return reason


def parse(html: str) -> Page:
    """Blocks and container hashes of a page; broken markup is read as far as it goes.

    A page whose only articles stand in elements marked by class or id is read again with these:
    if those of one such element say more than all the rest, the mark was that of a wrapper.
    """
    page = read(html, False)
    if not page.wrapped or any(b[2] >= 0 and not page.articles[b[2]][1] for b in page.blocks):
        return page
    other = read(html, True)
    held: dict[int, int] = {}
    for b in other.blocks:
        held[b[4]] = held.get(b[4], 0) + len(b[0])
    rest = held.pop(-1, 0)
    best = max(held, key=lambda w: (held[w], -w), default=-1)
    if best < 0 or held[best] <= rest:
        return page
    other.blocks = [b for b in other.blocks if b[4] in (-1, best)]
    return other


def read(html: str, unwrap: bool) -> Page:
    """One reading of a page, with or without the articles inside elements that are marked by class or id."""
    root = Element("#root", False)
    stack = [root]
    blocks: list = []
    hashes: list = []
    parents: list = []
    open_tags: Counter = Counter()
    buffer: list[str] = []
    articles: list = []
    wrapped = False
    places = 0

    def add_text(text: str) -> None:
        top = stack[-1]
        top.parts.append(text)
        if not top.dropped:
            buffer.append(text)

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                top = stack[-1]
                blocks.append((text, top.container, top.article, top.tag in HEADING, top.wrap))

    def pop() -> None:
        top = stack[-1]
        if top.tag in BLOCK:
            flush()
        stack.pop()
        open_tags[top.tag] -= 1
        inner = "".join(x if isinstance(x, str) else f"\x01{x[0]}\x02" for x in top.parts)
        digest = xxhash.xxh3_64_intdigest(f"{top.tag}\x03{' '.join(inner.split())}")
        stack[-1].parts.append((digest,))
        if top.number >= 0:
            hashes[top.number] = digest

    at, size = 0, len(html)
    while at < size:
        found = _TAG.search(html, at)
        if not found:
            add_text(html[at:])
            break
        if found.start() > at:
            add_text(html[at : found.start()])
        at = found.end()
        comment, other, close, tag, rest = found.groups()
        if comment:
            end = html.find("-->", found.start() + 4)
            at = size if end < 0 else end + 3
            continue
        if other:
            end = html.find(">", at)
            at = size if end < 0 else end + 1
            continue
        tag = tag.lower()
        if close:
            while open_tags[tag]:
                if stack[-1].tag == tag:
                    pop()
                    break
                pop()
            continue
        if not rest.endswith(">"):
            break  # the page ends within a tag
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            at = size if not end else (html.find(">", end.start()) + 1 or size)
            continue
        if tag == "br" or tag in ("td", "th"):
            add_text(" ")
        if tag in CLOSES_P and open_tags["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in SCOPE or stack[i].tag in ("li", "td", "th", "blockquote"):
                    break
        siblings = SIBLINGS.get(tag, ())
        for i in range(len(stack) - 1, 0, -1) if any(open_tags[t] for t in siblings) else ():
            if stack[i].tag in siblings:
                while len(stack) > i:
                    pop()
                break
            if stack[i].tag in SCOPE:
                break
        if tag in BLOCK:
            flush()
        if tag in VOID:
            stack[-1].parts.append(f"<{tag}>")
            continue
        top = stack[-1]
        main = tag in ("article", "main") or "articlebody" in rest.lower()
        why = marked(rest, tag)
        if tag in HEADING and why == "header" and top.article >= 0:
            why = ""  # the title itself
        out = tag in DROPPED or bool(why)
        places += 1
        element = Element(tag, top.dropped or out, top.by_form, top.by_header, top.article, top.container, fixed=top.fixed, wrap=top.wrap, place=places)
        if why in ("header", "name") and (tag not in DROPPED or tag == "form"):
            element.wrap = places
        elif out and not (tag == "form" and not why):
            element.fixed = True
        if out and not top.dropped:
            element.by_form = tag == "form" and not why
            element.by_header = why == "header" or (tag in ("header", "hgroup") and not why)
        elif out:
            element.by_header = False
        if main and top.dropped and not out and (top.by_form or not top.fixed):
            if tag == "main" or top.wrap < 0 or unwrap:
                element.dropped = False  # a form around the whole page, or a wrapper
                element.wrap = -1 if tag == "main" else top.wrap
            else:
                wrapped = True
        if tag in HEADING and top.dropped and top.by_header and top.article >= 0 and why not in ("other", "name"):
            element.dropped = False  # the title in the article's own header
        if main and not element.dropped:
            element.article = len(articles) if top.article < 0 or tag == "article" and top.in_main else top.article
            if element.article == len(articles):
                around = top.main_place if top.main_place >= 0 else top.place
                side = tag == "article" and not NOT_ARTICLE.isdisjoint(named(rest))
                articles.append((places if tag == "main" else around, tag == "main", side))
        if tag in CONTAINER and (top.article < 0 or tag not in ("p", "blockquote", *HEADING)):
            element.number = len(hashes)
            hashes.append(0)
            parents.append(top.container)
            element.container = element.number
        element.main_place = places if tag == "main" and not element.dropped else top.main_place
        element.in_main = tag == "main" if tag in ("article", "main") else top.in_main
        stack.append(element)
        open_tags[tag] += 1
    while len(stack) > 1:
        pop()
    flush()
    return Page(blocks, hashes, parents, articles, wrapped)


def kept_blocks(page: Page) -> tuple[list, list]:
    """Blocks (text, container) of the article and its siblings, or of the whole page if it has none, and the containers (hash, parent).

    A container stands behind its parent; -1 is none.
    Siblings are the articles of the same main element, or of the same parent if there is no main,
    but no comments or teasers. The main's own blocks stay if a heading is among them, or if they are most.
    """
    chosen = page.blocks
    sizes: dict[int, int] = {}
    for text, _, article, *_ in page.blocks:
        if article >= 0:
            sizes[article] = sizes.get(article, 0) + len(text)
    if sizes:
        best = max(sizes, key=lambda a: (sizes[a], -a))
        headed = {b[2] for b in page.blocks if b[3]}
        keep = {a for a in sizes if page.articles[a][0] == page.articles[best][0] and (a in headed if page.articles[a][1] else not page.articles[a][2])} | {best}
        chosen = [b for b in page.blocks if b[2] in keep]
    needed: set[int] = set()
    for _, c, *_ in chosen:
        while c >= 0 and c not in needed:
            needed.add(c)
            c = page.parents[c]
    order = sorted(needed)
    new = {c: n for n, c in enumerate(order)} | {-1: -1}
    return [(text, new[c]) for text, c, *_ in chosen], [(page.hashes[c], new[page.parents[c]]) for c in order]


def main_text(kept: tuple[list, list], templates: set[int], most_text: float = MOST_TEXT) -> str:
    """Blocks joined by an empty line, without those of template subtrees."""
    blocks, containers = kept
    sizes = [0] * len(containers)
    for text, c in blocks:
        if c >= 0:
            sizes[c] += len(text)
    held: dict[int, int] = {}
    for c in range(len(containers) - 1, -1, -1):
        key, parent = containers[c]
        if parent >= 0:
            sizes[parent] += sizes[c]
        if key in templates:
            held[key] = held.get(key, 0) + sizes[c]
    total = sum(len(text) for text, _ in blocks)
    gone: list[bool] = []
    for key, parent in containers:
        gone.append((parent >= 0 and gone[parent]) or (key in held and held[key] <= most_text * total))
    return "\n\n".join(text for text, c in blocks if c < 0 or not gone[c])


def text_digest(kept: tuple[list, list]) -> int:
    """Digest of the kept text, whatever its markup."""
    return xxhash.xxh3_64_intdigest("\n\n".join(text for text, _ in kept[0]).encode("utf-8", "replace"))


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def main_texts(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = MIN_PAGES,
    most_text: float = MOST_TEXT,
) -> DataFrame:
    """(page_id, url, text, n_chars) of each row.

    Blocks are the runs of text between block elements, with references decoded and white space
    as one blank; a br or a table cell is white space. Null, empty and textless pages have
    an empty text. Repeated rows have rows of their own here, but pages of a host with the same
    kept text count once towards its templates. Pages without a readable host
    count as one host of that kind. Scripts and other raw text that never ends take the rest of the page. Other columns are not read.
    """
    parsed = "uid long, page_id long, url string, host string, digest long, hashes array<long>, held array<long>, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: list[tuple] = []
            for ident, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = parse(html or "")
                kept = kept_blocks(page)
                held = sorted({signed(h) for h, _ in kept[1]})
                body = json.dumps(kept, ensure_ascii=False).encode("utf-8", "replace")
                rows.append((number, ident, url, host_of(url), signed(text_digest(kept)), sorted({signed(h) for h in page.hashes}), held, coder.compress(body)))
                number += 1
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            names = [x.split()[0] for x in parsed.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    source = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    # written once, so that uids stay and pages are parsed once
    table = written(source.mapInArrow(run, parsed), "pages")
    # a subtree counts once for each main text, on whichever copies of the page it stands
    subtrees = table.select("host", "digest", F.explode("hashes").alias("hash")).distinct()
    templates = subtrees.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "hash")
    # a page whose kept text lies in no counted subtree is not changed by any template and need not move
    plain = table.where("size(held) = 0").select("page_id", "url", "packed", F.lit(None).cast("array<long>").alias("templates"))
    rest = table.where("size(held) > 0")
    hits = rest.select("uid", "host", F.explode("held").alias("hash")).join(templates, ["host", "hash"])
    hits = hits.groupBy("uid").agg(F.collect_set("hash").alias("templates"))  # of one page
    joined = rest.join(hits, "uid", "left").select("page_id", "url", "packed", "templates").unionByName(plain)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for packed, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                texts.append(main_text(json.loads(coder.decompress(packed)), {h % (1 << 64) for h in found or ()}, most_text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return joined.mapInArrow(finish, "page_id long, url string, text string, n_chars long")
