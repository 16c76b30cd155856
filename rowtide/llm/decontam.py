"""Benchmark passages in documents, found by the q-gram lemma.

An item of m characters that occurs in a text with at most k edits shares at least
m - q + 1 - k * q of its q-grams with the place it occurs at, and all of these hits lie
on diagonals (place in text minus place in item) at most k from each other. So each
hit is counted into diagonal bands of width 2k + 2 that overlap by half: one of them
holds every diagonal of the match. The stretches of text under the bands that reach
the bound are verified by banded alignment with the item.

A q-gram that an item repeats many times (a run of dashes) is not paired with each of
its places: its hits count for every band they could lie in, so the bound stays one that
no match can miss, and the work follows the length of the text and not its product with
the item's. Texts are searched in windows that overlap by the longest item.

Items lie in a written table in blocks of bounded size, which the tasks read. A block is a
pass over the documents of its own: a larger benchmark takes more passes, not more
memory. Each document is handled alone and whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm import files
from rowtide.llm.common import free_name, mixed, union_all, written
from rowtide.session import scratch_path

Q = 10
EDIT_SHARE = 0.08
#: Characters of benchmark items that a task holds together.
BLOCK_CHARS = 2_000_000
#: Characters of a text that are searched, and aligned, together.
WINDOW = 1 << 20
ALIGNED = 1 << 17
#: Places of a q-gram in an item up to which each is paired with the text's.
LIGHT = 4

MATCH = "array<struct<item_id:long,start_char:long,end_char:long,edits:int>>"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case with runs of white space as one blank, and where each came from."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    space = (raw <= 32) | (raw == 0xA0) | (raw == 0x2028) | (raw == 0x2029) | (raw == 0x3000)
    keep = ~space
    keep[1:] |= ~space[:-1]  # the first of a run
    place = np.flatnonzero(keep)
    out = raw[place].copy()
    out[space[place]] = 32
    out[(out >= 65) & (out <= 90)] += 32
    wide = np.flatnonzero(out > 127)
    if len(wide):
        kinds, which = np.unique(out[wide], return_inverse=True)
        low = [x.lower() if len((x := chr(int(c))).lower()) == 1 else x for c in kinds]
        out[wide] = np.array([ord(c) for c in low], np.uint32)[which]
    a, b = 0, len(out)
    while a < b and out[a] == 32:
        a += 1
    while b > a and out[b - 1] == 32:
        b -= 1
    return out[a:b], place[a:b]


def gram_keys(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram at each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(q):
        key = key * _BASE + codes[j : j + n]
    return mixed(key)


def aligned_ends(item: np.ndarray, region: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Least edits of item against a stretch of region that ends at each place, and where it starts.

    Semi-global alignment, row by row over the region; cells are only kept along the
    band that the region leaves (its length is that of the item and the band's width).
    None if no place has at most `most` edits; costs beyond are not exact.
    """
    n = len(region)
    if n < len(item) - most:
        return None  # the text ends before the item could
    cost = np.zeros(n + 1, np.int32)
    start = np.arange(n + 1, dtype=np.int32)
    steps = np.arange(n + 1, dtype=np.int32)
    far = len(item) + n + 1
    width = n - len(item) + 2 * most + 1  # the diagonals that can hold a match
    for i, c in enumerate(item, 1):
        low, high = max(0, i - most), min(n, i + width)
        a, b = max(low, 1), high + 1
        sub = cost[a - 1 : b - 1] + (region[a - 1 : b - 1] != c)
        gone = cost[a:b] + 1
        new = np.minimum(sub, gone)
        began = np.where(sub <= gone, start[a - 1 : b - 1], start[a:b])
        if low == 0:
            new, began = np.concatenate(([i], new)).astype(np.int32), np.concatenate(([0], began))
            a = 0
        # insertions: the running minimum of cost minus place
        lead = new - steps[a:b]
        best = np.minimum.accumulate(lead)
        first = np.maximum.accumulate(np.where(lead == best, steps[: len(lead)], 0))
        cost[a:b] = best + steps[a:b]
        start[a:b] = began[first]
        cost[max(0, a - 1) : a] = far
        if i == 1:
            cost[b:] = far
        if cost[a:b].min() > most:
            return None
    return cost, start


def exact_places(item: np.ndarray, flat: bytes, at: int, end: int) -> Iterator[int]:
    """Places of the item in code points [at, end) of flat (four bytes each), from the left, none overlapping another."""
    needle, at, end = item.tobytes(), at * 4, end * 4
    while (at := flat.find(needle, at, end)) >= 0:
        if at % 4:
            at += 1
        else:
            yield at // 4
            at += len(needle)


def near_places(item: np.ndarray, text: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(edits, start, end) of stretches of text with at most `most` edits that do not overlap.

    At each end the least edits count; of overlapping ones those with the fewest edits, then
    the earliest end.
    """
    reach, found = len(item) + most, []
    for at in range(0, max(1, len(text)), ALIGNED):
        base = max(0, at - reach)
        got = aligned_ends(item, text[base : at + ALIGNED], most)
        if got:
            cost, start = got
            fit = np.flatnonzero(cost <= most)
            fit = fit[fit + base > at] if at else fit
            found.append(np.stack([cost[fit], start[fit] + base, fit + base], axis=1))
    if not found:
        return []
    spots = np.concatenate(found)
    spots = spots[np.lexsort((spots[:, 2], spots[:, 0]))]
    taken, kept = np.zeros(len(text), bool), []
    for edits, a, b in spots.tolist():
        if a < b and not taken[a:b].any():
            taken[a:b] = True
            kept.append((edits, a, b))
    return kept


class Index:
    """Postings of the q-grams of a block of items. Items shorter than a q-gram, or too
    short for the bound to ask for one shared q-gram, are looked for exactly. Items that
    read alike are one entry with all their ids."""

    def __init__(self, items: list[tuple[int, str]], q: int, share: float):
        self.q, self.ids, self.codes, self.edits, self.least = q, [], [], [], []
        keys, owners, places, alike = [], [], [], {}
        for item_id, text in items:
            codes, _ = normal(text)
            if not len(codes):
                continue
            entry = alike.setdefault(codes.tobytes(), len(self.ids))
            if entry < len(self.ids):
                self.ids[entry].add(item_id)
                continue
            k = math.floor(share * len(codes))
            while k and len(codes) - q + 1 - k * q < 1:
                k -= 1
            self.ids.append({item_id})
            self.codes.append(codes)
            self.edits.append(k)
            self.least.append(max(1, len(codes) - q + 1 - k * q))
            g = gram_keys(codes, q)
            keys.append(g)
            owners.append(np.full(len(g), entry, np.int32))
            places.append(np.arange(len(g), dtype=np.int32))
        self.short = [i for i, c in enumerate(self.codes) if len(c) < q]
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.owner = np.concatenate(owners)[order] if keys else np.zeros(0, np.int32)
        self.place = np.concatenate(places)[order] if keys else np.zeros(0, np.int32)
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.bits = np.uint64(max(16, min(26, int(np.ceil(np.log2(len(self.keys) + 1))) + 5)))
        self.seen = np.zeros(1 << int(self.bits), bool)
        self.seen[self.keys >> (np.uint64(64) - self.bits)] = True
        self.least_ = np.array(self.least, np.int64)
        self.overlap = max((len(c) + k for c, k in zip(self.codes, self.edits, strict=True)), default=0)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(id, start, end, edits) in the text's own code points, sorted."""
        codes, came = normal(text)
        parts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in range(0, len(codes), WINDOW):
            for i, a, b in self.regions(codes[at : at + WINDOW + self.overlap]):
                parts[i].append((max(0, a + at), min(len(codes), b + at)))
        for i in self.short:
            parts[i].append((0, len(codes)))
        flat, found = codes.tobytes() if parts else b"", set()
        for i, spans in parts.items():
            for a, b in joined(spans):
                for edits, x, y in self.occurrences(i, codes, flat, a, b):
                    spot = int(came[x]), int(came[y - 1]) + 1, edits
                    found.update((item_id, *spot) for item_id in self.ids[i])
        return sorted(found)

    def occurrences(self, i: int, codes: np.ndarray, flat: bytes, a: int, b: int) -> Iterator[tuple[int, int, int]]:
        """(edits, start, end) of item i in codes[a:b]: equal ones from the left, then near ones between them."""
        item, k = self.codes[i], self.edits[i]
        m, at = len(item), a
        for x in exact_places(item, flat, a, b):
            yield 0, x, x + m
            if k and x - at >= m - k:
                yield from ((e, at + s, at + t) for e, s, t in near_places(item, codes[at:x], k))
            at = x + m
        if k and b - at >= m - k:
            yield from ((e, at + s, at + t) for e, s, t in near_places(item, codes[at:b], k))

    def regions(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to) of the stretches that reach the bound; they may go beyond the codes."""
        grams = gram_keys(codes, self.q)
        maybe = np.flatnonzero(self.seen[grams >> (np.uint64(64) - self.bits)])
        if not len(maybe) or not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, grams[maybe]), len(self.keys) - 1)
        real = self.keys[at] == grams[maybe]
        maybe, at = maybe[real], at[real]
        if not len(at):
            return
        key, of, times = np.unique(at, return_inverse=True, return_counts=True)
        n = self.count[key]
        post = np.repeat(self.first[key] - np.cumsum(n) + n, n) + np.arange(n.sum())
        which, item = np.repeat(np.arange(len(key)), n), self.owner[post]
        # an item with too few of its q-grams anywhere in the text cannot reach its bound in any band
        live = np.bincount(item, minlength=len(self.ids)) >= self.least_
        mine = live[item]
        if not mine.any():
            return
        post, which, item = post[mine], which[mine], item[mine]
        text_at, begin = maybe[np.argsort(of, kind="stable")], np.cumsum(times) - times
        order = np.argsort(item, kind="stable")
        cuts = np.flatnonzero(np.append(True, item[order][1:] != item[order][:-1]))
        for own in np.split(order, cuts[1:]):
            i, keys, places = int(item[own[0]]), which[own], self.place[post[own]].astype(np.int64)
            heavy = (np.bincount(keys) > LIGHT)[keys]
            light, many = keys[~heavy], np.unique(keys[heavy])
            hits = spread(begin[light], times[light])
            for a, b in self.bands(i, text_at[hits], np.repeat(places[~heavy], times[light]), np.sort(text_at[spread(begin[many], times[many])]), places[heavy]):
                yield i, a, b

    def bands(self, i: int, text_at: np.ndarray, item_at: np.ndarray, heavy_at: np.ndarray, heavy_places: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches under the bands of item i that hold enough of its q-grams.

        heavy_at are the places in the text of q-grams that the item holds often, at heavy_places.
        In a match each shared q-gram has a place of its own in the text and in the item.
        """
        slant = text_at - item_at  # where the item would begin in the text
        k, m, least = self.edits[i], len(self.codes[i]), self.least[i]
        half = k + 1
        for offset in (0, 1):  # two tilings of the diagonals, half a band apart
            band = (slant + offset * half) // (2 * half)
            order = np.lexsort((item_at, band))
            b_, p_, s_ = band[order], item_at[order], slant[order]
            new = np.ones(len(b_), bool)
            new[1:] = b_[1:] != b_[:-1]
            fresh = new.copy()
            fresh[1:] |= p_[1:] != p_[:-1]  # each q-gram of the item counts once
            cuts = np.flatnonzero(new)
            shared = np.add.reduceat(fresh.astype(np.int64), cuts) if len(cuts) else np.zeros(0, np.int64)
            if not len(heavy_at):
                low, high = np.minimum.reduceat(s_, cuts), np.maximum.reduceat(s_, cuts)
                good = shared >= least
                yield from zip((low[good] - k).tolist(), (high[good] + m + k).tolist(), strict=True)
                continue
            first, last = heavy_places.min(), heavy_places.max()
            ends = np.concatenate([b_[cuts], (np.array([heavy_at[0] - last, heavy_at[-1] - first]) + offset * half) // (2 * half)])
            grid = np.arange(ends.min(), ends.max() + 1)
            low = grid * 2 * half - offset * half
            high = low + 2 * half - 1
            total = np.searchsorted(heavy_at, high + last, "right") - np.searchsorted(heavy_at, low + first, "left")
            total = np.minimum(total, len(heavy_places))
            total[b_[cuts] - grid[0]] += shared
            good = total >= least
            yield from zip((low[good] - k).tolist(), (high[good] + m + k).tolist(), strict=True)


def spread(begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each entry, as many as its times."""
    return np.repeat(begin - np.cumsum(times) + times, times) + np.arange(times.sum())


def joined(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The spans with overlapping ones as one."""
    held = None
    for a, b in sorted(spans):
        if held and a <= held[1]:
            held = held[0], max(held[1], b)
        else:
            if held:
                yield held
            held = a, b
    if held:
        yield held


def item_blocks(benchmark: DataFrame, item_id_col: str, item_col: str, block_chars: int) -> tuple[str, int]:
    """A written table of the items, and the number of blocks it is dealt to by hash; only a sum comes to the driver."""
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("long"), F.lit(-1)).alias("id"), F.col(item_col).cast("string").alias("text")).where("text <> ''").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(chars / block_chars))
    path = scratch_path(benchmark.sparkSession, "benchmark")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)))
    dealt.repartition("block").write.partitionBy("block").parquet(path)
    return path, n_blocks


def block_items(path: str, block: int) -> list[tuple[int, str]]:
    """Items of a block; a block that got none has no folder."""
    store, root = files.folder(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True))
    items = []
    for info in found:
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                got = pq.read_table(file, columns=["id", "text"])
            items += zip(got["id"].to_pylist(), got["text"].to_pylist(), strict=True)
    return sorted(items)


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_col: str = "text",
    out_col: str = "benchmark_matches",
    q: int = Q,
    edit_share: float = EDIT_SHARE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """All rows and columns of docs, and an array of (item_id, start_char, end_char, edits).

    An item matches where it occurs with at most floor(edit_share * length) edits, after
    lower-casing and turning runs of white space into one blank; for short items the edits
    are lowered until the lemma asks for a shared q-gram, and items shorter than q match
    exactly only. Places are code points of the original text; of overlapping matches of
    an item the one with the fewest edits stays. Null and empty texts match nothing, null
    and empty items are nowhere, items without id count under id -1, items of one id that
    read alike count once. Equal occurrences count from the left, near ones between them by
    fewest edits, then by earliest end. A column of the array's name is replaced.

    Rows of a benchmark of several blocks get their matches by the digest of their text.
    """
    path, n_blocks = item_blocks(benchmark, item_id_col, item_col, block_chars)
    text = F.col(text_col).cast("string")
    if n_blocks == 1:
        return docs.withColumn(out_col, finder(path, 0, q, edit_share)(text))
    key = free_name([*docs.columns, out_col], "text_digest")
    digest = F.sha2(text.cast("binary"), 256).alias(key)
    hits = written(union_all([docs.select(digest, F.inline(finder(path, b, q, edit_share)(text))) for b in range(n_blocks)]), "benchmark-hits")
    fields = [c for c in hits.columns if c != key]
    lists = hits.distinct().groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).cast(MATCH).alias(out_col))
    kept = [c for c in docs.columns if c.lower() != out_col.lower()]
    found = docs.withColumn(key, digest).drop(out_col).join(lists, key, "left")
    return found.select(*kept, F.coalesce(out_col, F.array().cast(MATCH)).alias(out_col))


def finder(path: str, block: int, q: int, share: float):
    """Matches of each text with a block of the items, as an array."""

    @F.arrow_udf(MATCH)
    def find(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(block_items(path, block), q, share)
        types = {"item_id": pa.int64(), "start_char": pa.int64(), "end_char": pa.int64(), "edits": pa.int32()}
        for part in parts:
            ends, flat = [0], []
            for x in part:
                text = x.as_py()
                flat += index.matches(text) if text else []
                ends.append(len(flat))
            columns = zip(*flat, strict=True) if flat else [()] * 4
            rows = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], list(types))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return find


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_col: str = "text",
    q: int = Q,
    edit_share: float = EDIT_SHARE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per match: (doc_id, item_id, start_char, end_char, edits), as `with_matches` finds them."""
    path, n_blocks = item_blocks(benchmark, item_id_col, item_col, block_chars)
    text = F.col(text_col).cast("string")
    found = [docs.select(F.col(id_col).alias("doc_id"), F.inline(finder(path, b, q, edit_share)(text))) for b in range(n_blocks)]
    return union_all(found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with their own columns, that hold no benchmark item."""
    mark = free_name(docs.columns, "benchmark_matches")
    return with_matches(docs, benchmark, text_col, out_col=mark, **options).where(F.size(mark) == 0).drop(mark)
