"""Exact byte-pair ids by dynamic programming over prefixes, and back.

Byte-pair merging gives every prefix of a pre-token exactly one last token: the vocabulary
token that ends there and is compatible with the last token of the prefix before it. Two tokens are
compatible if merging their joined bytes leaves their boundary alone. So one pass over the bytes
finds and stores the last token of each prefix, and following these from the end gives
the ids, in time linear in the bytes however long a pre-token is.

* The tokens that end at a place are read off a suffix automaton of the vocabulary: its state after
  a byte is the longest match, its suffix links lead to the shorter ones.
* The compatibility test walks the symbols that touch the boundary, on the left the last symbols of
  the merges that make the left token, on the right the first ones of the right token, in the
  order of merging, and looks for a merge of the two sides that comes before either side's next one.

A worker keeps answers of both, and the ids of pre-tokens it has seen, up to a bound; results do
not depend on it.
"""

from __future__ import annotations

import gc
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from rowtide.llm.rankmerge import byte_symbols

#: Pre-tokens and token pairs whose answers a worker keeps.
CACHE = 400_000
PAIRS = 500_000
#: Text that is encoded and decoded between two batches of results.
SLICE = 4 << 20
#: Characters that are split into pre-tokens at a time.
PART = 1 << 18
#: Characters that the split pattern looks at beyond the start of a match at most, white space and runs aside.
AHEAD = 3
NEVER = 1 << 60


class SuffixAutomaton:
    """All substrings of a set of byte strings; each state is a class of substrings with the same ends."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, at: int, byte: int, state: int) -> int:
        """The state for the shorter strings of `state`, those that `at` leads to by the byte."""
        copy = self._state(dict(self.next[state]), self.link[state], self.length[at] + 1)
        self.link[state] = copy
        while at >= 0 and self.next[at].get(byte) == state:
            self.next[at][byte] = copy
            at = self.link[at]
        return copy

    def add(self, string: bytes) -> None:
        """Adds a string and its substrings."""
        last = 0
        for byte in string:
            known = self.next[last].get(byte)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, byte, known)
                continue
            made, at = self._state({}, 0, self.length[last] + 1), last
            while at >= 0 and byte not in self.next[at]:
                self.next[at][byte] = made
                at = self.link[at]
            if at >= 0:
                met = self.next[at][byte]
                self.link[made] = met if self.length[met] == self.length[at] + 1 else self._split(at, byte, met)
            last = made

    def state(self, string: bytes) -> int:
        """The state of a string that is known to be a substring."""
        at = 0
        for byte in string:
            at = self.next[at][byte]
        return at


class Vocabulary:
    """Tokens, merges and special strings of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        byte_of = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        numbers: dict[str, int] = spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = {text.encode(): number for text, number in added.items()}
        self.special_pattern = regex.compile("|".join(sorted(map(regex.escape, added), key=len, reverse=True)) or r"(?!)")
        self.bytes: dict[int, bytes] = {n: bytes(byte_of[c] for c in s) for s, n in numbers.items() if s not in added}
        self.bytes.update({number: text for text, number in self.special.items()})
        #: (left, right) -> rank; token -> (left, right, rank) of the first merge that makes it
        self.rank: dict[tuple[int, int], int] = {}
        self.made_by: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = numbers[a], numbers[b]
            self.rank[left, right] = rank
            self.made_by.setdefault(numbers[a + b], (left, right, rank))
        self.ends: dict[int, list[tuple[int, int]]] = {}
        self.starts: dict[int, list[tuple[int, int]]] = {}
        self.whole: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at one end (side 1: the right) of a token while it is merged: (symbol, rank of the merge that takes it in)."""
        known = self.ends if side else self.starts
        if token not in known:
            parts, at = [], token
            while at in self.made_by:
                parts.append((at, self.made_by[at][2]))
                at = self.made_by[at][side]
            symbols = [at, *(t for t, _ in reversed(parts))]
            known[token] = list(zip(symbols, [*(rank for _, rank in reversed(parts)), NEVER], strict=True))
        return known[token]

    def joint(self, left: int, right: int) -> tuple[int, int] | None:
        """The first two symbols that are merged over the boundary of two tokens, if any."""
        ends, starts = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        while True:
            (a, taken_a), (b, taken_b) = ends[i], starts[j]
            rank = self.rank.get((a, b), NEVER)
            # of equal pairs in a row the leftmost is merged first
            if rank < taken_a and rank <= taken_b and rank != NEVER:
                return a, b
            if taken_a == taken_b == NEVER:
                return None
            if taken_a <= taken_b:
                i += 1
            else:
                j += 1

    def is_whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        if token not in self.whole:
            if token in self.made_by:
                left, right, _ = self.made_by[token]
                self.whole[token] = self.is_whole(left) and self.is_whole(right) and self.joint(left, right) == (left, right)
            else:
                self.whole[token] = len(self.bytes[token]) == 1
        return self.whole[token]


@dataclass(slots=True)
class Match:
    """A place in the automaton: a state, the length matched, the tokens that end here and the moves known so far."""

    state: int
    size: int
    chain: tuple[tuple[int, int, dict[int, bool]], ...]
    moves: dict[int, Match]


class Prefixes:
    """Last tokens of prefixes, by the matches of a suffix automaton of the vocabulary.

    A match is a state with the length that is matched; matches are made as they come up, and
    their moves and tokens are kept.
    """

    def __init__(self, model: Vocabulary):
        self.model, self.automaton = model, SuffixAutomaton()
        usable = [t for t, s in model.bytes.items() if s not in model.special and model.is_whole(t)]
        for token in usable:
            self.automaton.add(model.bytes[token])
        #: token -> the tokens it may or may not follow, as far as known; -1 stands for the start
        self.after: dict[int, dict[int, bool]] = {t: {-1: True} for t in usable}
        self.pairs = 0
        self.at_state: dict[int, list[int]] = {}
        for token in usable:
            self.at_state.setdefault(self.automaton.state(model.bytes[token]), []).append(token)
        self.start = Match(0, 0, (), {})
        self.matches = {(0, 0): self.start}

    def move(self, match: Match, byte: int) -> Match:
        """The match after one more byte."""
        moves, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        state, size = match.state, match.size
        while byte not in moves[state]:
            state = link[state]
            size = length[state]
        to = (moves[state][byte], size + 1)
        found = self.matches.get(to)
        if found is None:
            found = self.matches[to] = Match(*to, self.chain(*to), {})
        match.moves[byte] = found
        return found

    def chain(self, state: int, size: int) -> tuple[tuple[int, int, dict[int, bool]], ...]:
        """(length, token, what it may follow) of the tokens that end where a match ends, longest first."""
        found = []
        while state > 0:
            found += [(len(self.model.bytes[t]), t, self.after[t]) for t in self.at_state.get(state, ())]
            state = self.automaton.link[state]
        return tuple(sorted((x for x in found if x[0] <= size), key=lambda x: -x[0]))

    def follows(self, token: int, before: int) -> bool:
        """Whether two tokens are compatible."""
        if self.pairs > PAIRS:
            for known in self.after.values():
                known.clear()
                known[-1] = True
            self.pairs = 0
        self.pairs += 1
        found = self.after[token][before] = self.model.joint(before, token) is None
        return found

    def encode(self, piece: bytes) -> list[int]:
        """Ids of a pre-token."""
        last = [-1]  # of each prefix
        match = self.start
        for end, byte in enumerate(piece, 1):
            match = match.moves.get(byte) or self.move(match, byte)
            for size, token, after in match.chain:
                before = last[end - size]
                good = after.get(before)
                if good or (good is None and self.follows(token, before)):
                    last.append(token)
                    break
        out, end, strings = [], len(piece), self.model.bytes
        while end:
            token = last[end]
            out.append(token)
            end -= len(strings[token])
        out.reverse()
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def prefixes(path: str) -> Prefixes:
    made = Prefixes(vocabulary(path))
    gc.freeze()  # it stays as long as the worker; no collection has to look through it
    return made


def pieces(pattern: regex.Pattern, text: str, part: int = PART) -> Iterator[list[str]]:
    """The matches of a pattern that tiles any text, some at a time.

    In a window that ends before the text does, the last match, and those that start within AHEAD
    characters of its end, may be cut; they are looked for again in the next window.
    """
    start, size = 0, part
    while start < len(text):
        end = min(start + size, len(text))
        found = pattern.findall(text, start, end)
        if end < len(text):
            at = end - len(found.pop())
            while found and at - len(found[-1]) > end - AHEAD:
                at -= len(found.pop())
            if not found:
                size *= 2
                continue
            start, size = at, part
        else:
            start = end
        yield found


class Encoder:
    """Ids of whole texts, special strings included."""

    def __init__(self, prefixes: Prefixes, pattern: str, cache: int = CACHE):
        self.prefixes, self.pattern, self.cache = prefixes, regex.compile(pattern), cache
        #: ids of pre-tokens: those met since the last change, and those before
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, text: str) -> Iterator[bytes]:
        encode = self.prefixes.encode
        for found in pieces(self.pattern, text):
            if len(self.known) > self.cache // 2:
                self.known, self.older = {}, self.known
            known, older = self.known, self.older
            for piece in set(found).difference(known):
                ids = older.pop(piece, None)
                if ids is None:
                    ids = encode(piece.encode())
                    ids = struct.pack(f"<{len(ids)}I", *ids)
                known[piece] = ids
            yield b"".join(map(known.__getitem__, found))

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        model, out, start = self.prefixes.model, [], 0
        for mark in model.special_pattern.finditer(text):
            out += self._plain(text[start : mark.start()])
            out.append(struct.pack("<I", model.special[mark.group().encode()]))
            start = mark.end()
        out += self._plain(text[start:] if start else text)
        return b"".join(out)


def text_of(model: Vocabulary, ids: bytes) -> str:
    """The text of ids; ids the vocabulary lacks give nothing, broken UTF-8 the replacement character."""
    strings = model.bytes
    return b"".join([strings.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encoded(texts: Column, path: str, pattern: str) -> Column:
    """Ids of whole texts, as binary of little-endian unsigned 32-bit integers.

    As the library of the vocabulary file gives them without added begin or end: special strings
    inside a text become their ids. Null and empty texts have none. Very long texts, and very
    long runs without a break, are worked through in windows.
    """

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(prefixes(path), pattern)
        for batch in batches:
            yield pa.array([encoder.ids(x.as_py()) if x.is_valid else b"" for x in batch], pa.binary())

    return encode(texts.cast("string"))


def decoded(ids: Column, path: str) -> Column:
    """The text of ids as `encoded` makes them, special strings kept; null counts as no ids."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = vocabulary(path)
        for batch in batches:
            yield pa.array([text_of(model, x.as_py() or b"") for x in batch], pa.string())

    return decode(ids)


def with_ids(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All rows and columns of docs, with the ids of the whole text; a column of the same name is replaced."""
    return docs.withColumn(out_col, encoded(F.col(text_col), path, pattern))


def with_text(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All rows and columns, with the text that the ids stand for; a column of the same name is replaced."""
    return rows.withColumn(out_col, decoded(F.col(ids_col), path))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The other columns of docs with the ids of the whole text and the text decoded from them, in one pass.

    The same values as `with_ids` and `with_text` give; columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in (text_col.lower(), ids_col.lower(), out_col.lower())]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias(text_col))
    schema = StructType([*source.schema.fields[:-1], StructField(ids_col, BinaryType()), StructField(out_col, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, model = Encoder(prefixes(path), pattern), vocabulary(path)
        for batch in batches:
            texts = batch.column(len(kept))
            start = 0
            while start < batch.num_rows:
                ids, back, held = [], [], 0
                while start + len(ids) < batch.num_rows and held < SLICE:
                    text = texts[start + len(ids)].as_py() or ""
                    ids.append(encoder.ids(text))
                    back.append(text_of(model, ids[-1]))
                    held += len(text)
                rest = [batch.column(i).slice(start, len(ids)) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=schema.names)
                start += len(ids)

    return source.mapInArrow(run, schema)
