"""Token counts by merging all pre-tokens of a batch at once.

A batch's new pre-tokens are held as one flat array of symbol numbers with the bounds of
each sequence. In a round every sequence looks up the rank of each adjacent pair, takes its
lowest, and applies it at all its places at the same time (of overlapping ones the
first, third, ...). A sequence without a ranked pair is done and leaves the arrays. What
is left of a sequence is its number of tokens.

The same pre-tokens come again and again, so a worker keeps the counts of those it has
seen, up to a bound; the result does not depend on it.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens whose counts a worker keeps.
CACHE = 400_000
#: Characters that are split into pre-tokens at a time.
PART = 1 << 20


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the others for the characters from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Merges:
    """Ranks of symbol pairs from a vocabulary file of word-end byte pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        model = spec["model"]
        vocab = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + end] for c in symbols], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [(vocab[a] * self.width + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int64)
        self.made = np.array([p[2] for p in pairs], np.int64)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word (none empty)."""
        out = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        last = np.cumsum(lengths) - 1
        sym[last] = self.final[raw[last]]
        who = np.repeat(np.arange(len(words)), lengths)
        none = len(self.keys)
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            real = (self.keys[at] == key) & (who[:-1] == who[1:])
            rank = np.append(np.where(real, self.ranks[at], none), none)
            starts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            sizes = np.diff(np.append(starts, len(who)))
            least = np.minimum.reduceat(rank, starts)
            done = least == none
            if done.any():
                out[who[starts[done]]] = sizes[done]
                live = np.repeat(~done, sizes)
                sym, who, rank, sizes, least = sym[live], who[live], rank[live], sizes[~done], least[~done]
                at = np.append(at, 0)[live]
                if not len(sym):
                    break
            else:
                at = np.append(at, 0)
            hit = rank == np.repeat(least, sizes)
            # in a run of overlapping places take every other one, from its first
            place = np.flatnonzero(hit)
            run = np.append(True, place[1:] != place[:-1] + 1)
            begin = np.maximum.accumulate(np.where(run, place, 0))
            place = place[(place - begin) % 2 == 0]
            sym[place] = self.made[at[place]]
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            sym, who = sym[keep], who[keep]
        return out


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def normalised(text: str) -> str:
    """NFC, then each character in lower case by itself (no final form of sigma)."""
    text = unicodedata.normalize("NFC", text)
    return text.replace("\u03a3", "\u03c3").lower()


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Parts of a text, cut at white space, which no pre-token holds."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


class Counter:
    """Tokens of whole texts."""

    def __init__(self, model: Merges, cache: int = CACHE):
        self.model, self.cache, self.known = model, cache, {}

    def totals(self, texts: list[str]) -> list[int]:
        known, model = self.known, self.model
        if len(known) > self.cache:
            known.clear()
        out, words, bounds, new = [0] * len(texts), [], [], {}
        held = 0

        def settle() -> None:
            nonlocal held
            if new:
                found = model.counts([w.encode() for w in new])
                known.update(zip(new, found.tolist(), strict=True))
            for (i, a, b) in bounds:
                out[i] += sum(map(known.__getitem__, words[a:b]))
            words.clear()
            bounds.clear()
            new.clear()
            held = 0

        for i, text in enumerate(texts):
            begin = 0
            for mark in [*model.special.finditer(text), None]:
                piece = text[begin : mark.start()] if mark else text[begin:]
                for part in parts(normalised(piece)):
                    got = model.pattern.findall(part)
                    bounds.append((i, len(words), len(words) + len(got)))
                    words += got
                    new.update((w, None) for w in got if w not in known)
                    held += len(got)
                    if held > PART:
                        settle()
                if mark:
                    out[i] += 1
                    begin = mark.end()
        settle()
        return out


def with_token_counts(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """All rows and columns of docs, with the tokens of the whole text.

    As the vocabulary's library counts them without begin, end or padding: text is put
    into NFC and lower case, white space separates, special strings inside a text are
    one token each. Null and empty texts have none. A column of the same name is replaced.
    Very long texts are split at white space, so only a single word bounds a step's memory.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(merges(path))
        for batch in batches:
            yield pa.array(counter.totals([x or "" for x in batch.to_pylist()]), pa.int64())

    return docs.withColumn(out_col, count(F.col(text_col).cast("string")))
