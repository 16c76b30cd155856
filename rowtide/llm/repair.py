"""Cheapest repair of conversations by Four-Russians block tables.

A conversation is repaired into (s?(ua)+)?, that is an optional system row and then user and
assistant rows in turn, by keeping, reroling, deleting and inserting rows. The edit costs of what
is left of a conversation are a vector over the four states of that language. Less their minimum
these vectors take a handful of values, so the step over a row, and over any block of BLOCK rows, is
worked out once for all (vector, block) and then looked up.

Vectors hold the costs to the end, so blocks are looked up from the last to the first. To trace the
edits, the vectors at the bounds of blocks are kept, each block is expanded backward from its own
right bound, and the walk forward takes the least letter that still gives the cheapest total:
of all cheapest repairs the one whose letters are least.

A long conversation is cut into segments of SEGMENT rows. A segment is a function from the vector at its
right to the one at its left, and, once that is known, from the state it is entered in to the one
it is left in. Tasks work out both for all arguments, and only these small functions meet for
each conversation; the letters of a conversation are one row of the result in any case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from rowtide.llm.common import runs, written
from rowtide.llm.merkle import leaf
from rowtide.operators.sequences import assign_serial

#: Rows of a block whose transitions are in the tables, and of a segment that one task step takes.
BLOCK = 4
SEGMENT = 4096

#: Costs of the edits.
REROLE, DELETE, INSERT, LEFT_CUT = 2, 3, 2, 1

#: States: nothing yet, system row, user row, assistant row. The state after an inserted or reroled row:
FOLLOW = (2, 2, 3, 2)
#: ... and after a row that is kept, by its role's initial (s, u, a, another).
KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
INITIALS = {"s": 0, "u": 1, "a": 2}
#: Costs to the end where no row is left: an accepted state, or one or two inserted rows before it.
END = (0, 2 * INSERT, INSERT, 0)
#: A row is 0 if it has to go, else 1 + 2 * role + (1 if its text is cut off).
SYMBOLS = 9

WHITE = " \t\n\x0b\x0c\r"


class Tables:
    """Normalised vectors, their steps over rows and blocks, and the edit that a step takes."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors: list[tuple[int, ...]] = [END]
        number = {END: 0}
        steps: list[list[tuple[int, int]]] = []
        self.edits: list[list[list[tuple[str, int]]]] = []
        for vector in self.vectors:  # grows while it is read
            steps.append([])
            self.edits.append([])
            for symbol in range(SYMBOLS):
                before, edits = self.step(vector, symbol)
                least = min(before)
                normal = tuple(x - least for x in before)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                steps[-1].append((number[normal], least))
                self.edits[-1].append(edits)
        self.to = np.array([[to for to, _ in row] for row in steps], np.int32)
        self.add = np.array([[add for _, add in row] for row in steps], np.int32)
        self.block_to, self.block_add = self.to, self.add
        for _ in range(block - 1):
            # one more row on the left of the blocks so far
            to, add = self.to[self.block_to], self.block_add[..., None] + self.add[self.block_to]
            self.block_to = to.swapaxes(1, 2).reshape(len(steps), -1)
            self.block_add = add.swapaxes(1, 2).reshape(len(steps), -1)
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)

    @staticmethod
    def step(after: tuple[int, ...], symbol: int) -> tuple[list[int], list[tuple[str, int]]]:
        """Costs before a row, by the state, and the least letter that gives them with the state after it."""
        role, cut = divmod(symbol - 1, 2)
        options: list[list[tuple[int, str, int]]] = []
        for state in range(4):
            options.append([(DELETE + after[state], "D", state)])
            if symbol:
                if state in KEEP[role]:
                    options[state].append((cut * LEFT_CUT + after[KEEP[role][state]], "K", KEEP[role][state]))
                options[state].append((REROLE + cut * LEFT_CUT + after[FOLLOW[state]], "R", FOLLOW[state]))
        costs = [min(x)[0] for x in options]
        for _ in range(3):
            costs = [min(costs[q], INSERT + costs[FOLLOW[q]]) for q in range(4)]
        edits = []
        for state in range(4):
            ways = [*options[state], (INSERT + costs[FOLLOW[state]], "I", FOLLOW[state])]
            edits.append(min((letter, to) for cost, letter, to in ways if cost == costs[state]))
        return costs, edits

    def codes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows before the first whole block, and the blocks by number; blocks end with the symbols."""
        rest = len(symbols) % self.block
        return symbols[:rest], symbols[rest:].reshape(-1, self.block).astype(np.int64) @ self.weights

    def function(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vector at the left and cost, for each vector at the right."""
        rest, blocks = self.codes(symbols)
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for code in blocks[::-1]:
            cost += self.block_add[at, code]
            at = self.block_to[at, code]
        for symbol in rest[::-1]:
            cost += self.add[at, symbol]
            at = self.to[at, symbol]
        return at, cost

    def trace(self, symbols: np.ndarray, right: int, states: list[int], last: bool) -> list[tuple[int, str]]:
        """State at the end and letters, for each state at the start, with the vector at the right."""
        rest, blocks = self.codes(symbols)
        bounds = [right]
        for code in blocks[::-1].tolist():
            bounds.append(int(self.block_to[bounds[-1], code]))
        bounds.reverse()
        parts = [(rest.tolist(), bounds[0])] if len(rest) else []
        whole = symbols[len(rest) :].tolist()
        parts += [(whole[i * self.block : (i + 1) * self.block], bounds[i + 1]) for i in range(len(blocks))]
        out = [(state, []) for state in states]
        for rows, vector in parts:
            vectors = [vector]
            for symbol in reversed(rows[1:]):
                vectors.append(int(self.to[vectors[-1], symbol]))
            vectors.reverse()
            for n, (state, letters) in enumerate(out):
                for symbol, after in zip(rows, vectors, strict=True):
                    letter = "I"
                    while letter == "I":
                        letter, state = self.edits[after][symbol][state]
                        letters.append(letter)
                out[n] = state, letters
        if last:
            for n, (state, letters) in enumerate(out):
                while END[state]:
                    letters.append("I")
                    state = FOLLOW[state]
                out[n] = state, letters
        return [(state, "".join(letters)) for state, letters in out]


@lru_cache(maxsize=2)
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def lines(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, key): the rows, key a digest of conversation, role and text. Null roles and texts are one space."""
    named = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), spaced(F.col(role_col)).alias("role"), spaced(F.col(text_col)).alias("text")
    )
    return named.withColumn("key", leaf(F.col("conv"), F.col("role"), F.col("text")))


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, place, initial, blank, duplicate, truncated) of lines; place numbers them in order, over all conversations.

    A conversation's rows stand by turn, nulls first, those of a turn by their key.
    """
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    marked = rows.select(
        "conv", "turn", "key",
        F.substring("role", 1, 1).alias("initial"),
        (shown == "").alias("blank"),
        (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("key"), F.asc("tie")]
    placed = written(assign_serial(marked, order, start=0, name="place").drop("tie"), "repair-rows")
    firsts = placed.where("not blank").groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies"))
    seen = placed.join(firsts.where("copies > 1").drop("copies"), "key", "left")
    repeated = ~F.col("blank") & F.coalesce(F.col("place") > F.col("first"), F.lit(False))
    return seen.select(
        "conv", "turn", "place", "initial", "blank", repeated.alias("duplicate"), (F.col("cut") & ~F.col("blank") & ~repeated).alias("truncated")
    )


def segments(rows: DataFrame, segment: int, block: int) -> DataFrame:
    """One row for each segment of (start, i, symbol, initial): its symbols and its function of the vector at its right."""

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables(block)
        for run in runs(batches, 2):
            symbols = run.column("symbol").to_numpy().astype(np.uint8)
            initials = run.column("initial").to_pylist()
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            to, cost = table.function(symbols)
            values = [run.column("start")[0].as_py(), run.column("segment")[0].as_py(), symbols.tobytes(), to.astype("<i4").tobytes(), cost.astype("<i8").tobytes()]
            values += [illegal, initials[0], initials[-1]]
            names = ["start", "segment", "symbols", "to", "cost", "illegal", "first", "last"]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, SEGMENT_TYPES, strict=True)], names=names)

    dealt = rows.select("start", F.expr(f"i div {segment}").alias("segment"), "i", "symbol", "initial")
    dealt = dealt.repartition("start", "segment").sortWithinPartitions("start", "segment", "i")
    return dealt.mapInArrow(worked, "start long, segment long, symbols binary, to binary, cost binary, illegal long, first string, last string")


SEGMENT_TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string()]


def joined(rows: DataFrame, values: list[str], name: str) -> DataFrame:
    """(start, name): the values of a conversation's segments as an array in order."""
    return rows.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("segment", *values))).alias(name))


def bounds(parts: DataFrame) -> DataFrame:
    """(start, rights, cost, illegal): the vector at the right of each segment, the whole cost, and pairs of adjacent roles that may not follow."""

    @F.arrow_udf("struct<rights array<int>, cost long, illegal long>")
    def chained(column: pa.Array) -> pa.Array:
        out = []
        for own in column.to_pylist():
            rights, at, cost = [], 0, 0
            for part in reversed(own):
                rights.append(at)
                cost += int(np.frombuffer(part["cost"], "<i8")[at])
                at = int(np.frombuffer(part["to"], "<i4")[at])
            cost += tables().vectors[at][0]
            illegal = sum(p["illegal"] for p in own)
            illegal += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
            out.append({"rights": rights[::-1], "cost": cost, "illegal": illegal})
        return pa.array(out, pa.struct([("rights", pa.list_(pa.int32())), ("cost", pa.int64()), ("illegal", pa.int64())]))

    found = joined(parts, ["to", "cost", "illegal", "first", "last"], "own").select("start", chained("own").alias("found"))
    return found.select("start", "found.*")


def letters(parts: DataFrame, rights: DataFrame, block: int) -> DataFrame:
    """(start, audit): the letters of each conversation's edits."""
    path = pa.struct([("state", pa.int32()), ("letters", pa.string())])

    @F.arrow_udf("array<struct<state int, letters string>>")
    def traced(symbols: pa.Array, right: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        table, out = tables(block), []
        for s, r, a, b in zip(symbols.to_pylist(), right.to_pylist(), first.to_pylist(), last.to_pylist(), strict=True):
            found = table.trace(np.frombuffer(s, np.uint8), r, [0] if a else [0, 1, 2, 3], b)
            out.append([{"state": state, "letters": text} for state, text in found])
        return pa.array(out, pa.list_(path))

    @F.arrow_udf("string")
    def chosen(column: pa.Array) -> pa.Array:
        out = []
        for own in column.to_pylist():
            state, texts = 0, []
            for part in own:
                way = part["ways"][state]
                texts.append(way["letters"])
                state = way["state"]
            out.append("".join(texts))
        return pa.array(out, pa.string())

    at = rights.select("start", F.posexplode("rights").alias("segment", "right"), (F.size("rights") - 1).alias("end"))
    at = at.withColumn("segment", F.col("segment").cast("long"))
    ways = parts.select("start", "segment", "symbols").join(at, ["start", "segment"])
    ways = ways.select("start", "segment", traced("symbols", "right", F.col("segment") == 0, F.col("segment") == F.col("end")).alias("ways"))
    return joined(ways, ["ways"], "own").select("start", chosen("own").alias("audit"))


def report(rows: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """One row for each conversation of `lines`: conv, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    marked = faults(rows)
    marked = written(marked, "repair-faults")
    counts = marked.groupBy("conv").agg(
        F.min("place").alias("start"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")),
    )
    counts = written(counts, "repair-counts")
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    symbol = F.when(F.col("blank") | F.col("duplicate"), 0).otherwise(1 + 2 * role + F.col("truncated").cast("int"))
    starts = counts.select(F.col("conv").alias("of"), "start")
    numbered = marked.join(starts, F.col("conv").eqNullSafe(F.col("of")))
    numbered = numbered.select("start", (F.col("place") - F.col("start")).alias("i"), symbol.alias("symbol"), "initial")
    parts = written(segments(numbered, segment, block), "repair-segments")
    right = written(bounds(parts), "repair-bounds")
    found = letters(parts, right.select("start", "rights"), block)
    return counts.join(right.drop("rights"), "start").join(found, "start").drop("start")


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, None, None) where a conversation begins, then (conv, role, text) for each of its repaired rows.

    Takes each conversation's letters (kind 0) and then its rows in order.
    """
    conv, audit, at, state = None, "", 0, 0
    for batch in batches:
        for own, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not kind:
                while at < len(audit):  # rows inserted at the end of the conversation before
                    yield conv, "assistant" if state == 2 else "user", ""
                    state, at = FOLLOW[state], at + 1
                conv, audit, at, state = own, text, 0, 0
                yield conv, None, None
                continue
            while audit[at] == "I":
                yield conv, "assistant" if state == 2 else "user", ""
                state, at = FOLLOW[state], at + 1
            if audit[at] == "K":
                yield conv, role, text
                state = KEEP[INITIALS[role[0]]][state]
            elif audit[at] == "R":
                yield conv, "assistant" if state == 2 else "user", text
                state = FOLLOW[state]
            at += 1
    while at < len(audit):
        yield conv, "assistant" if state == 2 else "user", ""
        state, at = FOLLOW[state], at + 1


def in_order(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's letters, then its rows in order, all in one partition."""
    conv, audit = F.col("conv"), F.col("audit").alias("text")
    heads = reports.select(conv, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("key"), F.lit("").alias("role"), audit)
    both = heads.unionByName(rows.select("conv", F.lit(1).alias("kind"), "turn", "key", "role", "text"))
    order = [F.asc_nulls_first("conv"), F.asc("kind"), F.asc_nulls_first("turn"), F.asc("key")]
    return both.repartition("conv").sortWithinPartitions(*order).select("conv", "kind", "role", "text")


def batched(rows: Iterator[tuple], schema: pa.Schema, at_once: int = 1000) -> Iterator[pa.RecordBatch]:
    for some in iter(lambda: list(islice(rows, at_once)), []):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv, place, role, text): the repaired rows of `lines`, numbered from 0 in each conversation."""
    conv = reports.schema["conv"].dataType
    schema = to_arrow_schema(StructType().add("conv", conv).add("place", "long").add("role", "string").add("text", "string"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for own, role, text in walked(batches):
            if role is None:
                place = 0
            else:
                yield own, place, role, text
                place += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(numbered(batches), schema)

    return in_order(rows, reports).mapInArrow(run, from_arrow_schema(schema))


def digests(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv, sha256): digest of a conversation's repaired rows, each as role:text, joined by line feeds.

    A digest is worked out over the rows in order, so the rows of a conversation pass through one
    task; they pass as a stream, and only a batch is held.
    """
    schema = to_arrow_schema(StructType().add("conv", reports.schema["conv"].dataType).add("sha256", "string"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, total, between = None, None, b""
        for own, role, text in walked(batches):
            if role is None:
                if total:
                    yield current, total.hexdigest()
                current, total, between = own, hashlib.sha256(), b""
            else:
                total.update(between + f"{role}:{text}".encode())
                between = b"\n"
        if total:
            yield current, total.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(hashed(batches), schema)

    return in_order(rows, reports).mapInArrow(run, from_arrow_schema(schema))


def repair_report(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, block: int = BLOCK
) -> DataFrame:
    """One row for each conversation: its faults, its cheapest repair and the digest of the repaired rows.

    A conversation's rows stand by turn, nulls first; rows of a turn stand by a digest of role and
    text, equal rows side by side. Null roles and texts are one space; rows with a null
    conversation are a conversation of their own. A row's first fault counts: blank (white space alone),
    duplicate (role and text seen earlier), truncated (does not end in . ! or ?). `gaps` counts the turn
    numbers that are missing between the first and the last, `illegal` the adjacent roles that do not
    follow one another. `audit` has a letter for each edit in order, K, R, D or I, `cost` is their cost. An
    empty table has no conversations; other columns are not read.
    """
    own = lines(rows, conv_col, turn_col, role_col, text_col)
    found = written(report(own, segment, block), "repair-report")
    sums = digests(own, found).withColumnRenamed("conv", "of")
    whole = found.join(sums, F.col("conv").eqNullSafe(F.col("of")))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(F.col("conv").alias(conv_col), *counts, "audit", F.col("sha256").alias("repaired_sha256"))
