"""Token ids packed into rows of equal length, best fit decreasing.

Texts become token ids; a document longer than a row is split into full rows and a rest, so
that no token is lost. Pieces are packed longest first, each into the open row with the
least room that still holds it. Rooms are whole numbers up to the row length, so a segment tree
over them finds that row, or that there is none, in log(length) steps.

Each task packs its own documents in groups of bounded size, without a shuffle: best
fit over a few thousand pieces already fills rows almost whole, and a task that is run again
makes the same rows from the same input.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rowtide.llm.files import folder, opened_as_stream, opened_for_write
from rowtide.llm.prefixbpe import pieces

LENGTH = 2048
#: Tokens that a task holds while it packs; bounds its memory.
GROUP_TOKENS = 2_000_000

PACKED = "pack_id string, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, doc_starts array<long>"
PACKED_NAMES = ("pack_id", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "doc_starts")
PACKED_TYPES = (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))


class Rooms:
    """Open rows by the room they have left, under a segment tree of counts."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.full = [False] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, row: int, room: int) -> None:
        if not room:
            return
        self.rows[room].append(row)
        node = self.size + room
        while node and not self.full[node]:
            self.full[node] = True
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least `need`, and that room."""
        node = self.size + need
        if not self.full[node]:
            # up to the first right sibling that holds rows, then down its left side
            while node > 1 and not (node % 2 == 0 and self.full[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.full[2 * node] else 2 * node + 1
        room = node - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.full[node] = False
            node >>= 1
            while node and not (self.full[2 * node] or self.full[2 * node + 1]):
                self.full[node] = False
                node >>= 1
        return row, room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; equal pieces keep their order."""
    rows: list[list[int]] = []
    rooms = Rooms(length)
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.take(sizes[piece])
        if found:
            row, room = found
        else:
            rows.append([])
            row, room = len(rows) - 1, length
        rows[row].append(piece)
        rooms.add(row, room - sizes[piece])
    return rows


def split(total: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a document."""
    return [(at, min(length, total - at)) for at in range(0, total, length)]


@lru_cache(maxsize=4)
def byte_pair_encoder(path: str, pattern: str):
    """Encoder of a rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_whole(encoder, text: str, part: int = 200_000) -> np.ndarray:
    """Ids of a text; very long ones go through the encoder in parts cut before a line break.

    A cut stands between a visible character and a line feed that a visible character follows; no
    token of the byte-level patterns reaches over such a place. A long text without one is split
    into pre-tokens here, in windows, as the encoder's own splitting cannot take very long runs.
    """
    out, start = [], 0
    while len(text) - start > part:
        at = text.find("\n", start + part)
        while at > 0 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find("\n", at + 1)
        if at < 0:
            break
        out.append(np.concatenate(list(_encoded(encoder, text[start:at], part))))
        start = at
    out += _encoded(encoder, text[start:], part)
    return np.concatenate(out)


def _encoded(encoder, text: str, part: int) -> Iterator[np.ndarray]:
    if len(text) <= 2 * part:
        yield np.array(encoder.encode_ordinary(text), np.uint32)
        return
    for found in pieces(split_pattern(encoder._pat_str), text):
        ids: list[int] = []
        for piece in found:
            ids += encoder._encode_single_piece(piece)
        yield np.array(ids, np.uint32)


@lru_cache(maxsize=4)
def split_pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def token_count(texts: Column, tokenizer_path: str, pattern: str) -> Column:
    """Number of ids that a text is packed as, without an end; null counts as none."""

    @F.arrow_udf(LongType())
    def count(column: pa.Array) -> pa.Array:
        encoder = byte_pair_encoder(tokenizer_path, pattern)
        return pa.array([len(encode_whole(encoder, t.as_py())) if t.is_valid and len(t.as_py()) else 0 for t in column], pa.int64())

    return count(texts.cast("string"))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    end_id: int | None,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row for each packed row of `length` ids.

    ids and positions are little-endian uint32 of `length` entries, padded with pad_id and 0;
    positions start again at 0 for each piece. cu_seqlens are the cumulative lengths of
    the pieces from 0 to n_tokens, doc_ids their documents and doc_starts the token of the document
    they begin at, so each document can be put together again. end_id, if given, ends
    each document, empty and null texts included; without it these give no piece. Repeated
    rows are packed each; null ids stay null. pack_id is unique within a run. Other columns
    are not read.
    """
    run = packer(tokenizer_path, pattern, end_id, pad_id, length, group_tokens)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PACKED)


def packer(tokenizer_path: str, pattern: str, end_id: int | None, pad_id: int = 0, length: int = LENGTH, group_tokens: int = GROUP_TOKENS):
    """What a task does with its batches of (id, text): yields packed rows."""
    if length < 1:
        raise ValueError("length must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_pair_encoder(tokenizer_path, pattern)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        task, group = TaskContext.get().partitionId(), 0
        pieces: list[tuple[int | None, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate((encode_whole(encoder, text), tail)) if text else tail
                pieces += [(doc, at, ids[at : at + n]) for at, n in split(len(ids), length)]
                held += len(ids)
                if held >= group_tokens:
                    yield from packed(pieces, f"{task:06d}-{group:06d}", length, pad_id)
                    pieces, held, group = [], 0, group + 1
        yield from packed(pieces, f"{task:06d}-{group:06d}", length, pad_id)

    return run


def packed(pieces: list, name: str, length: int, pad_id: int, at_once: int = 500) -> Iterator[pa.RecordBatch]:
    rows = best_fit_decreasing([len(p[2]) for p in pieces], length)
    for begin in range(0, len(rows), at_once):
        columns: list[list] = [[] for _ in range(7)]
        for number, row in enumerate(rows[begin : begin + at_once], begin):
            ids, positions = np.full(length, pad_id, "<u4"), np.zeros(length, "<u4")
            ends = np.concatenate(([0], np.cumsum([len(pieces[i][2]) for i in row]))).astype(np.int32)
            for i, a, b in zip(row, ends[:-1], ends[1:], strict=True):
                ids[a:b] = pieces[i][2]
                positions[a:b] = np.arange(b - a)
            values = (f"{name}-{number:06d}", int(ends[-1]), ids.tobytes(), ends, positions.tobytes(), [pieces[i][0] for i in row], [pieces[i][1] for i in row])
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PACKED_TYPES, strict=True)], names=list(PACKED_NAMES))


def write_binary(rows: DataFrame, path: str, id_bytes: int = 4) -> DataFrame:
    """Packed rows as binary files in a shared folder; returns their manifest.

    Each task writes `<name>.ids`, a matrix of the ids, `<name>.cu`: for each row the number of
    cumulative lengths and then these, as int32, `<name>.pos`: for each row its position resets as
    bits, 1 where a token stands at position 0 (padding included), and `<name>.doc`: for
    each piece of the rows its document, whether that is null, and the token it begins at, as int64. Ids
    are unsigned integers of id_bytes (2 or 4; one that does not fit is an error); the manifest, a table
    at path/manifest, tells their bytes. A file has a name of its own per attempt; only files in the manifest belong to the result.
    """
    return _manifest(rows.select(*PACKED_NAMES).mapInArrow(writer(path, id_bytes), FILES), path)


FILES = "name string, rows long, id_bytes int"


def _manifest(made: DataFrame, path: str) -> DataFrame:
    made.where("rows > 0").write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest")
    return made.sparkSession.read.parquet(f"{path.rstrip('/')}/manifest")


def writer(path: str, width: int):
    """What a task does with its packed rows: writes its files and yields their line of the manifest."""
    path = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = folder(path)
        name, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0
        with ExitStack() as stack:
            ids, pos, cu, doc = (stack.enter_context(opened_for_write(store, f"{root}/{name}.{kind}")) for kind in ("ids", "pos", "cu", "doc"))
            for batch in batches:
                for _, _, a, c, b, d, e in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    row = np.frombuffer(a, "<u4")
                    if width == 2 and row.max(initial=0) > 0xFFFF:
                        raise ValueError(f"id {row.max()} needs 4 bytes: give id_bytes=4")
                    ids.write(row.astype(f"<u{width}").tobytes())
                    pos.write(np.packbits(np.frombuffer(b, "<u4") == 0).tobytes())
                    cu.write(np.array([len(c), *c], "<i4").tobytes())
                    doc.write(np.array([(x or 0, x is None, at) for x, at in zip(d, e, strict=True)], "<i8").tobytes())
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([width], pa.int32())], names=["name", "rows", "id_bytes"])

    return run


def read_packed(spark, path: str, length: int = LENGTH, at_once: int = 200) -> DataFrame:
    """The packed rows of the files that the manifest names, as `pack` gives them; pack_id is the file and the row in it."""
    path = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = folder(path)
        for batch in batches:
            for name, rows, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with ExitStack() as stack:
                    ids, pos, cu, doc = (stack.enter_context(opened_as_stream(store, f"{root}/{name}.{kind}")) for kind in ("ids", "pos", "cu", "doc"))
                    for first in range(0, rows, at_once):
                        columns: list[list] = [[] for _ in PACKED_TYPES]
                        for number in range(first, min(rows, first + at_once)):
                            ends = np.frombuffer(cu.read(4 * int.from_bytes(cu.read(4), "little")), "<i4")
                            pieces_ = np.frombuffer(doc.read(24 * (len(ends) - 1)), "<i8").reshape(-1, 3)
                            documents = [None if null else d for d, null in pieces_[:, :2].tolist()]
                            row_ids = np.frombuffer(ids.read(width * length), f"<u{width}").astype("<u4")
                            resets = np.unpackbits(np.frombuffer(pos.read((length + 7) // 8), np.uint8))[:length]
                            # each token's distance from the last reset at or before it
                            last = np.maximum.accumulate(np.where(resets, np.arange(length), 0))
                            positions = (np.arange(length) - last).astype("<u4")
                            row = (f"{name}-{number:06d}", int(ends[-1]), row_ids.tobytes(), ends, positions.tobytes(), documents, pieces_[:, 2])
                            for column, value in zip(columns, row, strict=True):
                                column.append(value)
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, PACKED_TYPES, strict=True)], names=list(PACKED_NAMES))

    manifest = spark.read.parquet(f"{path}/manifest").select("name", "rows", "id_bytes")
    return manifest.repartition(max(1, manifest.count()), "name").mapInArrow(run, PACKED)  # a task for each file


def read_binary(spark, path: str, length: int = LENGTH) -> DataFrame:
    """(name, number, ids, cu_seqlens, positions) of the files that the manifest names, ids and positions as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers = zip(*(x.rsplit("-", 1) for x in batch.column(0).to_pylist()), strict=True)
            arrays = [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column(i).to_pylist()], pa.list_(pa.int64())) for i in (1, 3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([int(n) for n in numbers], pa.int64()), arrays[0], batch.column(2), arrays[1]],
                names=["name", "number", "ids", "cu_seqlens", "positions"],
            )

    packed_ = read_packed(spark, path, length).select("pack_id", "ids", "cu_seqlens", "positions")
    return packed_.mapInArrow(run, "name string, number long, ids array<long>, cu_seqlens array<int>, positions array<long>")


def through_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    pattern: str,
    end_id: int | None,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    group_tokens: int = GROUP_TOKENS,
    id_bytes: int = 4,
) -> DataFrame:
    """Documents packed as `pack` does and written as binary files by the same tasks; the rows read back from these."""
    pack_rows, write = packer(tokenizer_path, pattern, end_id, pad_id, length, group_tokens), writer(path, id_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return write(pack_rows(batches))

    _manifest(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, FILES), path)
    return read_packed(docs.sparkSession, path, length)
