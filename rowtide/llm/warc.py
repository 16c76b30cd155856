"""WARC archives with a two-level capture index.

Archives hold one gzip member per record, so that a record can be read by its range. Captures
are sorted by reversed-host key over range partitions. Each partition becomes one index shard:
blocks of lines, compressed one by one, and a sparse directory with the first key and
range of each block. A lookup finds the shard by the shards' first keys, the block by binary
search in that shard's directory, reads that range, finds the lines by binary search in it, and
then reads the records' ranges.

A payload that occurs more than once is stored once: the record with the largest id is a response,
the others are revisits of it that carry its digest and, in their HTTP header, its length.
"""

from __future__ import annotations

import base64
import gzip
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rowtide.llm.files import folder, opened_for_read, opened_for_write

BLOCK_LINES = 3000
#: Bytes of one archive file, after which a task starts another.
FILE_BYTES = 1 << 30
#: Shards of an index; their first keys are the only part of it that every task gets.
MAX_SHARDS = 20_000
DATE = "2024-01-01T00:00:00Z"
#: Ranges that lie closer than this are read together.
GAP = 1 << 16

CAPTURE = "urlkey string, record_id long, record_type string, digest string, file string, start long, size long"
RECORD = "url string, record_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def reversed_host_key(url: str | None) -> str:
    """Host labels from last to first, port, then path and query: `org,example,www:81)/a?b`.

    Host in lower case, without user, scheme and fragment; blanks and control characters are
    percent-encoded so that a key never breaks a line. What has no host keeps its text after `)`.
    """
    text = "".join(c if c.isprintable() and c != " " else quote(c, safe="") for c in (url or "").strip())
    try:
        parts = urlsplit(text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){text}"
    if not host:
        return f"){text}"
    labels = ",".join(reversed(host.rstrip(".").split(".")))
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{query}"


@F.arrow_udf(StringType())
def url_key(urls: pa.Array) -> pa.Array:
    return pa.array([reversed_host_key(u) for u in urls.to_pylist()], pa.string())


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_name(ident: int | None) -> str:
    return f"<urn:record:{'none' if ident is None else ident}>"


def record_bytes(url: str, ident: int | None, kind: str, digest: str, n_bytes: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC record as a gzip member."""
    revisit = kind == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Date: {DATE}",
        f"WARC-Record-ID: {record_name(ident)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def parse_record(member: bytes) -> dict:
    """Fields of a record from its gzip member; a response's digest and length are those of its payload."""
    data = zlib.decompress(member, 31)
    top, _, rest = data.partition(b"\r\n\r\n")
    head = dict(x.split(": ", 1) for x in top.decode().split("\r\n")[1:])
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")

    def number(name: str) -> int | None:
        text = head[name].removeprefix("<urn:record:").removesuffix(">")
        return None if text == "none" else int(text)

    out = {"url": head["WARC-Target-URI"], "record_id": number("WARC-Record-ID"), "record_type": head["WARC-Type"], "refers_to": None, "payload": None}
    if head["WARC-Type"] == "revisit":
        lengths = [x.split(": ", 1)[1] for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")]
        return out | {"payload_bytes": int(lengths[0]), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number("WARC-Refers-To")}
    import hashlib

    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if f"sha1:{digest}" != head["WARC-Payload-Digest"]:
        raise ValueError(f"record {out['record_id']}: the payload does not have its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record for every row under path; returns the captures, kept as a table at path/captures.

    Payloads are UTF-8, null is empty. Of records with equal payloads of at least
    least_bytes those with the largest id are responses (more than one only if rows repeat
    it), the others revisits; records without id revisit if the payload has any with id, and are responses
    otherwise. Null urls are empty. A file's name is used by one attempt of one task; only
    files that a capture names belong to the archive.
    """
    path = path.rstrip("/")
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("ident"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"hex": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("n_bytes") >= least_bytes).groupBy("hex").agg(F.max("ident").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    joined = rows.join(firsts, "hex", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("ident").eqNullSafe(F.col("first")), F.lit(False)) & (F.col("n_bytes") >= least_bytes)
    joined = joined.select(
        "ident", "url", "hex", "n_bytes", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"), F.when(~revisit, F.col("payload")).alias("payload")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = folder(f"{path}/archive")
        sink, name, at = None, "", 0
        try:
            for batch in batches:
                found = []
                for ident, url, hex_digest, n, refers, again, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if sink is None or at >= FILE_BYTES:
                        if sink is not None:
                            sink.close()
                        name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                        sink = opened_for_write(store, f"{root}/{name}")
                    digest, kind = base32(hex_digest), "revisit" if again else "response"
                    data = record_bytes(url, ident, kind, digest, n, refers, body or b"")
                    sink.write(data)
                    found.append((reversed_host_key(url), ident, kind, digest, name, at, len(data)))
                    at += len(data)
                yield captures(found)
        finally:
            if sink is not None:
                sink.close()

    table = f"{path}/captures"
    joined.mapInArrow(run, CAPTURE).write.parquet(table)
    return pages.sparkSession.read.schema(CAPTURE).parquet(table)


def captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def build_index(found: DataFrame, path: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index of captures under path; returns its shards (shard, first_key, last_key, lines).

    Keys are dealt to range partitions together with the record's place, so a key
    with very many captures may reach over several shards.
    """
    path = path.rstrip("/")
    spark = found.sparkSession
    shards = min(MAX_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = found.repartitionByRange(shards, "urlkey", "file", "start").sortWithinPartitions("urlkey", "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = folder(f"{path}/index")
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        directory, lines, first, last, total, at = [], [], None, None, 0, 0
        with opened_for_write(store, f"{root}/{name}.cdx.gz") as sink:

            def block() -> None:
                nonlocal at
                data = gzip.compress(("\n".join(lines) + "\n").encode(), compresslevel=6, mtime=0)
                sink.write(data)
                directory.append(f"{lines[0].split(' ', 1)[0]} {at} {len(data)}")
                at += len(data)
                lines.clear()

            for batch in batches:
                for key, ident, kind, digest, file, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    lines.append(f"{key} {json.dumps({'id': ident, 'type': kind, 'digest': digest, 'file': file, 'start': start, 'size': size})}")
                    first, last, total = key if first is None else first, key, total + 1
                    if len(lines) >= block_lines:
                        block()
            if lines:
                block()
        with opened_for_write(store, f"{root}/{name}.dir") as sink:
            sink.write("\n".join(directory).encode())
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([last]), pa.array([total], pa.int64())], names=["shard", "first_key", "last_key", "lines"])

    table, schema = f"{path}/shards", "shard string, first_key string, last_key string, lines long"
    dealt.mapInArrow(run, schema).write.parquet(table)
    return spark.read.schema(schema).parquet(table)


def blocks_of(directory: list[tuple[str, int, int]], firsts: list[str], key: str) -> range:
    """Numbers of the blocks that can hold a key, by binary search over the blocks' first keys."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Captures of each key of a DataFrame (urlkey); each distinct key is looked up once."""
    path = path.rstrip("/")
    shards = sorted((r["first_key"], r["last_key"], r["shard"]) for r in spark.read.parquet(f"{path}/shards").toLocalIterator())  # MAX_SHARDS at most
    firsts, lasts, names = [s[0] for s in shards], [s[1] for s in shards], [s[2] for s in shards]

    @F.arrow_udf("array<string>")
    def shards_of(column: pa.Array) -> pa.Array:
        return pa.array([names[bisect_left(lasts, k) : bisect_right(firsts, k)] if k is not None else [] for k in column.to_pylist()], pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = folder(f"{path}/index")
        shard, source, directory, starts, held, lines, line_keys = None, None, [], [], None, [], []
        for batch in batches:
            found = []
            for name, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != shard:
                    shard, held = name, None
                    if source is not None:
                        source.close()
                    with opened_for_read(store, f"{root}/{name}.dir") as f:
                        directory = [(x[0], int(x[1]), int(x[2])) for x in (line.rsplit(" ", 2) for line in f.read().decode().split("\n"))]
                    starts = [x[0] for x in directory]
                    source = opened_for_read(store, f"{root}/{name}.cdx.gz")
                for number in blocks_of(directory, starts, key):
                    if number != held:
                        _, at, size = directory[number]
                        source.seek(at)
                        lines = zlib.decompress(source.read(size), 31).decode().split("\n")[:-1]
                        line_keys, held = [x.split(" ", 1)[0] for x in lines], number
                    for line in lines[bisect_left(line_keys, key) : bisect_right(line_keys, key)]:
                        x = json.loads(line.split(" ", 1)[1])
                        found.append((key, x["id"], x["type"], x["digest"], x["file"], x["start"], x["size"]))
                    if len(found) >= 5000:
                        yield captures(found)
                        found = []
            if found:
                yield captures(found)
        if source is not None:
            source.close()

    wanted = keys.select("urlkey").distinct().select(F.explode(shards_of("urlkey")).alias("shard"), "urlkey")
    return wanted.repartition("shard", F.pmod(F.xxhash64("urlkey"), F.lit(4))).sortWithinPartitions("shard", "urlkey").mapInArrow(run, CAPTURE)


def read_records(path: str, found: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of captures, by range reads; neighbouring ranges are read together."""
    path = path.rstrip("/")
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = folder(f"{path}/archive")
        source, opened = None, None
        for batch in batches:
            spans = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            i = 0
            while i < len(spans):
                file, begin, size = spans[i]
                end, j = begin + size, i + 1
                while j < len(spans) and spans[j][0] == file and 0 <= spans[j][1] - end < GAP and spans[j][1] + spans[j][2] - begin < 4 * GAP:
                    end, j = spans[j][1] + spans[j][2], j + 1
                if file != opened:
                    if source is not None:
                        source.close()
                    source, opened = opened_for_read(store, f"{root}/{file}"), file
                source.seek(begin)
                data = source.read(end - begin)
                rows = [parse_record(data[at - begin : at - begin + n]) for _, at, n in spans[i:j]]
                if not payloads:
                    rows = [r | {"payload": None} for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
                i = j
        if source is not None:
            source.close()

    ordered = found.select("file", "start", "size").repartition("file", F.floor(F.col("start") / (1 << 24)))
    return ordered.sortWithinPartitions("file", "start").mapInArrow(run, RECORD)
