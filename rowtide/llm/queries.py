"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import boilerplate, collision, compression, decontam, licenses, merkle, mixing, packing, prefixbpe, rankmerge, repair, sketch, warc
from rowtide.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_pairs() -> dict:
    """Parameters of the byte-level vocabulary that packing uses."""
    import public_tokenizers

    return {"tokenizer_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "end_id": 50256, "pad_id": 50256}


@query("op3_collision_neighbours")
def collision_neighbours(spark, sf_dir):
    """The 20 nearest by inner product of every twentieth vector."""
    return collision.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query("op4_token_counts")
def token_counts(spark, sf_dir):
    """Tokens of every document in the word-end vocabulary."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = rankmerge.with_token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP5_SQL = r"""
WITH t AS (
  SELECT i, license, template, string_split(trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM (VALUES %s) v(i, license, template, body)
), tg AS (
  SELECT i, license, template, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS grams FROM t
), d AS (
  SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}\n]+', ' ', 'g') AS whole FROM documents
), u AS (
  SELECT doc_id,
    list_filter(list_transform(string_split(whole, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines,
    list_filter(list_transform(string_split_regex(whole, '\n *\n[ \n]*'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS parts FROM d
), units AS (
  SELECT doc_id, 'line' AS unit, unnest(lines) AS body, unnest(range(len(lines))) AS number FROM u
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph' AS unit, unnest(parts) AS body, unnest(range(len(parts))) AS number FROM u) WHERE contains(body, chr(10))
  UNION ALL SELECT doc_id, 'text', array_to_string(parts, ' '), 0 FROM u WHERE len(parts) > 1
), words AS (
  SELECT doc_id, unit, number, string_split_regex(body, '[ \n]+') AS w FROM units
), ug AS (
  SELECT doc_id, unit, number, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS grams FROM words WHERE len(w) > 1
), scored AS (
  SELECT doc_id, unit, number, license, template, 2.0::DOUBLE * len(list_intersect(ug.grams, tg.grams)) / (len(ug.grams) + len(tg.grams)) AS dice, i
  FROM ug JOIN tg ON len(ug.grams) BETWEEN len(tg.grams) * (0.8 / 1.2) - 1e-9 AND len(tg.grams) * (1.2 / 0.8) + 1e-9
)
SELECT doc_id, unit, CAST(number AS INTEGER) AS number, license, template, dice FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, number ORDER BY dice DESC, i) = 1
"""
OP5_SQL = OP5_SQL.replace("%s", ", ".join(f"({i}, {_sql_text(a)}, {_sql_text(b)}, {_sql_text(c)})" for i, (a, b, c) in enumerate(licenses.TEMPLATES)))


@query("op5_license_notices", OP5_SQL)
def license_notices(spark, sf_dir):
    """Every line, paragraph and text that is a licence notice."""
    return licenses.notices(table(spark, sf_dir, "documents"))


#: Sources by domain. Weights are targets of the mixture; what a source cannot give goes to its siblings.
_LANGUAGES = {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.0, mixing.OTHER: 1.0}


def _domain(weight: float, sources: dict[str, float]) -> mixing.Node:
    languages = {x: mixing.Node(w, {s: mixing.Node(v) for s, v in sources.items()}) for x, w in _LANGUAGES.items()}
    return mixing.Node(weight, languages)


MIXTURE = mixing.Node(
    1.0,
    {
        "web": _domain(2.0, {"src0": 1.0}),
        "reference": _domain(3.0, {f"src{i}": 1.0 for i in range(1, 10)}),
        mixing.OTHER: _domain(5.0, {**{f"src{i}": 1.0 + i % 3 for i in range(10, 20)}, mixing.OTHER: 1.0}),
    },
)


def mixture_levels() -> list:
    source = F.col("source")
    domain = F.when(source == "src0", "web").when(source.isin(*[f"src{i}" for i in range(1, 10)]), "reference").otherwise(mixing.OTHER)
    return [domain, F.col("lang"), source]


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p
), digits AS (
  SELECT page_id, n, hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    list_sum(list_transform(range(5), lambda k:
      (((strpos('0123456789abcdef', substr(hex, 1 + (i * 5 + k) // 4, 1)) - 1) >> (3 - (i * 5 + k) % 4)) & 1) << (4 - k))) AS INTEGER), 1), '' ORDER BY i) AS code
  FROM (SELECT page_id, n, hex, unnest(range(32)) AS i FROM d) GROUP BY page_id, n, hex
), f AS (SELECT hex, max(page_id) AS first FROM d GROUP BY hex)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, code AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, coalesce(url, '') AS url
FROM digits JOIN f USING (hex) JOIN pages USING (page_id)
"""


@query("op1_capture_index", OP1_SQL)
def capture_index(spark, sf_dir):
    """Every page written to archives, found again through the capture index and read back."""
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    warc.build_index(warc.write_archives(pages, path), path)
    keys = pages.select(warc.url_key(F.coalesce(F.col("url"), F.lit(""))).alias("urlkey"))
    records = warc.read_records(path, warc.lookup(spark, path, keys), payloads=False)
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query("op2_pack_rows")
def pack_rows(spark, sf_dir):
    """Every document as packed rows of 2048 ids, written as binary files and read back."""
    return packing.through_files(table(spark, sf_dir, "documents"), scratch_path(spark, "packed"), **byte_pairs(), id_bytes=2)


@query("op6_mix_sources")
def mix_sources(spark, sf_dir):
    """Documents of a mixture of four fifths of the tokens there are, over at most two epochs, with the epochs each is taken in."""
    docs = table(spark, sf_dir, "documents")
    settings = byte_pairs()
    tokens = packing.token_count(F.col("text"), settings["tokenizer_path"], settings["pattern"])
    taken = mixing.mix(docs, MIXTURE, mixture_levels(), 0.4, tokens=tokens, epochs=2, seed=17, copies_col="copies")
    return taken.select("doc_id", "lang", "source", "copies")


@query("op7_main_text")
def main_text(spark, sf_dir):
    """Main text of every page."""
    return boilerplate.main_texts(table(spark, sf_dir, "pages"))


@query("op8_compression_quality")
def compression_quality(spark, sf_dir):
    """Each document's score for quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compression.train(docs, table(spark, sf_dir, "labels"))
    scored = compression.with_score(docs, model).drop("text")
    return scored.select("doc_id", compression.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, min(a.n) AS n, min(b.n) AS m, count(*) AS k
  FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (n + m - k)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.c AS component_id, s.doc_id = l.c AS kept
FROM sets s JOIN least l ON s.doc_id = l.a
"""


@query("op9_near_duplicates", OP9_SQL)
def near_duplicates(spark, sf_dir):
    """Components of documents that share four fifths of their 4-word shingles."""
    return sketch.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@query("op10_benchmark_matches")
def benchmark_matches(spark, sf_dir):
    """Every place of a document that holds a benchmark item with few edits."""
    return decontam.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_prefix_bpe")
def prefix_bpe(spark, sf_dir):
    """Ids of every document by the byte-level vocabulary, and the text decoded from them, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = prefixbpe.round_trip(docs, path, public_tokenizers.PATTERN)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def sql_crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    bits = "CASE WHEN r & 1 = 1 THEN xor(3988292384, r >> 1) ELSE r >> 1 END"
    eight = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: {bits})"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {eight}))"


def _sql_leaf(n_chars: str) -> str:
    values = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, {_sql_leaf("(n_chars + 1)")} AS other, {sql_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS tampered FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d
), g AS (
  SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, list(leaf ORDER BY i) AS nodes FROM l GROUP BY lang
), low AS (
  SELECT j, 0 AS level, nodes FROM g UNION ALL
  SELECT j, level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], ''))) FROM low WHERE len(nodes) > 1
), high AS (
  SELECT 0 AS level, list(nodes[1] ORDER BY j) AS nodes FROM low WHERE len(nodes) = 1 UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], ''))) FROM high WHERE len(nodes) > 1
), lown AS (
  SELECT j, level, unnest(nodes) AS node, unnest(range(len(nodes))) AS k FROM low
), highn AS (
  SELECT level, unnest(nodes) AS node, unnest(range(len(nodes))) AS k FROM high
), p AS (
  SELECT g.j, l.i, l.doc_id, l.leaf, l.other, l.tampered FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang
), steps AS (
  SELECT p.j, p.i, low.level, CASE WHEN (p.i >> low.level) % 2 = 1 THEN 'b' ELSE 'a' END || coalesce(s.node, '') AS step
  FROM p JOIN (SELECT j, level FROM low WHERE len(nodes) > 1) low ON p.j = low.j
  LEFT JOIN lown s ON s.j = p.j AND s.level = low.level AND s.k = xor(p.i >> low.level, 1)
  UNION ALL
  SELECT p.j, p.i, 1000 + high.level, CASE WHEN (p.j >> high.level) % 2 = 1 THEN 'b' ELSE 'a' END || coalesce(s.node, '')
  FROM p JOIN (SELECT level FROM high WHERE len(nodes) > 1) high ON TRUE
  LEFT JOIN highn s ON s.level = high.level AND s.k = xor(p.j >> high.level, 1)
), proofs AS (
  SELECT j, i, list(step ORDER BY level) AS steps FROM steps GROUP BY j, i
), f AS (
  SELECT p.*, list_reduce(list_prepend(CASE WHEN tampered THEN coalesce(other, leaf) ELSE leaf END, coalesce(steps, [])),
    lambda x, s: sha256(CASE WHEN s[1] = 'b' THEN s[2:] || x ELSE x || s[2:] END)) AS folded,
    sha256(array_to_string(list_transform(coalesce(steps, []), lambda s: s[2:]), '')) AS proof
  FROM p LEFT JOIN proofs USING (j, i)
)
SELECT f.doc_id, f.leaf, (SELECT nodes[1] FROM low WHERE low.j = f.j AND len(nodes) = 1) AS subroot,
  (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root, f.proof AS proof_sha256, f.folded AS folded_root,
  f.folded = (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS verified
FROM f
"""


@query("op12_dataset_manifest", OP12_SQL)
def dataset_manifest(spark, sf_dir):
    """Leaf, subroot and root of every document, its proof's digest, and whether the row, tampered with in a seventh of them, still leads to the root."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    other = merkle.leaf(*fields[:3], F.coalesce(F.col("n_chars") + 1, F.col("n_chars")), fields[4])
    leaves = docs.select("doc_id", "lang", merkle.leaf(*fields).alias("digest"), F.when(tampered, other).alias("other"))
    made = merkle.manifest(leaves, "doc_id", "lang", "digest", keep=["other"])
    found = made.withColumn("folded_root", merkle.folded(F.coalesce("other", "leaf"), F.col("proof")))
    proof = merkle.proof_digest(F.col("proof")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def damaged(rows):
    """Conversation rows, some dropped, emptied, without their marks, repeated or given to the user, by a checksum of conversation and turn."""
    name = F.concat(repair.spaced(F.col("conv_id")), F.lit(":"), repair.spaced(F.col("turn")))
    harm = F.crc32(name.cast("binary")) % 20
    text = repair.spaced(F.col("text"))
    changed = rows.select(
        "conv_id", "turn",
        F.when(harm == 4, "user").otherwise(repair.spaced(F.col("role"))).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(harm == 0, F.array().cast("array<int>")).when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return changed.drop("copy")


@query("op11_conversation_repair")
def conversation_repair(spark, sf_dir):
    """Faults and cheapest repair of every conversation, after damage."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.repair_report(damaged(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = rows.select(F.col("conv_id").alias("of")).distinct().join(found, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.select(
        F.col("of").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )
