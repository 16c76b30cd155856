"""Row-set elements of markup files of any shape, each file shared among tasks.

A file is read in pieces that end before a ``<``, so every piece is one tag and
the text behind it, however lines are broken, and Spark splits files by bytes.
What a piece needs from further up (the header it stands under, its row, whether
a comment is open) is the last such piece at or before it: within a block of the
file a running last value, and for what lies in earlier blocks a directory with one
row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowtide.functions.text import split_names
from rowtide.session import cut_lineage

_ATTRIBUTE = r"""\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*')"""
_TAG = rf"(?s)^/?[\w:.-]+((?:{_ATTRIBUTE})*)\s*(/?)>(.*)$"
_HEADERS, _ROWS, _CELLS = ("rows", "/rows"), ("row", "/row"), ("col", "/col", "tabrow", "/tabrow")
_TRUE = ("true", "1", "t")


def _decoded(text: Column) -> Column:
    """Text with its character references resolved."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    wrapped = F.concat(F.lit("<t>"), lines, F.lit("</t>"))
    return F.when(F.contains(lines, F.lit("&")), F.xpath_string(wrapped, F.lit("/t"))).otherwise(lines)


def _attribute(attributes: Column, name: str) -> Column:
    """Value of an attribute, NULL if it is not there."""
    pattern = rf"""(?s)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    value = F.concat(F.regexp_extract(attributes, pattern, 1), F.regexp_extract(attributes, pattern, 2))
    return F.when(attributes.rlike(pattern), _decoded(value))


def _flag(attributes: Column, name: str) -> Column:
    return F.coalesce(F.lower(F.trim(_attribute(attributes, name))).isin(*_TRUE), F.lit(False))


def _after(text: Column, mark: str) -> Column:
    """Text behind the first ``mark``."""
    return F.substr(text, F.locate(mark, text) + len(mark))


def _before(text: Column, mark: str) -> Column:
    return F.substr(text, F.lit(1), F.locate(mark, text) - 1)


def _carried(df: DataFrame, last: dict[str, Column]) -> DataFrame:
    """Adds, per name, the value's last occurrence in the earlier blocks of the file.

    The directory behind it has one row per block.
    """
    found = [F.max(F.when(value.isNotNull(), F.struct("at", value.alias("value")))).alias(name) for name, value in last.items()]
    directory = df.groupBy("file", "block").agg(*found)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = directory.select(
        F.col("file").alias("__file"), F.col("block").alias("__block"), *[F.last(n, ignorenulls=True).over(earlier)["value"].alias(n) for n in last]
    )
    return df.join(carried, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))).drop("__file", "__block")


def _last(value: Column, carried: str, here: bool) -> Column:
    """The last value before a piece, or at it too."""
    run = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if here else -1)
    return F.coalesce(F.last(value, ignorenulls=True).over(run), F.col(carried))


def _live_pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at, kind, attributes and text of the pieces that matter, without comments.

    ``kind`` is the tag's name, NULL for text that goes on behind a comment or in a
    CDATA section.
    """
    value = F.col("value")
    raw = spark.read.option("lineSep", "<").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    ends_comment, ends_section = F.contains(value, F.lit("-->")), F.contains(value, F.lit("]]>"))
    comment = F.when(ends_comment, False).when(F.startswith(value, F.lit("!--")), True)
    section = F.when(ends_section, False).when(F.startswith(value, F.lit("![CDATA[")), True)
    states = _carried(raw, {"__comment": comment, "__section": section}).select(
        "file", "block", "at", "value",
        F.coalesce(_last(comment, "__comment", False), F.lit(False)).alias("in_comment"),
        F.coalesce(_last(section, "__section", False), F.lit(False)).alias("in_section"),
    )
    both = F.raise_error(F.concat(F.lit("a comment and a CDATA section overlap in "), F.col("file"))).cast("string")
    name = F.regexp_extract(value, r"^(/?[\w:.-]+)(?=[\s/>])", 1)
    wanted = name.isin(*_HEADERS, *_ROWS, *_CELLS)
    opens_section = F.startswith(value, F.lit("![CDATA["))
    inner = F.when(F.col("in_section"), F.concat(F.lit("<"), value)).otherwise(_after(value, "![CDATA["))
    told = F.when(F.contains(inner, F.lit("]]>")), F.concat(_before(inner, "]]>"), _decoded(_after(inner, "]]>")))).otherwise(inner)
    outside = ~F.col("in_comment") & ~F.col("in_section")
    text = (
        F.when(F.col("in_comment") & F.col("in_section"), both)
        .when(F.col("in_section") | (opens_section & ~F.col("in_comment")), told)
        .when(F.col("in_comment") | F.startswith(value, F.lit("!--")), F.when(ends_comment, _decoded(_after(value, "-->"))))
        .when(wanted, F.when(F.regexp_extract(value, _TAG, 2) == "/", "").otherwise(_decoded(F.regexp_extract(value, _TAG, 3))))
    )
    pieces = states.select(
        "file", "block", "at",
        F.when(outside & wanted, name).alias("kind"),
        F.when(outside & wanted, F.regexp_extract(value, _TAG, 1)).alias("attributes"),
        (outside & wanted & (F.regexp_extract(value, _TAG, 2) == "/")).alias("closed"),
        text.alias("text"),
    )
    return pieces.filter(F.col("kind").isNotNull() | F.col("text").isNotNull())


def row_elements(spark: SparkSession, path: str) -> DataFrame:
    """One row for each ``row`` and ``tabrow`` inside ``rows`` elements.

    ``columns`` and ``delimiter`` come from the header the row stands under, ``deleted``
    from the row; ``cells`` (null, empty, sql, text) holds a row's cells, ``line`` the
    text of a tabrow.
    """
    pieces = cut_lineage(_live_pieces(spark, path))
    kind, attributes = F.col("kind"), F.col("attributes")
    header = F.when(
        kind.isin(*_HEADERS),
        F.struct(
            ((kind == "rows") & ~F.col("closed")).alias("open"),
            split_names(F.trim(_attribute(attributes, "columns"))).alias("columns"),
            _attribute(attributes, "tabrowDelimiter").alias("delimiter"),
        ),
    )
    row = F.when(kind.isin(*_ROWS), F.struct((kind == "row").alias("open"), F.col("at").alias("id"), _flag(attributes, "delete").alias("deleted")))
    # The element a text belongs to: the last tag of any of the three sorts.
    tag = F.when(kind.isNotNull(), F.struct(F.when(~F.col("closed"), kind).alias("kind"), F.col("at").alias("id")))
    placed = _carried(pieces, {"__header": header, "__row": row, "__tag": tag}).select(
        "file", "block", "at", "kind", "attributes", "text",
        _last(header, "__header", True).alias("header"),
        _last(row, "__row", True).alias("row"),
        _last(tag, "__tag", True).alias("tag"),
    )
    own = F.coalesce(kind.isin("row", "col", "tabrow"), F.lit(False))
    is_line = kind.eqNullSafe("tabrow") | (kind.isNull() & F.col("tag.kind").eqNullSafe("tabrow"))
    spoken = placed.filter(F.col("header.open") & (own | (kind.isNull() & F.col("tag.kind").isin("col", "tabrow"))))
    spoken = spoken.filter(is_line | F.col("row.open")).select(
        F.when(is_line, F.col("tag.id")).otherwise(F.col("row.id")).alias("id"),
        F.when(kind == "row", F.lit(None)).otherwise(F.col("tag.id")).alias("cell"),
        "block", "at", is_line.alias("is_line"),
        F.when(kind == "row", F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"),
        F.when(kind.isNotNull(), F.col("header")).alias("header"),
        F.when(kind == "row", F.col("row.deleted")).alias("deleted"),
        *[F.when(kind == "col", _flag(attributes, n)).alias(n) for n in ("null", "empty", "sql")],
    )
    # One exchange by row serves both groupings.
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "text"))), lambda p: p["text"])
    whole = spoken.repartition("id").groupBy("id", "cell", "is_line").agg(
        F.array_join(texts, "").alias("text"),
        F.min(F.struct("block", "at")).alias("place"),
        F.max("header").alias("header"),
        F.max("deleted").alias("deleted"),
        *[F.max(n).alias(n) for n in ("null", "empty", "sql")],
    )
    cell = F.struct("place", F.struct("null", "empty", "sql", "text").alias("cell"))
    found = whole.groupBy("id", "is_line").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), cell))), lambda c: c["cell"]).alias("cells"),
        F.max("header").alias("header"),
        F.max("deleted").alias("deleted"),
    )
    return found.select(
        "header.columns",
        "header.delimiter",
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
        F.when(~F.col("is_line"), F.col("cells")).alias("cells"),
        F.when(F.col("is_line"), F.get("cells", F.lit(0))["text"]).alias("line"),
    )
