"""Text helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Texts that count as yes and as no.
TRUE_WORDS = ("t", "true", "yes", "1")
FALSE_WORDS = ("f", "false", "no", "0")

DEFAULT_SCHEMA = "public"


def same_ci(a: Column, b: Column) -> Column:
    """Case-insensitive equality, NULL equal to NULL."""
    return F.lower(a).eqNullSafe(F.lower(b))


def starts_with_ci(text: Column, prefix: str) -> Column:
    return F.lower(text).startswith(prefix.lower())


def contains_ci(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_non_blank(*texts: Column) -> Column:
    return F.coalesce(*[blank_to_null(t) for t in texts], F.lit(""))


def join_non_blank(separator: str, *texts: Column) -> Column:
    return F.concat_ws(separator, *[blank_to_null(t) for t in texts])


def is_truthy(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin(*TRUE_WORDS), F.lit(False))


def is_falsey(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin(*FALSE_WORDS), F.lit(False))


def split_names(text: Column) -> Column:
    """Names separated by blanks or commas."""
    return F.filter(F.split(text, r"[\s,]+"), lambda n: n != "")


def name_schema(name: Column, default: Column | str = DEFAULT_SCHEMA) -> Column:
    """Schema part of ``schema.object``; a bare name takes the default."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.when(F.contains(name, F.lit(".")), F.split(name, r"\.", 2)[0]).otherwise(default)


def name_object(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.split(name, r"\.", 2)[1]).otherwise(name)


def quote_literal(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def zero_pad(number: Column, count: int) -> Column:
    """Pad to the number of digits of ``count``."""
    return F.lpad(number.cast("string"), len(str(count)), "0")


def sorted_lower(texts: Column) -> Column:
    return F.array_sort(F.transform(texts, lambda t: F.lower(t)))


def same_strings_any_order(a: Column, b: Column) -> Column:
    """Same multiset of strings, whatever their order and case."""
    return sorted_lower(a).eqNullSafe(sorted_lower(b))


def parse_pairs(text: Column) -> Column:
    """``(k=v,k=v)`` -> array of (name, value); no value reads as blank, and
    whatever follows a second ``=`` is dropped."""
    inner = F.regexp_replace(F.trim(text), r"^\(|\)$", "")
    return F.transform(
        F.split(inner, ","),
        lambda p: F.struct(
            F.split(p, "=")[0].alias("name"),
            F.coalesce(F.get(F.split(p, "="), F.lit(1)), F.lit("")).alias("value"),
        ),
    )


def encode_pairs(pairs: Column) -> Column:
    """Map -> ``k=v,k=v`` in name order."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )


def parse_array_literal(text: Column) -> Column:
    """``{a,"b,c"}`` -> array of strings; quoted items may hold commas, and a
    backslash inside quotes keeps the character after it."""
    inner = F.regexp_replace(text, r"^\{|\}$", "")
    items = F.regexp_extract_all(F.concat(inner, F.lit(",")), F.lit(r'((?:"(?:[^"\\]|\\.)*"|[^",])*),'), F.lit(1))
    plain = F.transform(
        items,
        lambda i: F.regexp_replace(F.regexp_replace(i, r'(?<!\\)"', ""), r"\\(.)", "$1"),
    )
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(plain)


def normalise_query(text: Column) -> Column:
    """View text without outer blanks and the closing semicolon, lower-cased."""
    return F.lower(F.regexp_replace(F.trim(text), r";$", ""))


def normalise_check(text: Column) -> Column:
    """``CHECK ( ... )`` -> the bare predicate."""
    trimmed = F.trim(text)
    return F.trim(F.regexp_replace(trimmed, r"(?is)^check\s*\((.*)\)$", "$1"))


def strip_check(predicate: str) -> str:
    """Bare predicate of a declared check: drops the word and the parentheses
    that enclose the whole text. Driver-side, for specs."""
    text = re.sub(r"^\s*check\b", "", predicate.strip(), flags=re.I).strip()
    while text.startswith("(") and text.endswith(")"):
        depth = 0
        for i, ch in enumerate(text):
            depth += (ch == "(") - (ch == ")")
            if depth == 0 and i < len(text) - 1:
                return text
        text = text[1:-1].strip()
    return text
