"""Declared rows against live rows, in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.cells import TEXT, TYPED, all_of
from rowtide.functions.times import interval_microseconds, time_value
from rowtide.operators.diff import TOMBSTONE
from rowtide.operators.pairing import align_names, find_column


def homogenised(text: Column, declared: str) -> Column:
    """Booleans as ``true`` or ``false`` (everything but true and t is false);
    other texts as they are."""
    if declared.lower().startswith("bool"):
        yes = F.coalesce(F.lower(text).isin("true", "t"), F.lit(False))
        return F.when(yes, F.lit("true")).otherwise(F.lit("false"))
    return text


def typed_compare(declared_value: Column, live_value: Column, declared: str, mode: str = TEXT) -> Column:
    """Whether a declared and a live value agree, as texts of a declared type.

    Booleans are homogenised, dates, times and intervals compared by value when
    both are there. In ``text`` mode a NULL reads as blank, in ``typed`` mode it
    only agrees with NULL.
    """
    a = homogenised(declared_value.cast("string"), declared)
    b = homogenised(live_value.cast("string"), declared)
    blank_a, blank_b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    equal = blank_a == blank_b
    kind = declared.strip().lower()
    value = None
    if kind.startswith("interval"):
        value = interval_microseconds
    elif kind.startswith(("time", "date")):
        value = lambda text: time_value(text, kind)
    if value is not None:
        # Only texts that differ are read as values.
        same_moment = F.coalesce(value(blank_a) == value(blank_b), F.lit(False))
        equal = F.when(equal, True).when((blank_a == "") | (blank_b == ""), False).otherwise(same_moment)
    if mode == TYPED:
        return F.when(declared_value.isNull() | live_value.isNull(), declared_value.isNull() & live_value.isNull()).otherwise(
            equal
        )
    if mode != TEXT:
        raise ValueError(f"unknown comparison mode {mode!r}")
    return equal


def _matched(declared: DataFrame, live: DataFrame, pk: list[str], tombstone: str) -> tuple[DataFrame, list[str]]:
    """Declared rows with the number of live rows of their key and one of them.

    Only live rows whose key is declared go on (Spark broadcasts the declared
    keys if they are measured to be small, and the live table stays where it is).
    These are folded by key before the join, so copies are counted and never
    multiplied; of several copies the least row stands for them.
    """
    live = align_names(live, declared.columns)
    values = [c for c in declared.columns if c not in pk and c.lower() != tombstone.lower()]
    missing = [c for c in values if c not in live.columns]
    if missing:
        raise ValueError(f"the live table has no columns {missing}")
    wanted = declared.select(*[F.col(k).alias(f"__w_{k}") for k in pk])
    known = live.join(wanted, all_of([F.col(k).eqNullSafe(F.col(f"__w_{k}")) for k in pk]), "left_semi")
    row = F.struct(*values or [F.lit(True).alias("_")])
    folded = (
        known.groupBy(*[F.col(k).alias(f"__{k}") for k in pk])
        .agg(F.count(F.lit(1)).alias("__copies"), F.min(row).alias("__row"))
        .select(*[f"__{k}" for k in pk], "__copies", *[F.col("__row")[c].alias(f"__live_{c}") for c in values])
    )
    match = all_of([F.col(k).eqNullSafe(F.col(f"__{k}")) for k in pk])
    joined = declared.join(folded, match, "left")
    return joined.withColumn("__copies", F.coalesce("__copies", F.lit(0))), values


def _dead(declared: DataFrame, tombstone: str) -> Column:
    flag = find_column(declared, tombstone)
    return F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)


def _agreement(values: list[str], types: dict[str, str], mode: str) -> dict[str, Column]:
    return {c: typed_compare(F.col(c), F.col(f"__live_{c}"), types.get(c, "text"), mode) for c in values}


def verify_rows(
    declared: DataFrame,
    live: DataFrame,
    pk: list[str],
    types: dict[str, str] | None = None,
    mode: str = TEXT,
    tombstone: str = TOMBSTONE,
) -> DataFrame:
    """Verdict on each declared row: ``tombstone_present``, ``missing``,
    ``duplicate``, ``mismatch`` or ``match``, with the number of live rows."""
    joined, values = _matched(declared, live, pk, tombstone)
    dead = _dead(declared, tombstone)
    agree = all_of(list(_agreement(values, types or {}, mode).values()))
    verdict = (
        F.when(dead & (F.col("__copies") > 0), "tombstone_present")
        .when(dead, "match")
        .when(F.col("__copies") == 0, "missing")
        .when(F.col("__copies") > 1, "duplicate")
        .when(~agree, "mismatch")
        .otherwise("match")
    )
    return joined.select(*pk, verdict.alias("verdict"), F.col("__copies").alias("live_rows"))


def verify_cells(
    declared: DataFrame,
    live: DataFrame,
    pk: list[str],
    types: dict[str, str] | None = None,
    mode: str = TEXT,
    tombstone: str = TOMBSTONE,
) -> DataFrame:
    """Cells that differ, with both texts, for rows found exactly once."""
    types = types or {}
    joined, values = _matched(declared, live, pk, tombstone)
    found = joined.filter(~_dead(declared, tombstone) & (F.col("__copies") == 1))
    agreement = _agreement(values, types, mode)
    cells = F.array(
        *[
            F.when(
                ~agreement[c],
                F.struct(
                    F.lit(c).alias("column_name"),
                    homogenised(F.col(c).cast("string"), types.get(c, "text")).alias("declared_value"),
                    homogenised(F.col(f"__live_{c}").cast("string"), types.get(c, "text")).alias("live_value"),
                ),
            )
            for c in values
        ]
    )
    long = found.select(*pk, F.explode(cells).alias("cell"))
    return long.filter(F.col("cell").isNotNull()).select(*pk, "cell.*")
