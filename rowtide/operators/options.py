"""Drift of ``(name=value, ...)`` option texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtide.functions.text import parse_pairs
from rowtide.operators.pairing import IN_NEW, IN_OLD, new_side, old_side, pair_states


def option_rows(df: DataFrame, owner: list[str], text: str) -> DataFrame:
    """One row per owner and option name; a repeated name keeps its last value."""
    items = df.select(*owner, F.posexplode(parse_pairs(F.col(text))).alias("__pos", "__item"))
    return (
        items.select(*owner, F.lower("__item.name").alias("option"), "__pos", F.col("__item.value").alias("value"))
        .filter(F.col("option") != "")
        .groupBy(*owner, "option")
        .agg(F.max_by("value", "__pos").alias("value"))
    )


def options_diff(old: DataFrame, new: DataFrame, owner: list[str], text: str) -> DataFrame:
    """Create, update or delete per option. Names and values ignore case."""
    key = [*owner, "option"]
    pairs = pair_states(option_rows(old, owner, text), option_rows(new, owner, text), key, on_duplicate="trust")
    action = (
        F.when(~F.col(IN_OLD), "create")
        .when(~F.col(IN_NEW), "delete")
        .when(F.lower(old_side("value")) != F.lower(new_side("value")), "update")
    )
    return (
        pairs.select(
            *key, action.alias("action"), old_side("value").alias("old_value"), new_side("value").alias("new_value")
        ).filter(F.col("action").isNotNull())
    )
