"""Bring an old and a new state side by side, one row per key.

Everything that compares two states goes through :func:`pair_states`. It is one
null-safe full outer join on the key (planned as an ordinary hash-partitioned
sort-merge join) that carries only the columns the caller asks for.

A repeated key would make such a join emit every pair of its copies, so each
side is guarded first:

``fail``   a key-only aggregate (narrow, combined before its shuffle) proves
           that keys are unique; the job stops with a message if they are not
``flag``   copies of a key are folded into one row before the join and their
           number is reported, so a key that holds a third of the table still
           costs one row per map task
``trust``  the caller knows that keys are unique (the input is an aggregate on
           the key, or ``check_primary_key`` has just come back empty)

A NULL in a key equals a NULL. Where keys hold none, ``null_keys=False`` joins on
plain equality, which lets Spark use the layout the data already has (bucketed
tables, or an aggregate on the key) and skip the shuffle; the guard then also
proves that there is no NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowtide.functions.cells import all_of, any_of

IN_OLD = "__in_old"
IN_NEW = "__in_new"
OLD_COPIES = "__old_copies"
NEW_COPIES = "__new_copies"


def old_side(name: str) -> Column:
    return F.col(f"`__old_{name}`")


def new_side(name: str) -> Column:
    return F.col(f"`__new_{name}`")


def find_column(df: DataFrame, name: str) -> str | None:
    """Actual spelling of a column, matched without regard to case."""
    wanted = name.lower()
    return next((c for c in df.columns if c.lower() == wanted), None)


def align_names(df: DataFrame, like: list[str]) -> DataFrame:
    """Rename columns that differ from ``like`` only in case."""
    spelling = {n.lower(): n for n in like}
    renames = {c: spelling[c.lower()] for c in df.columns if spelling.get(c.lower(), c) != c}
    return df.withColumnsRenamed(renames) if renames else df


def require_unique(df: DataFrame, key: list[str], what: str, null_keys: bool = True) -> DataFrame:
    """``df``, but the job fails if a key occurs twice (or, without
    ``null_keys``, holds a NULL).

    The proof runs as a scalar subquery over the key columns alone and is done
    before the rows it guards are read.
    """
    columns = [F.col(f"`{k}`") for k in key]
    copies = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    worst = F.max("n")
    if not null_keys:
        worst = F.max(F.when(any_of([c.isNull() for c in columns]), F.lit(2)).otherwise(F.col("n")))
    most = copies.agg(worst.alias("n")).scalar()
    fault = "not unique" if null_keys else "not unique or holds NULL"
    message = F.lit(f"{what}: key ({', '.join(key)}) is {fault}")
    return df.filter(
        F.when(F.coalesce(most, F.lit(0)) > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    )


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _one_side(
    df: DataFrame, key: list[str], columns: list[str], prefix: str, present: str, on_duplicate: str, null_keys: bool
) -> DataFrame:
    keys = [F.col(f"`{k}`").alias(f"{prefix}key{i}") for i, k in enumerate(key)]
    values = [F.col(f"`{c}`").alias(f"{prefix}{c}") for c in columns]
    if on_duplicate == "flag":
        count = OLD_COPIES if present == IN_OLD else NEW_COPIES
        # One of the copies, whole, and the same one in every run.
        orderable = all(_orderable(df.schema[c].dataType) for c in columns)
        whole = F.struct(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in columns] or [F.lit(True).alias("__none")])
        one = F.min(whole) if orderable else F.min_by(whole, F.xxhash64(F.to_json(whole)))
        folded = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), one.alias("__one"))
        return folded.select(
            *[f"{prefix}key{i}" for i in range(len(key))], count, "__one.*", F.lit(True).alias(present)
        )
    if on_duplicate == "fail":
        df = require_unique(df, key, "old state" if present == IN_OLD else "new state", null_keys)
    return df.select(*keys, *values, F.lit(True).alias(present))


def pair_states(
    old: DataFrame,
    new: DataFrame,
    key: list[str],
    *,
    old_columns: list[str] | None = None,
    new_columns: list[str] | None = None,
    on_duplicate: str = "fail",
    null_keys: bool = True,
    how: str = "full_outer",
) -> DataFrame:
    """Key columns, presence flags and the asked-for columns of both sides.

    ``old_columns`` / ``new_columns`` default to every non-key column. Columns
    come back as ``old_side(name)`` and ``new_side(name)``.
    """
    if not key:
        raise ValueError("a key of at least one column is needed")
    if on_duplicate not in ("fail", "flag", "trust"):
        raise ValueError(f"unknown on_duplicate {on_duplicate!r}")
    old = align_names(old, key)
    new = align_names(new, key)
    old_columns = [c for c in old.columns if c not in key] if old_columns is None else old_columns
    new_columns = [c for c in new.columns if c not in key] if new_columns is None else new_columns

    left = _one_side(old, key, old_columns, "__old_", IN_OLD, on_duplicate, null_keys)
    right = _one_side(new, key, new_columns, "__new_", IN_NEW, on_duplicate, null_keys)
    sides = [(F.col(f"__old_key{i}"), F.col(f"__new_key{i}")) for i in range(len(key))]
    same_key = all_of([a.eqNullSafe(b) if null_keys else a == b for a, b in sides])
    joined = left.join(right, same_key, how)

    keys = [
        F.when(F.col(IN_NEW), F.col(f"__new_key{i}")).otherwise(F.col(f"__old_key{i}")).alias(k)
        for i, k in enumerate(key)
    ]
    flags = [F.coalesce(F.col(f), F.lit(False)).alias(f) for f in (IN_OLD, IN_NEW)]
    if on_duplicate == "flag":
        flags += [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in (OLD_COPIES, NEW_COPIES)]
    return joined.select(
        *keys,
        *flags,
        *[old_side(c) for c in old_columns],
        *[new_side(c) for c in new_columns],
    )
