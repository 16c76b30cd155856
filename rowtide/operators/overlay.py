"""Layer compositing: several ordered states become one.

Layer 0 is the base. A layer supplies the columns in its header, so whether a
value counts is known from the header and never from the value being NULL.
Layers are folded by one aggregate on the key, combined before its shuffle.

A key may occur once in a layer (``on_duplicate='fail'``, proved, or
``'trust'``) unless the layer is taken by ``'each'``: then every row of the key
is a version of its own and all of them count, as in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.functions.cells import all_of, texts_present
from rowtide.operators.diff import TOMBSTONE, live_rows
from rowtide.operators.pairing import align_names, find_column, require_unique

LAYER = "_layer"


def stack_layers(layers: list[DataFrame], on: list[str]) -> tuple[DataFrame, dict[str, list[int]]]:
    """All layers in one frame with their number, and for every column the
    numbers of the layers that supply it."""
    if not layers:
        raise ValueError("at least one layer is needed")
    names: dict[str, str] = {}
    for layer in layers:
        for c in layer.columns:
            names.setdefault(c.lower(), c)
    supplied: dict[str, list[int]] = {}
    stacked = None
    for number, layer in enumerate(layers):
        aligned = align_names(layer, list(names.values()))
        for k in on:
            if find_column(aligned, k) is None:
                raise ValueError(f"layer {number} has no key column {k!r}")
        for c in aligned.columns:
            supplied.setdefault(c, []).append(number)
        part = aligned.withColumn(LAYER, F.lit(number))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked, supplied


def _when_supplied(numbers: list[int], total: int) -> Column:
    """Layer number, where the layer supplies the column."""
    if len(numbers) == total:
        return F.col(LAYER)
    return F.when(F.col(LAYER).isin(*numbers), F.col(LAYER))


def _modes(layers: list[DataFrame], on_duplicate: str | list[str]) -> list[str]:
    """What is done about repeated keys, layer by layer."""
    modes = [on_duplicate] * len(layers) if isinstance(on_duplicate, str) else list(on_duplicate)
    if len(modes) != len(layers):
        raise ValueError("on_duplicate is one word, or one for each layer")
    return modes


def _versions(layer: DataFrame, first: int, pk: list[str], tombstone: str) -> tuple[DataFrame, dict[str, str]]:
    """One layer in the form of :func:`_composite`, row by row."""
    stacked, supplied = stack_layers([layer], pk)
    flag = next((c for c in supplied if c.lower() == tombstone.lower()), None)
    number = F.lit(first)
    buried = F.lit(-1) if flag is None else F.when(F.coalesce(F.col(f"`{flag}`"), F.lit(False)), number).otherwise(-1)
    values = [c for c in supplied if c not in pk and c != flag]
    rows = stacked.select(
        *pk,
        buried.alias("__buried"),
        number.alias("__top"),
        number.alias("__last"),
        *[F.col(f"`{c}`").alias(f"__v_{c}") for c in values],
    )
    return rows, {c: "__last" for c in values}


def _one_over_another(
    lower: tuple[DataFrame, dict[str, str]], upper: tuple[DataFrame, dict[str, str]], pk: list[str]
) -> tuple[DataFrame, dict[str, str]]:
    """Two composites as one: a row for every pair of versions of a key."""
    (below, last_below), (above, last_above) = lower, upper
    right = above.select(*[F.col(f"`{c}`").alias(f"__up_{c}") for c in above.columns])
    both = below.join(right, all_of([F.col(k).eqNullSafe(F.col(f"__up_{k}")) for k in pk]), "full_outer")

    def up(c: str) -> Column:
        return F.col(f"`__up_{c}`")

    columns = [F.greatest(F.col(c), up(c)).alias(c) for c in ("__buried", "__top")]
    last = {c: f"__last_{c}" for c in [*last_below, *[c for c in last_above if c not in last_below]]}
    for c, name in last.items():
        value, number = F.col(f"`__v_{c}`"), F.col(f"`{last_below[c]}`") if c in last_below else None
        if c in last_above:
            newer = up(last_above[c])
            value = up(f"__v_{c}") if number is None else F.when(newer.isNotNull(), up(f"__v_{c}")).otherwise(value)
            number = newer if number is None else F.greatest(number, newer)
        columns += [number.alias(name), value.alias(f"__v_{c}")]
    keys = [F.when(up("__top").isNotNull(), up(k)).otherwise(F.col(k)).alias(k) for k in pk]
    return both.select(*keys, *columns), last


def _all_versions(
    layers: list[DataFrame], first: int, pk: list[str], tombstone: str, modes: list[str]
) -> tuple[DataFrame, dict[str, str]]:
    """:func:`_composite` with all versions of the keys that a layer taken by
    ``each`` repeats. Layers between such ones are folded as ever."""
    if "each" not in modes:
        return _composite(layers, first, pk, tombstone)
    names: dict[str, str] = {}
    for layer in layers:
        for c in layer.columns:
            names.setdefault(c.lower(), c)
    runs: list[tuple[int, list[DataFrame]]] = []
    for i, layer in enumerate(layers):
        layer = align_names(layer, list(names.values()))
        if i and "each" not in modes[i - 1 : i + 1]:
            runs[-1][1].append(layer)
        else:
            runs.append((first + i, [layer]))
    found = None
    for number, run in runs:
        one = _versions(run[0], number, pk, tombstone) if len(run) == 1 else _composite(run, number, pk, tombstone)
        found = one if found is None else _one_over_another(found, one, pk)
    return found


def _composite(layers: list[DataFrame], first: int, pk: list[str], tombstone: str) -> tuple[DataFrame, dict[str, str]]:
    """The layers folded to one row per key, and for every value column the name
    of the aggregate that holds its last supplier.

    ``__top`` is the last layer that has the key, ``__buried`` the last one that
    flagged it (-1 if none). Layers are numbered from ``first``.
    """
    stacked, supplied = stack_layers(layers, pk)
    flag = next((c for c in supplied if c.lower() == tombstone.lower()), None)
    layer = F.col(LAYER) + first
    buried = F.lit(-1)
    if flag is not None:
        supplied.pop(flag)
        buried = F.coalesce(F.max(F.when(F.coalesce(F.col(f"`{flag}`"), F.lit(False)), layer)), F.lit(-1))
    values = [c for c in supplied if c not in pk]

    # Columns with the same suppliers share one "last supplier" aggregate.
    total = len(layers)
    shared = {numbers: f"__last_{i}" for i, numbers in enumerate(dict.fromkeys(tuple(supplied[c]) for c in values))}
    folded = stacked.groupBy(*pk).agg(
        buried.alias("__buried"),
        F.max(layer).alias("__top"),
        *[F.max(_when_supplied(list(n), total) + first).alias(name) for n, name in shared.items()],
        *[F.max_by(F.col(f"`{c}`"), _when_supplied(supplied[c], total)).alias(f"__v_{c}") for c in values],
    )
    return folded, {c: shared[tuple(supplied[c])] for c in values}


def overlay_rows(
    layers: list[DataFrame], pk: list[str], tombstone: str = TOMBSTONE, on_duplicate: str | list[str] = "fail"
) -> DataFrame:
    """Composite rows: the last layer wins for each column it supplies, unseen
    keys are appended, and a tombstone removes what the layers below built. A
    key that a later layer brings back starts afresh.

    The upper layers are folded among themselves and meet the base in one left
    join, so a large base need not move for small layers (Spark broadcasts them
    if they are measured to be small). Keys the base lacks are found by its keys
    alone. Keys have to be unique within a layer; ``on_duplicate='trust'`` skips
    the proof, ``'each'`` makes a row of every combination of a key's versions.
    A list gives each layer its own word.
    """
    if not layers:
        raise ValueError("at least one layer is needed")
    layers, modes = [align_names(d, pk) for d in layers], _modes(layers, on_duplicate)
    layers = [require_unique(d, pk, f"layer {i}") if m == "fail" else d for i, (d, m) in enumerate(zip(layers, modes))]
    base = live_rows(layers[0], tombstone)
    if len(layers) == 1:
        return base
    base_columns = [c for c in base.columns if c not in pk]
    aligned = [align_names(d, base_columns) for d in layers[1:]]
    upper, last = _all_versions(aligned, 1, pk, tombstone, modes[1:])
    alive = F.col("__top") > F.col("__buried")
    columns = [*base_columns, *[c for c in last if c not in base_columns]]

    def from_upper(c: str) -> Column:
        """Whether a layer above the last tombstone supplies the column."""
        return F.col(f"`{last[c]}`") > F.col("__buried")

    keys = upper.select(*[F.col(k).alias(f"__{k}") for k in pk], *[f"`{c}`" for c in upper.columns if c not in pk])
    same = all_of([F.col(k).eqNullSafe(F.col(f"__{k}")) for k in pk])
    found = F.col("__top").isNotNull()
    met = base.join(keys, same, "left").filter(~found | alive)
    merged = []
    for c in columns:
        below = F.when(~found | (F.col("__buried") < 0), F.col(f"`{c}`")) if c in base_columns else F.lit(None)
        merged.append((F.when(from_upper(c), F.col(f"`__v_{c}`")).otherwise(below) if c in last else below).alias(c))
    appended = []
    for c in columns:
        absent = F.lit(None).cast(base.schema[c].dataType) if c in base_columns else F.lit(None)
        appended.append((F.when(from_upper(c), F.col(f"`__v_{c}`")) if c in last else absent).alias(c))
    known = base.select(*[F.col(k).alias(f"__{k}") for k in pk])
    unseen = upper.filter(alive).join(known, same, "left_anti")
    return met.select(*pk, *merged).unionByName(unseen.select(*pk, *appended))


def _unique_layers(
    layers: list[DataFrame], key: list[str], modes: list[str], unproved: tuple[str, ...] = ("trust",)
) -> list[DataFrame]:
    """The layers, each proved to have one row per key unless that is trusted."""
    layers = [align_names(d, key) for d in layers]
    return [d if m in unproved else require_unique(d, key, f"layer {i}") for i, (d, m) in enumerate(zip(layers, modes))]


def overlay_overwrite(
    layers: list[DataFrame], key: list[str], attributes: list[str], on_duplicate: str = "fail"
) -> DataFrame:
    """The listed attributes are taken together from the last layer that has the
    key, blanks included; other columns keep their first value. Keys have to be
    unique within a layer; ``on_duplicate='trust'`` skips the proof."""
    layers = _unique_layers(layers, key, _modes(layers, on_duplicate))
    stacked, supplied = stack_layers(layers, key)
    others = [c for c in supplied if c not in key and c not in attributes]
    total = len(layers)
    merged = stacked.groupBy(*key).agg(
        F.max_by(F.struct(*attributes), LAYER).alias("__last"),
        *[F.min_by(F.col(f"`{c}`"), _when_supplied(supplied[c], total)).alias(c) for c in others],
    )
    return merged.select(*key, "__last.*", *others)


def overlay_append(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """Entries accumulate over the layers and are never replaced.

    The result stays in rows, one per entry, with its layer: the entries of one
    owner are not gathered, as nothing bounds their number.
    """
    return stack_layers(layers, key)[0]


def overlay_replace(layers: list[DataFrame], owner: list[str]) -> DataFrame:
    """List rows (one per entry): the last layer that has a list for an owner
    replaces the whole list."""
    stacked, _ = stack_layers(layers, owner)
    last = stacked.groupBy(*[F.col(o).alias(f"__{o}") for o in owner]).agg(F.max(LAYER).alias("__last"))
    match = all_of([stacked[o].eqNullSafe(last[f"__{o}"]) for o in owner] + [stacked[LAYER] == last["__last"]])
    return stacked.join(last, match, "left_semi").drop(LAYER)


def overlay_update_only(base: DataFrame, overlay: DataFrame, key: list[str], on_duplicate: str = "fail") -> DataFrame:
    """Overlay values replace those of matching base rows; overlay rows without
    a base row are ignored. A key may occur once in the overlay (the base may
    repeat it); ``on_duplicate='trust'`` skips the proof, ``'each'`` gives a base
    row once for every overlay row of its key."""
    overlay = align_names(overlay, base.columns)
    if on_duplicate not in ("trust", "each"):
        overlay = require_unique(overlay, key, "overlay")
    values = [c for c in overlay.columns if c in base.columns and c not in key]
    found = overlay.select(*[F.col(k).alias(f"__{k}") for k in key], F.struct(*values or [F.lit(True).alias("_")]).alias("__found"))
    match = all_of([base[k].eqNullSafe(found[f"__{k}"]) for k in key])
    matched = F.col("__found").isNotNull()
    return base.join(found, match, "left").select(
        *[
            F.when(matched, F.col("__found")[c]).otherwise(base[c]).alias(c) if c in values else base[c]
            for c in base.columns
        ]
    )


def collect_addendums(
    layers: list[DataFrame],
    k: int,
    pk: list[str],
    tombstone: str = TOMBSTONE,
    on_duplicate: str | list[str] = "fail",
) -> DataFrame:
    """What the last ``k`` layers contribute, composited among themselves into one
    layer that gives the same result over the ones below.

    A key that they leave deleted stays, flagged in the tombstone column, as it
    also deletes what lies below. One that a later layer brings back is flagged in
    ``<tombstone>_below``: it starts afresh (see :func:`overlay_addendums`).
    ``on_duplicate`` is that of :func:`overlay_rows`.
    """
    if not 0 < k <= len(layers):
        raise ValueError("k has to be between 1 and the number of layers")
    modes = _modes(layers, on_duplicate)[-k:]
    folded, last = _all_versions(_unique_layers(layers[-k:], pk, modes, ("trust", "each")), 0, pk, tombstone, modes)
    dead = F.col("__top") <= F.col("__buried")
    values = [F.when(~dead & (F.col(f"`{last[c]}`") > F.col("__buried")), F.col(f"`__v_{c}`")).alias(c) for c in last]
    supplied = [F.when(~dead & (F.col(f"`{last[c]}`") > F.col("__buried")), F.lit(c)) for c in last]
    return folded.select(
        *pk, *values, dead.alias(tombstone), (~dead & (F.col("__buried") >= 0)).alias(f"{tombstone}_below"),
        texts_present(supplied).alias("_supplied"),
    )


def overlay_addendums(
    base: DataFrame, addendums: DataFrame, pk: list[str], tombstone: str = TOMBSTONE
) -> DataFrame:
    """A state with the result of :func:`collect_addendums` over it."""
    base = live_rows(align_names(base, pk), tombstone)
    skip = {*pk, tombstone, f"{tombstone}_below", "_supplied"}
    values = [c for c in addendums.columns if c not in skip]
    base_columns = [c for c in align_names(base, values).columns if c not in pk]
    base = align_names(base, values)
    above = addendums.select(*[F.col(c).alias(f"__{c}") for c in addendums.columns])
    same = all_of([F.col(k).eqNullSafe(F.col(f"__{k}")) for k in pk])
    dead, afresh = F.coalesce(F.col(f"__{tombstone}"), F.lit(False)), F.coalesce(F.col(f"__{tombstone}_below"), F.lit(False))
    columns = [*base_columns, *[c for c in values if c not in base_columns]]
    met = base.join(above, same, "left").filter(~dead)
    merged = []
    for c in columns:
        below = F.when(~afresh, F.col(f"`{c}`")) if c in base_columns else F.lit(None)
        given = F.coalesce(F.array_contains("___supplied", c), F.lit(False))
        merged.append((F.when(given, F.col(f"`__{c}`")).otherwise(below) if c in values else below).alias(c))
    known = base.select(*[F.col(k).alias(f"__{k}") for k in pk])
    unseen = addendums.filter(~F.col(tombstone)).join(known, same, "left_anti")
    kinds = {c: base.schema[c].dataType for c in base_columns}
    appended = [F.col(f"`{c}`") if c in values else F.lit(None).cast(kinds[c]).alias(c) for c in columns]
    return met.select(*pk, *merged).unionByName(unseen.select(*pk, *appended))


def duplicate_identities(catalog: DataFrame, scope: list[str], identity: list[str]) -> DataFrame:
    """Objects that share an identity when case is ignored, with their number."""
    names = [F.lower(c).alias(c) for c in identity]
    return catalog.groupBy(*scope, *names).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
