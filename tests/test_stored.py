import os

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from rowtide.operators import diff, partitions, stored
from rowtide.spec import PartitionSpec

KEY = ["k"]


def states(spark, n=4000):
    old = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("a"), F.col("id").cast("string").alias("b"))
    edited = F.when(F.col("k").between(100, 120), F.lit("new")).when(F.col("k") == 3000, F.lit(None)).otherwise(F.col("b"))
    new = old.filter(~F.col("k").between(110, 112)).withColumn("b", edited)
    more = spark.range(n, n + 3).select(F.col("id").alias("k"), F.lit(1).cast("bigint").alias("a"), F.lit("x").alias("b"))
    return old, new.unionByName(more)


def files(path):
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                with open(os.path.join(folder, name), "rb") as f:
                    found[os.path.relpath(os.path.join(folder, name), path)] = f.read()
    return found


# -- co-located ---------------------------------------------------------------


def test_colocated_states_meet_without_an_exchange(spark, tmp_path):
    old, new = states(spark)
    paths = [str(tmp_path / n) for n in ("old", "new", "changes")]
    for df, path in zip((old, new), paths):
        stored.write_colocated(df, path, KEY, buckets=4)
    o, n = [stored.read_colocated(spark, p) for p in paths[:2]]
    changes = stored.colocated_change_set(o, n, KEY)
    assert "Exchange" not in plan_of(changes)
    assert rows(changes) == rows(diff.change_set(old, new, KEY))
    stored.write_colocated_changes(changes, paths[2], KEY, buckets=4)
    after = stored.apply_colocated(o, stored.read_colocated(spark, paths[2]), KEY)
    assert "Exchange" not in plan_of(after)
    assert rows(after) == rows(new)
    assert {len([f for f in files(p)]) for p in paths[:2]} == {4}


def test_colocated_states_refuse_repeated_and_null_keys(spark, frame, tmp_path):
    for i, bad in enumerate(((1, 1), (1, None))):
        with pytest.raises(Exception, match="not unique or holds NULL"):
            stored.write_colocated(frame("k int", *[(k,) for k in bad]), str(tmp_path / str(i)), KEY, 2)


def test_colocated_changes_to_missing_and_present_keys(spark, frame, tmp_path):
    state = frame("k int, a int", (1, 1), (2, 2), (3, None))
    kind = "key struct<k: int>, op string, changed array<string>, after struct<a: int>"
    edits = [((9,), "U", ["a"], (9,)), ((8,), "D", None, None), ((2,), "I", None, (7,)), ((3,), "U", ["a"], (None,)), ((1,), "D", None, None)]
    stored.write_colocated(state, str(tmp_path / "s"), KEY, 2)
    stored.write_colocated_changes(spark.createDataFrame(edits, kind), str(tmp_path / "c"), KEY, 2)
    after = stored.apply_colocated(*[stored.read_colocated(spark, str(tmp_path / n)) for n in "sc"], KEY)
    assert rows(after) == [(2, 7), (3, None)]


# -- digested -----------------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_incremental_diff_reads_unequal_ranges_only(spark, tmp_path, ranges):
    old, new = states(spark)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    stored.write_digested(old, a, KEY, ranges=ranges)
    stored.write_digested(new, b, KEY, like=a)
    assert rows(stored.read_digested(spark, b)) == rows(new)
    only = stored.changed_ranges(spark, a, b)
    assert only and len(only) <= 5
    changes = stored.incremental_change_set(spark, a, b, KEY)
    assert rows(changes) == rows(diff.change_set(old, new, KEY))
    if ranges > 1:
        assert "PartitionFilters: [key_range#" in plan_of(changes, "formatted")
    assert stored.changed_ranges(spark, a, a) == []
    assert rows(stored.incremental_change_set(spark, a, a, KEY)) == []


def test_digests_see_moved_nulls_names_and_tombstones(spark, frame, tmp_path):
    made = {
        "base": frame("k string, a int, b int", ("x", 1, None), (None, 2, 2)),
        "moved": frame("k string, a int, b int", ("x", None, 1), (None, 2, 2)),
        "named": frame("k string, a int, c int", ("x", 1, None), (None, 2, 2)),
        "dead": frame("k string, a int, b int, _delete boolean", ("x", 1, None, True), (None, 2, 2, None), ("z", 0, 0, True)),
        "none": frame("k string, a int, b int"),
        "dozing": frame("k string, a int, b int, _delete boolean", ("x", 1, None, False), (None, 2, 2, None)),
    }
    base = str(tmp_path / "base")
    for name, df in made.items():
        stored.write_digested(df, str(tmp_path / name), KEY, ranges=3, like=None if name == "base" else base)
    for name, df in made.items():
        found = rows(stored.incremental_change_set(spark, base, str(tmp_path / name), KEY), "key", "op", "changed")
        assert found == rows(diff.change_set(made["base"], df, KEY), "key", "op", "changed"), name
    assert stored.changed_ranges(spark, base, str(tmp_path / "dozing")) == []
    other = str(tmp_path / "other")
    stored.write_digested(spark.createDataFrame([("q", 1, 1), ("r", 1, 1), ("s", 1, 1)], made["base"].schema), other, KEY, ranges=3)
    with pytest.raises(ValueError, match="key ranges differ"):
        stored.changed_ranges(spark, base, other)


def test_range_numbers_count_the_bounds_below(frame):
    df = frame("k bigint", *[(k,) for k in (-5, 0, 1, 9, 10, 11, 500, None)])
    for bounds in ([], [0], [0, 10], list(range(0, 300, 3))):
        expected = [(k, sum(b <= k for b in bounds) if k is not None else 0) for (k,) in [tuple(r) for r in df.collect()]]
        assert rows(df.select("k", stored._range_of(F.col("k"), bounds).alias("r"))) == sorted(expected, key=repr)


# -- partitioned --------------------------------------------------------------


def partitioned(spark, path, df, spec):
    partitions.write_partitioned(df, spec, path)
    return files(path)


def test_only_touched_folders_change(spark, frame, tmp_path):
    spec, path = PartitionSpec("a", 10), str(tmp_path / "p")
    old = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 10).alias("a"), F.lit("v").alias("b"))
    new = (
        old.filter("a <> 4 AND k <> 13")  # folder 4 empties, folder 3 loses a row
        .withColumn("a", F.when(F.col("k") == 5, F.lit(None)).when(F.col("k") == 16, F.lit(17)).otherwise(F.col("a")).cast("bigint"))
    )
    before = partitioned(spark, path, old, spec)
    changes = diff.cut_lineage(diff.change_set(old, new, KEY))
    touched = stored.apply_by_partition(spark, path, changes, spec, KEY)
    assert touched == ["partition_03", "partition_04", "partition_05", "partition_06", "partition_07", "unroutable"]
    assert rows(spark.read.parquet(path), "k", "a", "b") == rows(new)
    after, folder = files(path), lambda name: name.split("/")[0].removeprefix("part=")
    assert {n: c for n, c in before.items() if folder(n) not in touched} == {n: c for n, c in after.items() if folder(n) not in touched}
    assert not {n for n in before if folder(n) in touched} & set(after)
    assert not os.path.exists(os.path.join(path, "part=partition_04"))
    assert rows(partitions.read_partition(spark, path, spec, 17), "k") == [(i,) for i in []] + [(16,)]
    assert stored.apply_by_partition(spark, path, changes.limit(0), spec, KEY) == []


def test_partition_of_a_key_column(spark, frame, tmp_path):
    spec, path = PartitionSpec("k", 4), str(tmp_path / "p")
    old, new = frame("k bigint, a int", (1, 1), (2, 2), (3, 3)), frame("k bigint, a int", (1, 1), (2, 9), (7, 0))
    partitioned(spark, path, old, spec)
    changes = diff.cut_lineage(diff.change_set(old, new, KEY))
    assert stored.apply_by_partition(spark, path, changes, spec, KEY) == ["partition_2", "partition_3"]
    assert rows(spark.read.parquet(path), "k", "a") == rows(new)
    evolved = diff.change_set(new, new.withColumn("c", F.lit(1)), KEY)
    with pytest.raises(ValueError, match="other columns"):
        stored.apply_by_partition(spark, path, evolved, spec, KEY)
