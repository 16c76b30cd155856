from pyspark.sql import functions as F

from conftest import rows
from rowtide.spec import ForeignKeySpec
from rowtide.streaming import changes as feeds

TIMES = {"child_time": "t", "parent_time": "t", "before": "2 hours", "after": "30 minutes", "bucket": "10 minutes", "delay": "10 minutes"}
FK = ForeignKeySpec(("k",), "parents", ("id",), "child_fk")


def feed(spark, path, kind, *batch):
    made = spark.createDataFrame(list(batch), kind).withColumn("t", F.to_timestamp(F.concat(F.lit("2024-05-01 "), "t")))
    made.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(made.schema).parquet(path)


def test_a_child_waits_for_its_parent(spark, tmp_path):
    children, parents, out, progress = (str(tmp_path / n) for n in ("children", "parents", "out", "progress"))

    def run(of_children, of_parents):
        c = feed(spark, children, "n int, k int, t string", *of_children)
        p = feed(spark, parents, "id int, t string", *of_parents)
        feeds.run_available(feeds.stream_reference_check(c, p, FK, out, progress, **TIMES))
        return rows(spark.read.schema("n int, k int, constraint_name string").parquet(out))

    first = [(1, 1, "10:00"), (2, 2, "10:00"), (3, None, "10:00"), (4, 3, "10:00"), (5, 4, "10:00"), (2, 2, "10:00"), (9, 9, None)]
    early = [(3, "08:30"), (4, "07:00"), *[(3, "08:31")] * 50, (None, "10:00"), (4, None)]
    assert run(first, early) == []  # nothing is late enough yet to be missing
    # the parent of row 1 comes after it, in a later run; that of row 5 was too early, row 2 (twice) has none
    assert run([(6, 7, "10:20")], [(1, "10:20"), (None, "10:21")]) == []
    closed = run([(7, 99, "13:00"), (0, None, "23:00")], [(99, "13:00"), (None, "23:00")])
    assert closed == [(2, 2, "child_fk"), (2, 2, "child_fk"), (5, 4, "child_fk"), (6, 7, "child_fk")]
    assert run([(8, 8, "13:05")], [(8, "13:06")]) == closed


def test_a_parent_behind_the_span_is_missing(spark, tmp_path):
    c = feed(spark, str(tmp_path / "c"), "n int, k int, t string", (1, 1, "10:00"), (2, 2, "10:00"), (0, 99, "15:00"))
    p = feed(spark, str(tmp_path / "p"), "id int, t string", (1, "10:39"), (2, "10:41"), (99, "15:00"))
    writer = feeds.stream_reference_check(c, p, FK, str(tmp_path / "o"), str(tmp_path / "w"), **TIMES)
    feeds.run_available(writer)
    assert rows(spark.read.parquet(str(tmp_path / "o")), "n") == [(2,)]
