"""Plans that have to hold at any size."""

import re

from rowtide.operators import diff
from rowtide.plans.diff_queries import ORDER_KEY
from rowtide.plans.fixtures import table
from tests.conftest import SMALL, plan_of

def orders(spark, where):
    return table(spark, SMALL, "orders").filter(where)


def test_added_rows_read_only_keys_of_the_old_state(spark):
    plan = plan_of(diff.rows_added(orders(spark, "o_orderkey > 5"), orders(spark, "true"), ORDER_KEY), "formatted")
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan)
    assert "o_orderkey:bigint" in schemas


def test_filters_and_columns_reach_the_scan(spark):
    old, new = orders(spark, "o_orderkey > 5"), orders(spark, "o_orderkey > 7")
    narrow = diff.change_set(old.select("o_orderkey", "o_custkey"), new.select("o_orderkey", "o_custkey"), ORDER_KEY)
    plan = plan_of(narrow, "formatted")
    assert "GreaterThan(o_orderkey,5)" in plan and "GreaterThan(o_orderkey,7)" in plan
    assert "o_totalprice" not in plan


def test_one_join_compares_two_states(spark):
    old, new = orders(spark, "o_orderkey > 5"), orders(spark, "o_orderkey > 7")
    plan = plan_of(diff.change_set(old, new, ORDER_KEY, on_duplicate="trust"))
    assert plan.count("SortMergeJoin") == 1
    assert plan.count("Exchange hashpartitioning") == 2


def test_a_grouped_state_is_not_shuffled_again(spark):
    lines = table(spark, SMALL, "lineitem")
    old = lines.filter("l_orderkey > 5").groupBy("l_orderkey").agg({"l_quantity": "max"})
    new = lines.filter("l_orderkey > 7").groupBy("l_orderkey").agg({"l_quantity": "max"})
    plan = plan_of(diff.change_set(old, new, ["l_orderkey"], on_duplicate="trust", null_keys=False))
    assert plan.count("Exchange hashpartitioning") == 2
