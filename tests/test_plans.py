"""What the planner makes of the queries."""

import pytest
from conftest import SF_DIR

from gavelstream.plans import auctions as plan
from gavelstream.plans import tables as other
from gavelstream.registry import BATCH, Tables
from gavelstream.sources.tables import from_time, parquet_files


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bid_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bids"))
    Tables(spark, SF_DIR).bid.write.mode("overwrite").parquet(path)
    return parquet_files(spark, "bid", path)


def test_filter_and_columns_reach_the_scan(bid_files):
    text = physical(plan.selection(bid_files))
    assert "In(auction, [1007,1020,2001,2019,2087])" in text
    assert "ReadSchema: struct<auction:bigint,price:bigint,date_time:timestamp_ntz>" in text
    assert "GreaterThanOrEqual(date_time" in physical(from_time(bid_files, "2024-01-01 00:00:05"))


def test_stateless_queries_do_not_shuffle(bid_files):
    assert "Exchange" not in physical(plan.currency_conversion(bid_files))
    assert "Exchange" not in physical(plan.selection(bid_files))


def test_groups_are_cut_before_the_shuffle(bid_files):
    text = physical(plan.last_bids_average(bid_files))
    assert text.index("WindowGroupLimit") < text.rindex("Exchange") < text.rindex("WindowGroupLimit")


def test_counts_combine_before_the_shuffle(bid_files):
    text = physical(plan.bid_counts(bid_files))
    assert text.index("Exchange") < text.index("partial_count")


def test_highest_bids_are_not_shuffled_whole(bid_files):
    text = physical(plan.highest_bid(bid_files))
    assert "BroadcastHashJoin" in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", sorted(BATCH))
def test_no_cross_joins(spark, name):
    text = physical(BATCH[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_lines_are_pruned(spark):
    t = Tables(spark, SF_DIR)
    text = physical(other.average_largest_line(t.orders, t.lineitem))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in text
