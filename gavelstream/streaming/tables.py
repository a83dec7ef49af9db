"""The operators over the given tables as streams; each goes on from ``root`` when run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import MergeableAggregate
from ..operators.windows import hop, window_bounds, window_count
from ..plans import tables as plan
from .auctions import best_in_one_plan, highest_of_each, last_rows_average, window_aggregate
from .run import to_files


def purchases(events: DataFrame, root: str | None = None) -> DataFrame:
    return to_files(plan.purchases(events), "purchases", root)


def orders_of_segment(orders: DataFrame, customers: DataFrame, root: str | None = None) -> DataFrame:
    """Orders as a stream; the customers are a table that is read again with every micro-batch."""
    return to_files(plan.orders_of_segment(orders, customers), "segment", root)


def hot_users(events: DataFrame, root: str | None = None) -> DataFrame:
    def counts() -> DataFrame:
        return window_count(events, ["user_id"], hop("ts", "2 hours", "10 hours"), "event_count")

    return to_files(best_in_one_plan(counts, "event_count"), "hot-users", root)


def events_per_type(events: DataFrame, root: str | None = None) -> DataFrame:
    return to_files(plan.events_per_type(events), "events-per-type", root)


def active_users(events: DataFrame, root: str | None = None) -> DataFrame:
    """Distinct users and kinds of event of each window, emitted when first seen."""
    return to_files(plan.active_users(events), "active-users", root)


def shipped_in_time(orders: DataFrame, lineitem: DataFrame, root: str | None = None) -> DataFrame:
    """Two streams joined within a bounded interval: orders and their lines."""
    return to_files(plan.shipped_in_time(orders, lineitem, at_most=plan.IN_TIME), "shipped", root)


def highest_value(events: DataFrame, root: str | None = None) -> DataFrame:
    best = best_in_one_plan(lambda: highest_of_each(events, ["user_id", "event_type"], "value", "10 hours", "ts"), "value")
    return to_files(best, "highest-value", root)


def single_highest(events: DataFrame, root: str | None = None) -> DataFrame:
    return to_files(window_bounds(plan.highest_event(events)), "single-highest", root)


def last_values(events: DataFrame, root: str | None = None) -> DataFrame:
    rows = plan.whole_values(events).select("user_id", "ts", "event_id", "value")
    return last_rows_average(rows, "user_id", [("ts", False), ("event_id", False)], "value", 10, root)


def value_spread(events: DataFrame, function: MergeableAggregate, root: str | None = None) -> DataFrame:
    rows = plan.whole_values(events).select("user_id", F.col("value").alias("price"), F.col("ts").alias("date_time"))
    return window_aggregate(rows, ["user_id"], function, "10 hours", root).drop("window_start")
