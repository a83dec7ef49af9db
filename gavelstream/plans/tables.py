"""The same operators on other tables: events, orders, line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import between_join, interval_join, window_join
from ..operators.aggregates import two_level
from ..operators.changes import changelog, changelog_records, upsert_latest
from ..operators.ranking import arg_max, best_with_ties, first_value, top_k_per_group
from ..operators.windows import distinct_per_window, hop, tumble, window_bounds, window_count
from ..session import spread


def hot_users(events: DataFrame) -> DataFrame:
    """Users with the most events of each 10-hour window, every 2 hours."""
    counts = window_count(events, ["user_id"], hop("ts", "2 hours", "10 hours"), "event_count")
    return window_bounds(best_with_ties(counts, ["window"], "event_count"))


def highest_value(events: DataFrame) -> DataFrame:
    """Events of the highest value of each 10-hour window, equal ones once."""
    valued = events.select("user_id", "event_type", "value", tumble("ts", "10 hours"))
    best = best_with_ties(valued, ["window"], "value", from_scan=True)
    return window_bounds(best.distinct())


def hot_parts(lineitem: DataFrame) -> DataFrame:
    """Parts shipped most often in each 10-day window, every 2 days."""
    shipped = spread(lineitem.select("l_partkey", "l_shipdate"))
    counts = window_count(shipped, ["l_partkey"], hop("l_shipdate", "2 days", "10 days"), "line_count")
    return window_bounds(best_with_ties(counts, ["window"], "line_count"))


IN_TIME = "90 days"


def shipped_in_time(orders: DataFrame, lineitem: DataFrame, at_most: str | None = None) -> DataFrame:
    """Lines shipped within 90 days of their order; an order key occurs once."""
    placed = orders.select("o_orderkey", "o_orderpriority", "o_orderdate",
                           (F.col("o_orderdate") + F.expr(f"INTERVAL {IN_TIME}")).alias("_until"))
    lines = lineitem.select("l_orderkey", "l_shipdate", F.col("l_quantity").cast("bigint").alias("quantity"))
    return between_join(placed, lines, {"o_orderkey": "l_orderkey"}, "o_orderdate", "_until",
                        "l_shipdate", at_most).drop("_until", "l_orderkey")


def average_largest_line(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Average over orders of their largest line shipped in time, per priority."""
    return two_level(
        shipped_in_time(orders, lineitem),
        ["o_orderkey", "o_orderpriority"],
        [F.max("quantity").alias("largest"), F.max("l_shipdate").alias("latest")],
        ["o_orderpriority"],
        [F.avg("largest").alias("avg_largest"), F.max("latest").alias("max_shipdate")])


def last_orders(orders: DataFrame, last: int = 10) -> DataFrame:
    """Each customer's last orders: how many, and the total in whole currency units."""
    recent = top_k_per_group(orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"),
                             ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], last)
    return recent.groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.sum(F.floor("o_totalprice")).alias("total"),
        F.min("o_orderdate").alias("since"))


def urgent_and_other(orders: DataFrame) -> DataFrame:
    """Customers with an urgent and another order in the same 10-day window."""
    def customers(rows: DataFrame, name: str) -> DataFrame:
        return distinct_per_window(rows.select(F.col("o_custkey").alias(name), "o_orderdate"), [name],
                                   tumble("o_orderdate", "10 days"))

    urgent = F.col("o_orderpriority") == "1-URGENT"
    joined = window_join(customers(orders.where(urgent), "custkey"),
                         customers(orders.where(~urgent), "_other"), {"custkey": "_other"})
    return window_bounds(joined.drop("_other"))


def purchases(events: DataFrame, rate: float = 0.89) -> DataFrame:
    """Purchases with their value at another rate: a filter and a projection."""
    return events.where(F.col("event_type") == "purchase").select(
        "event_id", "user_id", (F.col("value") * F.lit(rate)).alias("value_euros"), "ts")


def orders_of_segment(orders: DataFrame, customers: DataFrame, segment: str = "BUILDING") -> DataFrame:
    """Urgent orders of one market segment's customers; a customer key occurs once, so the result is linear."""
    some = customers.where(F.col("c_mktsegment") == segment).select("c_custkey", "c_name", "c_nationkey")
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey", "o_orderdate")
    return urgent.join(some, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey")


def highest_event(events: DataFrame) -> DataFrame:
    """One event of the highest value of each 10-hour window, of equal ones that of the smallest id."""
    return arg_max(events, [tumble("ts", "10 hours")], ["event_id", "user_id", "event_type", "value"],
                   [F.col("value"), -F.col("event_id")])


def whole_values(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", F.floor("value").cast("bigint").alias("value"), "ts")


def newest_first() -> list:
    return [F.desc("ts"), F.desc("event_id")]


def last_values(events: DataFrame, last: int = 10) -> DataFrame:
    """Average whole value of each user's last events."""
    recent = top_k_per_group(whole_values(events), ["user_id"], newest_first(), last)
    return recent.groupBy("user_id").agg(F.avg("value").alias("avg_value"))


def active_users(events: DataFrame) -> DataFrame:
    """Distinct users and kinds of event of each 10-hour window."""
    return window_bounds(distinct_per_window(events, ["user_id", "event_type"], tumble("ts", "10 hours")))


def events_per_type(events: DataFrame) -> DataFrame:
    """Events of each kind in each 10-hour window."""
    return window_bounds(window_count(events, ["event_type"], tumble("ts", "10 hours"), "event_count"))


def top_values(events: DataFrame, k: int = 3) -> DataFrame:
    """Each user's events of the highest values, of equal ones that of the smaller id first."""
    return top_k_per_group(events.select("user_id", "event_id", "value"), ["user_id"],
                           [F.desc("value"), F.asc("event_id")], k)


def latest_event(events: DataFrame) -> DataFrame:
    """The latest event of each user, as an upsert by user leaves it."""
    return upsert_latest(events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])


def first_types(events: DataFrame) -> DataFrame:
    """The kind of each user's first event."""
    return first_value(events, ["user_id"], "event_type", ["ts"])


def type_changes(events: DataFrame, since: str) -> DataFrame:
    """Change records of events and whole values per kind, from those before a time to all."""
    def totals(some: DataFrame) -> DataFrame:
        return some.groupBy("event_type").agg(F.count("*").alias("events"),
                                              F.sum(F.floor("value").cast("bigint")).alias("total"))

    return changelog_records(changelog(totals(events.where(F.col("ts") < F.lit(since).cast("timestamp_ntz"))),
                                       totals(events), ["event_type"]))


def errors_in_reach(events: DataFrame, slot: str | None = "2 days") -> DataFrame:
    """A user's errors within as many hours after a purchase as its value says."""
    bought = events.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("purchase_id"), "user_id", "ts",
        F.timestamp_add("HOUR", F.floor("value").cast("int"), F.col("ts")).alias("_until"))
    errors = events.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("error_id"), F.col("user_id").alias("_user"), F.col("ts").alias("error_ts"))
    return between_join(bought, errors, {"user_id": "_user"}, "ts", "_until", "error_ts", slot=slot).drop("_until", "_user")


def followed_up(orders: DataFrame) -> DataFrame:
    """Orders of a customer within 10 days after an urgent one."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    first = orders.where(urgent).select("o_custkey", F.col("o_orderkey").alias("urgent_order"), F.col("o_orderdate").alias("urgent_date"))
    other = orders.where(~urgent).select(F.col("o_custkey").alias("_cust"), "o_orderkey", "o_orderdate")
    return interval_join(first, other, {"o_custkey": "_cust"}, "urgent_date", "o_orderdate", upper="10 days",
                         slot="10 days").drop("_cust")


def lines_of_parts(lineitem: DataFrame, parts: tuple[int, ...] = (7, 20, 101, 119, 187)) -> DataFrame:
    """Lines of some parts: the filter and the columns reach the scan."""
    return lineitem.where(F.col("l_partkey").isin(*parts)).select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
