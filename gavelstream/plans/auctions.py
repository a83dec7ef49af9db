"""Queries q1 to q8 over persons, auctions and bids, as batch plans."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import inside_intervals, interval_join, listed_between_join, merged_intervals, window_join
from ..operators.ranking import arg_max, best_with_ties, first_value, top_k_per_group
from ..operators.windows import distinct_per_window, hop_count, tumble, window_bounds
from ..sources.tables import second_grain

# Fixed values of the workload.
EUROS_PER_DOLLAR = Decimal("0.89")
WATCHED_AUCTIONS = [1007, 1020, 2001, 2019, 2087]
LOCAL_CATEGORY = 10
LOCAL_STATES = ["or", "id", "ca"]
LAST_BIDS = 10
SIZE, SLIDE = "10 seconds", "2 seconds"


def currency_conversion(bids: DataFrame, rate: Decimal = EUROS_PER_DOLLAR) -> DataFrame:
    """q1: bids with the price in euros."""
    euros = (F.lit(rate) * F.col("price")).cast("double")
    return bids.select("auction", "bidder", euros.alias("price_euros"), "date_time")


def selection(bids: DataFrame, auctions: list[int] = WATCHED_AUCTIONS) -> DataFrame:
    """q2: bids on a few auctions."""
    return bids.where(F.col("auction").isin(auctions)).select("auction", "price", "date_time")


def local_sellers(persons: DataFrame, states: list[str] = LOCAL_STATES) -> DataFrame:
    return (persons.where(F.col("state").isin(states))
            .select(F.col("id").alias("person_id"), "name", "city", "state"))


def category_auctions(auctions: DataFrame, category: int = LOCAL_CATEGORY) -> DataFrame:
    return auctions.where(F.col("category") == category).select("id", "seller", "date_time")


def local_item_suggestion(persons: DataFrame, auctions: DataFrame) -> DataFrame:
    """q3: auctions of one category whose seller lives in one of a few states."""
    return (category_auctions(auctions)
            .join(local_sellers(persons), F.col("seller") == F.col("person_id"))
            .select("name", "city", "state", "id", "date_time"))


def bid_in_auction(auctions: DataFrame, bids: DataFrame, grain: str = "ms") -> DataFrame:
    """Bids made while an auction of their id was open, one row per bid and category.

    Ids are reused, so joining every bid with every auction of its id would grow with
    the square of the input. What the closing price needs is only whether some auction
    of that id and category was open, so the auctions are merged into disjoint pieces.
    """
    if grain == "second":
        auctions, bids = second_grain(auctions, "date_time", "expires"), second_grain(bids, "date_time")
    pieces = merged_intervals(auctions, ["id", "category"], "date_time", "expires")
    return inside_intervals(bids.select("auction", "price", "date_time"), pieces, {"auction": "id"},
                            "date_time", "date_time", "expires")


def bid_auction_pairs(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """Every bid with every auction of its id that was open at its time: as many rows as there are such pairs.

    Pairs come bid by bid and sorted by category within a list of auctions, so that written in columns they take
    about the room of the bids.
    """
    opened = auctions.select("id", "category", F.col("date_time").alias("_opened"), F.col("expires").alias("_until"))
    return listed_between_join(opened, bids.select("auction", "price", "date_time"), {"id": "auction"}, "_opened", "_until", "date_time",
                               ["category"], slot="1 day").select("auction", "price", "date_time", "category")


def closing_price(in_auction: DataFrame) -> DataFrame:
    """The highest price and the latest bid time per auction id and category."""
    return in_auction.groupBy("auction", "category").agg(
        F.max("price").alias("final"), F.max("date_time").alias("max_bid_time"))


def category_average(closings: DataFrame) -> DataFrame:
    """q4: average closing price per category."""
    return closings.groupBy("category").agg(
        F.avg("final").alias("avg_price"), F.max("max_bid_time").alias("max_date_time"))


def average_price_by_category(auctions: DataFrame, bids: DataFrame, grain: str = "ms") -> DataFrame:
    return category_average(closing_price(bid_in_auction(auctions, bids, grain)))


def bid_counts(bids: DataFrame) -> DataFrame:
    """Bids per auction and hopping window."""
    return hop_count(bids, ["auction"], "date_time", SLIDE, SIZE, "bid_count")


def hot_items(bids: DataFrame) -> DataFrame:
    """q5: the auctions with the most bids of each hopping window."""
    return window_bounds(best_with_ties(bid_counts(bids), ["window"], "bid_count"))


def last_bids_average(bids: DataFrame, last: int = LAST_BIDS) -> DataFrame:
    """q6: average price of each bidder's last bids."""
    newest = [F.desc("date_time"), F.asc("auction"), F.asc("price")]
    recent = top_k_per_group(bids.select("bidder", "auction", "price", "date_time"), ["bidder"], newest, last)
    return recent.groupBy("bidder").agg(F.avg("price").alias("avg_price"))


def _priced(bids: DataFrame) -> DataFrame:
    return bids.select("auction", "bidder", "price", tumble("date_time", SIZE))


def highest_bid(bids: DataFrame) -> DataFrame:
    """q7: the highest bids of each window, ties kept, equal bids once."""
    best = best_with_ties(_priced(bids), ["window"], "price", from_scan=True)
    return window_bounds(best.distinct())


def single_highest_bid(bids: DataFrame) -> DataFrame:
    """q7 with one bid per window: the earliest of the highest, then the lowest ids."""
    priced = bids.select("auction", "bidder", "price", "date_time", tumble("date_time", SIZE))
    negated_time = -F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"),
                                     F.col("date_time").cast("timestamp_ntz"))
    one = arg_max(priced, ["window"], ["auction", "bidder", "price"],
                  ["price", negated_time, -F.col("auction"), -F.col("bidder")])
    return window_bounds(one)


def new_persons(persons: DataFrame) -> DataFrame:
    return distinct_per_window(persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"),
                                              "date_time"),
                               ["person_id", "person_name"], tumble("date_time", SIZE))


def sellers(auctions: DataFrame) -> DataFrame:
    return distinct_per_window(auctions.select(F.col("seller").alias("seller_id"), "date_time"),
                               ["seller_id"], tumble("date_time", SIZE))


def new_sellers(persons: DataFrame, auctions: DataFrame) -> DataFrame:
    """q8: persons who registered and opened an auction in the same window."""
    joined = window_join(new_persons(persons), sellers(auctions), {"person_id": "seller_id"})
    return window_bounds(joined)


def first_names(persons: DataFrame) -> DataFrame:
    """One name per person id and window: that of the earliest row."""
    named = persons.select(F.col("id").alias("person_id"), "name", "date_time")
    return first_value(named, ["person_id", tumble("date_time", SIZE)], "name", ["date_time"])


def new_sellers_one_name(persons: DataFrame, auctions: DataFrame) -> DataFrame:
    """q8 with one row per person id: an interval join of window ends with zero bounds."""
    left = first_names(persons).select("person_id", "name", F.col("window.end").alias("window_end"))
    right = sellers(auctions).select("seller_id", F.col("window.end").alias("_seller_end"))
    joined = interval_join(left, right, {"person_id": "seller_id"}, "window_end", "_seller_end")
    return joined.select("person_id", "name", "seller_id", "window_end")


def auctions_after_registration(persons: DataFrame, auctions: DataFrame, upper: str = SIZE) -> DataFrame:
    """Auctions opened by a person within some time after registering."""
    left = persons.select(F.col("id").alias("person_id"), "name", F.col("date_time").alias("registered"))
    right = auctions.select("seller", F.col("id").alias("auction"), F.col("date_time").alias("opened"))
    joined = interval_join(left, right, {"person_id": "seller"}, "registered", "opened", upper=upper, slot=upper)
    return joined.select("person_id", "name", "auction", "registered", "opened")
