"""Queries q1 to q8 as streams. Inputs are watermarked streams of the three entities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import MergeableAggregate
from ..operators.joins import interval_join
from ..operators.ranking import arg_max
from ..operators.windows import WINDOW, distinct_per_window, hop, tumble, window_bounds, window_count
from ..plans import auctions as plan
from ..session import new_path
from ..sources.records import decode, decode_and_reject
from ..sources.routing import route
from ..sources.tables import as_stream
from .carried import VERSION, upserts
from .keyed import Order, last_rows, reduced_window_process, window_states
from .run import setting, start_batches, to_files


def currency_conversion(bids: DataFrame, root: str | None = None) -> DataFrame:
    return to_files(plan.currency_conversion(bids), "q1", root)


def selection(bids: DataFrame, root: str | None = None) -> DataFrame:
    return to_files(plan.selection(bids), "q2", root)


def local_item_suggestion_stream(persons: DataFrame, auctions: DataFrame,
                                 state_ttl: str | None = None) -> DataFrame:
    """q3 as a stream. State is unbounded, as the query asks, unless ``state_ttl`` limits
    how far apart in time a person and an auction may be."""
    if state_ttl is None:
        return plan.local_item_suggestion(persons, auctions)
    local = (persons.where(F.col("state").isin(plan.LOCAL_STATES))
             .select(F.col("id").alias("person_id"), "name", "city", "state",
                     F.col("date_time").alias("_registered")))
    joined = interval_join(local, plan.category_auctions(auctions), {"person_id": "seller"},
                           "_registered", "date_time", f"-{state_ttl}", state_ttl)
    return joined.select("name", "city", "state", "id", "date_time")


def local_item_suggestion(persons: DataFrame, auctions: DataFrame, state_ttl: str | None = None,
                          root: str | None = None) -> DataFrame:
    return to_files(local_item_suggestion_stream(persons, auctions, state_ttl), "q3", root)


def bid_counts(bids: DataFrame, root: str | None = None) -> DataFrame:
    return to_files(window_bounds(plan.bid_counts(bids)), "q5-counts", root)


def best_in_one_plan(windowed: Callable[[], DataFrame], measure: str) -> DataFrame:
    """Rows with the largest measure of each window, ties kept, as one streaming plan.

    Rows of closed windows leave the first aggregation; a second takes their maximum, and a join of the two, on the window
    and the measure, finds those that reach it. Nothing is gathered by window: state is one row per key and open window,
    and one per window. ``windowed`` makes the aggregated stream anew, as each side of the join reads its own.
    """
    best = windowed().groupBy(WINDOW).agg(F.max(measure).alias("_best")).withColumnRenamed(WINDOW, "_window")
    joined = windowed().join(best, (F.col(WINDOW) == F.col("_window")) & (F.col(measure) == F.col("_best")))
    return window_bounds(joined.drop("_window", "_best"))


def hot_items(bids: DataFrame, root: str | None = None) -> DataFrame:
    """q5 as a stream."""
    return to_files(best_in_one_plan(lambda: plan.bid_counts(bids), "bid_count"), "q5", root)


def highest_of_each(rows: DataFrame, keys: Sequence[str], measure: str, size: str, time: str = "date_time") -> DataFrame:
    """The largest measure of each key and tumbling window. A row that is best in its window is its key's best."""
    return rows.groupBy(*keys, tumble(time, size)).agg(F.max(measure).alias(measure))


def highest_bid(bids: DataFrame, root: str | None = None) -> DataFrame:
    """q7 as a stream."""
    best = best_in_one_plan(lambda: highest_of_each(bids, ["auction", "bidder"], "price", plan.SIZE), "price")
    return to_files(best.select("auction", "bidder", "price", "window_start", "window_end"), "q7", root)


def window_aggregate(rows: DataFrame, keys: Sequence[str], function: MergeableAggregate, size: str, root: str | None = None) -> DataFrame:
    """A user aggregate per key and tumbling window as a stream, emitted when the window closes."""
    windowed = window_bounds(rows.select("*", tumble("date_time", size)))
    return to_files(window_states(windowed, keys, function), "udaf", root)


def single_highest_bid(bids: DataFrame, root: str | None = None) -> DataFrame:
    """q7 with one bid per window; the state is one row per window."""
    order = ["price", -F.unix_micros("date_time"), -F.col("auction"), -F.col("bidder")]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    one = arg_max(bids, [tumble("date_time", plan.SIZE)], ["auction", "bidder", "price"], order)
    return to_files(window_bounds(one), "q7-single", root)


def tumble_count(bids: DataFrame, root: str | None = None) -> DataFrame:
    counts = window_count(bids, ["auction"], tumble("date_time", plan.SIZE), "bid_count")
    return to_files(window_bounds(counts), "tumble-count", root)


def distinct_bids(bids: DataFrame, root: str | None = None) -> DataFrame:
    """Distinct (auction, bidder) of each window, emitted when first seen."""
    rows = distinct_per_window(bids, ["auction", "bidder"], tumble("date_time", plan.SIZE))
    return to_files(window_bounds(rows), "distinct", root)


def _grouped_persons(persons: DataFrame) -> DataFrame:
    renamed = persons.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"), "date_time")
    return window_count(renamed, ["person_id", "person_name"], tumble("date_time", plan.SIZE), "_rows").drop("_rows")


def _grouped_sellers(auctions: DataFrame) -> DataFrame:
    renamed = auctions.select(F.col("seller").alias("seller_id"), "date_time")
    return window_count(renamed, ["seller_id"], tumble("date_time", plan.SIZE), "_rows").drop("_rows")


def new_sellers(persons: DataFrame, auctions: DataFrame, root: str | None = None) -> DataFrame:
    """q8 as a stream: two windowed aggregations joined on key and window."""
    right = _grouped_sellers(auctions).withColumnRenamed(WINDOW, "_seller_window")
    joined = _grouped_persons(persons).join(
        right, (F.col("person_id") == F.col("seller_id")) & (F.col(WINDOW) == F.col("_seller_window")))
    return to_files(window_bounds(joined.drop("_seller_window")), "q8", root)


def new_sellers_one_name(persons: DataFrame, auctions: DataFrame, root: str | None = None) -> DataFrame:
    right = _grouped_sellers(auctions).withColumnRenamed(WINDOW, "_seller_window")
    joined = plan.first_names(persons).join(
        right, (F.col("person_id") == F.col("seller_id")) & (F.col(WINDOW) == F.col("_seller_window")))
    result = joined.select("person_id", "name", "seller_id", F.col(f"{WINDOW}.end").alias("window_end"))
    return to_files(result, "q8-one-name", root)


def auctions_after_registration(persons: DataFrame, auctions: DataFrame, root: str | None = None) -> DataFrame:
    """Interval join of two streams; the bounds let both sides forget old rows."""
    left = persons.select(F.col("id").alias("person_id"), "name", F.col("date_time").alias("registered"))
    right = auctions.select("seller", F.col("id").alias("auction"), F.col("date_time").alias("opened"))
    joined = interval_join(left, right, {"person_id": "seller"}, "registered", "opened", upper=plan.SIZE)
    return to_files(joined.select("person_id", "name", "auction", "registered", "opened"), "interval-join", root)


def routed(texts: DataFrame, root: str | None = None) -> DataFrame:
    """A mixed stream to one keyed folder for each topic, in one pass; ``of_topic`` reads one of them as a stream."""
    return to_files(route(texts), "routed", root, by=["topic"])


def topic_stream(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """An entity out of what ``routed`` has written below ``root``; only its folder is read."""
    texts = spark.readStream.schema("key string, value string, topic string").parquet(f"{root}/out").where(F.col("topic") == entity)
    return as_stream(decode(texts.select("value"), entity))


def decoded_and_rejected(texts: DataFrame, entity: str, root: str | None = None) -> DataFrame:
    """Good rows and rejects of JSON text, decoded once and written to a folder each, exactly once."""
    return to_files(decode_and_reject(texts, entity), "decoded", root, by=["sink"])


# --- last bids per bidder, and latest rows per key: results that upserts keep current ---

def last_rows_average(rows: DataFrame, key: str, order: Order, value: str, last: int, root: str | None = None,
                      ttl: str | None = None) -> DataFrame:
    """Average ``value`` of each key's ``last`` rows, kept current by upserts; the rows are in Spark's state store."""
    spark = rows.sparkSession
    root = root or new_path(spark, "last-rows")
    kind = rows.schema[key].dataType.simpleString()
    averages = upserts(spark, f"{root}/averages", f"{key} {kind}, avg_{value} double", [key])

    def step(batch: DataFrame, batch_id: int) -> None:
        averages.add(batch.select(key, F.col("average").alias(f"avg_{value}"), F.lit(batch_id).cast("bigint").alias(VERSION)), batch_id)

    # A time to live goes by the clock, so a run over what there is would go on for ever with micro-batches without data.
    with setting(spark, "spark.sql.streaming.noDataMicroBatches.enabled", "true" if ttl is None else "false"):
        query = start_batches(last_rows(rows, key, order, value, last, ttl), step, f"{root}/checkpoint", "update")
    query.awaitTermination()
    return averages.read(averages.last()).drop(VERSION)


def last_bids_average(bids: DataFrame, last: int = plan.LAST_BIDS, root: str | None = None) -> DataFrame:
    """q6 as an updating stream of (bidder, avg_price)."""
    order = [("date_time", False), ("auction", True), ("price", True)]
    return last_rows_average(bids.select("bidder", "date_time", "auction", "price"), "bidder", order, "price", last, root)


def latest_bid_totals(bids: DataFrame, root: str | None = None) -> DataFrame:
    """Bids and highest price per auction, kept current by upserts."""
    spark = bids.sparkSession
    root = root or new_path(spark, "upserts")
    totals = bids.groupBy("auction").agg(F.count("*").alias("bids"), F.max("price").alias("highest"))
    latest = upserts(spark, f"{root}/latest", "auction bigint, bids bigint, highest bigint", ["auction"])

    def step(batch: DataFrame, batch_id: int) -> None:
        latest.add(batch.withColumn(VERSION, F.lit(batch_id).cast("bigint")), batch_id)

    start_batches(totals, step, f"{root}/checkpoint", "update").awaitTermination()
    return latest.read(latest.last()).drop(VERSION)


# --- a user function over closed windows ---

SHARE_SCHEMA = ("auction bigint, bid_count bigint, window_start timestamp_ntz, window_end timestamp_ntz, "
                "level string")


def busy_levels(rows: pd.DataFrame) -> pd.DataFrame:
    """A window process function: no row for a quiet auction, one per level reached."""
    out = [rows[rows["bid_count"] >= least].assign(level=level)
           for level, least in (("busy", 5), ("very busy", 10))]
    return pd.concat(out, ignore_index=True)


def counted(rows: pd.DataFrame) -> pd.DataFrame:
    """How many rows a task read of each auction and window."""
    return rows.groupby(["auction", "window_start", "window_end"], as_index=False, sort=False).agg(bids=("auction", "size"))


def levels_of_windows(parts: pd.DataFrame) -> pd.DataFrame:
    """A process function: partial counts of auctions' bids in closed windows; a row for each level they reach together."""
    by = ["auction", "window_start", "window_end"]
    return busy_levels(parts.groupby(by, as_index=False, sort=False, dropna=False).agg(bid_count=("bids", "sum")))


def window_levels(bids: DataFrame, root: str | None = None) -> DataFrame:
    windowed = window_bounds(bids.select("auction", hop("date_time", plan.SLIDE, plan.SIZE)))
    levels = reduced_window_process(windowed, ["auction"], "bids bigint", counted, levels_of_windows, SHARE_SCHEMA)
    return to_files(levels, "window-levels", root)
