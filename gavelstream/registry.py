"""Every query by name, bound to a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import epoch_millis, hash_id, iso_millis, iso_seconds, json_row
from .operators import progress
from .operators.aggregates import MergeableAggregate, aggregate_with, process_windows
from .operators.changes import changelog, changelog_records, upsert_latest
from .operators.ranking import top_k_per_group
from .operators.windows import distinct_per_window, tumble, window_bounds, window_count
from .plans import auctions as plan
from .plans import samples, tables
from .schemas import AUCTION, BID, PERSON
from .schemas import ENTITIES as SCHEMA_OF
from .schemas import TABLES as SCHEMAS
from .sinks import json_records, keyed_records
from .sources import damage, derive, records, routing
from .sources.tables import LATENESS, as_stream, from_time
from .streaming import auctions as live
from .streaming import audit, closing, delivery, sampling
from .streaming.run import to_files
from .streaming import tables as live_tables

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The three derived entities and the given tables, static or streaming."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self._read("events")

    @property
    def orders(self) -> DataFrame:
        return self._read("orders")

    @property
    def lineitem(self) -> DataFrame:
        return self._read("lineitem")

    @property
    def customer(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/customer.parquet")

    @property
    def numbered(self) -> DataFrame:
        return derive.from_events(self.events)

    @property
    def person(self) -> DataFrame:
        return derive.person(self.numbered)

    @property
    def auction(self) -> DataFrame:
        return derive.auction(self.numbered)

    @property
    def bid(self) -> DataFrame:
        return derive.bid(self.numbered)


def batch(function: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(Tables(spark, sf_dir))


# --- JSON text made from the derived rows ---

def json_text(df: DataFrame, schema, epoch: bool = False) -> DataFrame:
    """Rows as wire JSON in ``value``, other columns kept."""
    fields = {}
    for name in schema.fieldNames():
        column = F.col(name)
        if name in ("date_time", "expires"):
            column = epoch_millis(column) if epoch else iso_millis(column)
        fields[name] = column
    return df.select(*[c for c in df.columns if c not in fields], json_row(fields).alias("value"))


def damaged(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of an entity as JSON records, some of them damaged; ``kind`` as in ``damage.DAMAGE``."""
    entity = kind.removeprefix("epoch ")
    cased = rows.withColumn("_case", F.col(damage.DECIDES[kind]) % damage.CASES)
    return damage.damaged(json_text(cased, SCHEMA_OF[entity], epoch=entity != kind), kind)


def mixed_events(t: Tables) -> DataFrame:
    """All three entities as one stream of JSON records."""
    return (json_text(t.person, PERSON)
            .unionByName(json_text(t.auction, AUCTION))
            .unionByName(json_text(t.bid, BID)))


class PriceSpread(MergeableAggregate):
    """Highest less lowest price, and how many; an example of a user's own aggregate."""

    state = "low bigint, high bigint, n bigint"
    result = "spread bigint, bids bigint"

    def add(self, groups):
        return groups["price"].agg(low="min", high="max", n="size")

    def merge(self, groups):
        return groups.agg(low=("low", "min"), high=("high", "max"), n=("n", "sum"))

    def finish(self, states):
        return states.assign(spread=states["high"] - states["low"], bids=states["n"])[["spread", "bids"]]


def price_spread(t: Tables) -> DataFrame:
    windowed = t.bid.select("auction", "price", tumble("date_time", plan.SIZE))
    flat = window_bounds(windowed).select("auction", F.col("window_end"), "price")
    return aggregate_with(flat, ["auction", "window_end"], PriceSpread())


def value_spread(t: Tables) -> DataFrame:
    """The same aggregate over the whole values of a user's events."""
    valued = tables.whole_values(t.events).select("user_id", F.col("value").alias("price"), tumble("ts", "10 hours"))
    return aggregate_with(window_bounds(valued).select("user_id", "window_end", "price"), ["user_id", "window_end"], PriceSpread())


def window_levels(t: Tables) -> DataFrame:
    return process_windows(window_bounds(plan.bid_counts(t.bid)), live.busy_levels, live.SHARE_SCHEMA)


def averages_until(t: Tables, until: F.Column | None = None) -> DataFrame:
    auctions, bids = t.auction, t.bid
    if until is not None:
        auctions, bids = auctions.where(F.col("date_time") < until), bids.where(F.col("date_time") < until)
    return plan.average_price_by_category(auctions, bids)


HALFWAY = "timestamp_ntz'2024-01-01 00:00:06'"


def category_changes(t: Tables) -> DataFrame:
    """Change rows from the averages early in the run to those at its end."""
    changes = changelog(averages_until(t, F.expr(HALFWAY)), averages_until(t), ["category"])
    return changes.select(
        F.coalesce("after.category", "before.category").alias("category"), "op",
        F.col("before.avg_price").alias("before_avg"), F.col("after.avg_price").alias("after_avg"),
        F.col("before.max_date_time").alias("before_time"), F.col("after.max_date_time").alias("after_time"))


def hot_items_text(t: Tables) -> DataFrame:
    """q5 records with window times as text of whole seconds."""
    hot = plan.hot_items(t.bid)
    return json_records(hot.withColumns({c: iso_seconds(F.col(c)) for c in ("window_start", "window_end")}))


def single_highest_text(t: Tables) -> DataFrame:
    """q7 records with the window's end in epoch milliseconds."""
    one = plan.single_highest_bid(t.bid)
    return json_records(one.select("auction", "bidder", "price", epoch_millis(F.col("window_end")).alias("window_end")))


def one_name_text(t: Tables) -> DataFrame:
    """q8 records with the window's end in epoch milliseconds."""
    sellers = plan.new_sellers_one_name(t.person, t.auction)
    return json_records(sellers.withColumn("window_end", epoch_millis(F.col("window_end"))))


def latest_bid(t: Tables) -> DataFrame:
    rows = t.bid.select("auction", "date_time", "bidder", "price")
    return upsert_latest(rows, ["auction"], ["date_time"])


def top_bids(t: Tables) -> DataFrame:
    order = [F.desc("price"), F.asc("date_time"), F.asc("bidder")]
    return top_k_per_group(t.bid.select("auction", "bidder", "price", "date_time"), ["auction"], order, 3)


def distinct_bidders(t: Tables) -> DataFrame:
    return window_bounds(distinct_per_window(t.bid, ["auction", "bidder"], tumble("date_time", plan.SIZE)))


def tumbling_counts(t: Tables) -> DataFrame:
    return window_bounds(window_count(t.bid, ["auction"], tumble("date_time", plan.SIZE), "bid_count"))


BATCH: dict[str, Query] = {
    # derived entities
    "nx_split_counts": batch(lambda t: derive.split_counts(t.numbered)),
    "hash_id": batch(lambda t: t.numbered.select("n", F.expr(hash_id()).alias("hash_id"))),
    "nx_person": batch(lambda t: t.person),
    "nx_auction": batch(lambda t: t.auction),
    "nx_bid": batch(lambda t: t.bid),
    # sources
    "route_events": batch(lambda t: routing.route(mixed_events(t))),
    "source_epoch_ms": batch(lambda t: records.epoch_table(json_text(t.auction, AUCTION, epoch=True), "auction")),
    "source_epoch_ms_grain": batch(lambda t: records.decode(
        json_text(t.bid, BID, epoch=True), "bid", time_encoding="epoch_ms", grain="second")),
    "source_from_timestamp": batch(lambda t: from_time(t.bid, "2024-01-01 00:00:05")),
    "json_decode": batch(lambda t: records.decode(damaged(t.bid, "bid"), "bid", bad_data="drop")),
    "json_decode_fail_mode": batch(lambda t: records.decode(json_text(t.auction, AUCTION), "auction")),
    "json_rejects": batch(lambda t: records.rejects(damaged(t.bid, "bid"), "bid")),
    "json_decode_auction": batch(lambda t: records.decode(damaged(t.auction, "auction"), "auction", bad_data="drop")),
    "json_rejects_auction": batch(lambda t: records.rejects(damaged(t.auction, "auction"), "auction")),
    "json_decode_person": batch(lambda t: records.decode(damaged(t.person, "person"), "person", bad_data="drop")),
    "json_rejects_person": batch(lambda t: records.rejects(damaged(t.person, "person"), "person")),
    "source_epoch_ms_damaged": batch(lambda t: records.epoch_table(
        damaged(t.auction, "epoch auction"), "auction", bad_data="drop")),
    "json_rejects_epoch_ms": batch(lambda t: records.rejects(
        damaged(t.auction, "epoch auction"), "auction", time_encoding="number")),
    # queries
    "q1_currency_conversion": batch(lambda t: plan.currency_conversion(t.bid)),
    "q2_selection": batch(lambda t: plan.selection(t.bid)),
    "q3_local_item_suggestion": batch(lambda t: plan.local_item_suggestion(t.person, t.auction)),
    "q4_bid_in_auction": batch(lambda t: plan.bid_auction_pairs(t.auction, t.bid)),
    "q4_bid_in_open_category": batch(lambda t: plan.bid_in_auction(t.auction, t.bid)),
    "q4_closing_price": batch(lambda t: plan.closing_price(plan.bid_in_auction(t.auction, t.bid))),
    "q4_category_avg": batch(lambda t: plan.average_price_by_category(t.auction, t.bid)),
    "q4_category_avg_second_grain": batch(
        lambda t: plan.average_price_by_category(t.auction, t.bid, grain="second")),
    "q4_changelog": batch(category_changes),
    "q5_bid_counts": batch(lambda t: window_bounds(plan.bid_counts(t.bid))),
    "q5_hot_items": batch(lambda t: plan.hot_items(t.bid)),
    "q6_last10_avg": batch(lambda t: plan.last_bids_average(t.bid)),
    "q7_highest_bid": batch(lambda t: plan.highest_bid(t.bid)),
    "q7_single_highest": batch(lambda t: plan.single_highest_bid(t.bid)),
    "q8_new_sellers": batch(lambda t: plan.new_sellers(t.person, t.auction)),
    "q8_one_name": batch(lambda t: plan.new_sellers_one_name(t.person, t.auction)),
    # operators
    "interval_join": batch(lambda t: plan.auctions_after_registration(t.person, t.auction)),
    "distinct_per_window": batch(distinct_bidders),
    "tumble_count": batch(tumbling_counts),
    "top_k_per_group": batch(top_bids),
    "upsert_latest": batch(latest_bid),
    "window_udaf": batch(price_spread),
    "udf_window_process": batch(window_levels),
    # sinks
    "json_encode": batch(lambda t: json_records(plan.hot_items(t.bid))),
    "json_hot_items_text_times": batch(hot_items_text),
    "json_single_highest": batch(single_highest_text),
    "json_one_name": batch(one_name_text),
    "json_upsert_records": batch(lambda t: keyed_records(
        plan.closing_price(plan.bid_in_auction(t.auction, t.bid)), ["auction", "category"])),
    "json_changelog": batch(lambda t: changelog_records(changelog(
        plan.closing_price(plan.bid_in_auction(t.auction, t.bid.where(F.col("date_time") < F.expr(HALFWAY)))),
        plan.closing_price(plan.bid_in_auction(t.auction, t.bid)), ["auction", "category"]))),
    # the same operators on other tables
    "events_hop_hot_users": batch(lambda t: tables.hot_users(t.events)),
    "events_highest_value": batch(lambda t: tables.highest_value(t.events)),
    "orders_interval_lineitem": batch(lambda t: tables.average_largest_line(t.orders, t.lineitem)),
    "orders_lineitem_pairs": batch(lambda t: tables.shipped_in_time(t.orders, t.lineitem)),
    "customer_last10_orders": batch(lambda t: tables.last_orders(t.orders)),
    "hot_parts_hop": batch(lambda t: tables.hot_parts(t.lineitem)),
    "customer_order_window_join": batch(lambda t: tables.urgent_and_other(t.orders)),
    "events_purchases": batch(lambda t: tables.purchases(t.events)),
    "segment_urgent_orders": batch(lambda t: tables.orders_of_segment(t.orders, t.customer)),
    "events_single_highest": batch(lambda t: window_bounds(tables.highest_event(t.events))),
    "events_last10_value": batch(lambda t: tables.last_values(t.events)),
    "events_active_users": batch(lambda t: tables.active_users(t.events)),
    "events_value_spread": batch(value_spread),
    "events_tumble_count": batch(lambda t: tables.events_per_type(t.events)),
    "events_top_values": batch(lambda t: tables.top_values(t.events)),
    "events_upsert_latest": batch(lambda t: tables.latest_event(t.events)),
    "events_first_type": batch(lambda t: tables.first_types(t.events)),
    "events_json_changelog": batch(lambda t: tables.type_changes(t.events, "2024-01-16")),
    "events_json_records": batch(lambda t: json_records(tables.whole_values(t.events))),
    "events_errors_in_reach": batch(lambda t: tables.errors_in_reach(t.events)),
    "orders_followed_up": batch(lambda t: tables.followed_up(t.orders)),
    "lineitem_selection": batch(lambda t: tables.lines_of_parts(t.lineitem)),
    # measurement
    "topic_offsets": batch(lambda t: progress.topic_offsets(samples.samples(t.events))),
    "topic_throughput": batch(lambda t: samples.throughput(samples.samples(t.events))),
    "query_throughput": batch(lambda t: samples.input_rates(samples.samples(t.events))),
    "sample_stats": batch(lambda t: samples.stats(samples.samples(t.events))),
    "core_seconds": batch(lambda t: samples.core_seconds(samples.samples(t.events))),
    "bench_summary": batch(lambda t: samples.summary(samples.samples(t.events))),
}


# --- streams ---

def late_rows(t: Tables) -> tuple[list[DataFrame], Callable[[DataFrame], DataFrame]]:
    """Events on time, then every tenth event of the first quarter, far too late."""
    numbered = t.numbered
    quarter = numbered.agg((F.max("n") + 1).alias("n")).first()["n"] // 4
    late = (F.col("n") % 10 == 7) & (F.col("n") < quarter)
    return [numbered.where(~late), numbered.where(late)], derive.bid


def halves(t: Tables) -> tuple[list[DataFrame], Callable[[DataFrame], DataFrame]]:
    numbered = t.numbered
    half = numbered.agg((F.max("n") + 1).alias("n")).first()["n"] // 2
    return [numbered.where(F.col("n") < half), numbered.where(F.col("n") >= half)], derive.bid


def in_runs(parts: Callable) -> Callable[[Tables], DataFrame]:
    def run(t: Tables) -> DataFrame:
        return delivery.counted_in_runs(t.spark, *parts(t), plan.SIZE)[0]

    return run


def lagging_auctions(t: Tables) -> DataFrame:
    """Averages where the auctions of each half come a restart after its bids."""
    half = t.numbered.agg((F.max("n") + 1).alias("n")).first()["n"] // 2
    early, late = t.numbered.where(F.col("n") < half), t.numbered.where(F.col("n") >= half)
    return delivery.averages_in_runs(t.spark, [
        (None, derive.bid(early)), (derive.auction(early), derive.bid(late)), (derive.auction(late), None)])


PARTS = 4


def in_order(df: DataFrame, column: str, parts: int = PARTS) -> list[DataFrame]:
    """The rows in ranges of a column, nulls in the first: as they would arrive one after another."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return [df]
    kind, value = df.schema[column].dataType, F.col(column)
    cuts = [F.lit(low + (high - low) * i / parts).cast(kind) for i in range(1, parts)]
    below = [(value < cut) | value.isNull() for cut in cuts[:1]] + [value < cut for cut in cuts[1:]] + [value >= cuts[-1]]
    return [df.where(below[i] if i in (0, parts - 1) else below[i] & (value >= cuts[i - 1])) for i in range(parts)]


def out_of_order(numbered: DataFrame) -> list[DataFrame]:
    """Four parts in which every fifth event comes three parts later than its number says, the last ones first of all."""
    behind = F.col("n") % 5 == 3
    parts = in_order(numbered, "n")
    return [part.where(~behind).unionByName(parts[(i + 1) % len(parts)].where(behind)) for i, part in enumerate(parts)]


def arriving(run: Callable[..., DataFrame], *entities: str, lateness: str = LATENESS,
             order: Callable[[DataFrame], list[DataFrame]] = lambda numbered: in_order(numbered, "n")) -> Query:
    """A streamed query over entities that come in four parts, restarted from its checkpoint for each."""
    def query(t: Tables) -> DataFrame:
        parts = [{e: derive.DERIVATIONS[e](part) for e in entities} for part in order(t.numbered)]
        return delivery.in_parts(t.spark, parts, dict.fromkeys(entities, "date_time"),
                                 lambda streams, root: run(*[streams[e] for e in entities], root=root), lateness)

    return batch(query)


def records_arriving(run: Callable[[DataFrame, str], DataFrame], kind: str, whole: bool = False) -> Query:
    """A streamed query over JSON records, the text alone, that come in four parts; ``run`` decodes them."""
    def query(t: Tables) -> DataFrame:
        entity = kind.removeprefix("epoch ")
        rows = [derive.DERIVATIONS[entity](part) for part in in_order(t.numbered, "n")]
        texts = [json_text(r, SCHEMA_OF[entity], epoch=entity != kind) if whole else damaged(r, kind) for r in rows]
        return delivery.in_parts(t.spark, [{"records": text} for text in texts], {},
                                 lambda streams, root: run(streams["records"], root), LATENESS)

    return batch(query)


def epoch_stream(texts: DataFrame, root: str) -> DataFrame:
    """Epoch-ms JSON as a stream, decoded and appended."""
    decoded = records.decode(texts, "bid", time_encoding="epoch_ms", grain="second")
    return to_files(as_stream(decoded), "epoch", root)


def persons_per_state(texts: DataFrame, root: str) -> DataFrame:
    """ISO JSON as a stream: decoded, bad records dropped, a watermark by its times, counted by window."""
    persons = as_stream(records.decode(texts, "person", bad_data="drop"))
    return to_files(window_bounds(window_count(persons, ["state"], tumble("date_time", plan.SIZE), "persons")), "states", root)


def rejected_stream(texts: DataFrame, root: str) -> DataFrame:
    """Bad records as a stream of their own, each with its reason."""
    return to_files(records.rejects(texts, "auction"), "rejects", root)


def events_arriving(run: Callable[..., DataFrame]) -> Query:
    """The same over the given events."""
    return batch(lambda t: delivery.in_parts(
        t.spark, [{"events": part} for part in in_order(t.events, "ts")], {"events": "ts"},
        lambda streams, root: run(streams["events"], root=root), LATENESS))


def orders_arriving(t: Tables) -> DataFrame:
    return delivery.in_parts(
        t.spark, [{"orders": part} for part in in_order(t.orders, "o_orderdate")], {"orders": "o_orderdate"},
        lambda streams, root: live_tables.orders_of_segment(streams["orders"], t.customer, root), LATENESS)


def shipped_arriving(t: Tables) -> DataFrame:
    """Orders and lines, each in its own order of time."""
    def four(parts: list[DataFrame]) -> list[DataFrame]:
        return parts + [parts[0].where("false")] * (PARTS - len(parts))

    orders, lines = four(in_order(t.orders, "o_orderdate")), four(in_order(t.lineitem, "l_shipdate"))
    return delivery.in_parts(
        t.spark, [{"orders": o, "lineitem": l} for o, l in zip(orders, lines, strict=True)],
        {"orders": "o_orderdate", "lineitem": "l_shipdate"},
        lambda streams, root: live_tables.shipped_in_time(streams["orders"], streams["lineitem"], root), "1 day")


def spread_stream(bids: DataFrame, root: str) -> DataFrame:
    return live.window_aggregate(bids, ["auction"], PriceSpread(), plan.SIZE, root).drop("window_start")


def mixed_texts(numbered: DataFrame) -> DataFrame:
    """All three entities as JSON records, the text alone."""
    texts = [json_text(derive.DERIVATIONS[e](numbered), SCHEMA_OF[e]) for e in ("person", "auction", "bid")]
    return texts[0].unionByName(texts[1]).unionByName(texts[2])


def routed_arriving(t: Tables) -> DataFrame:
    """Topic, key and text of mixed records that come in four parts."""
    return delivery.in_parts(t.spark, [{"records": mixed_texts(part)} for part in in_order(t.numbered, "n")], {},
                             lambda streams, root: live.routed(streams["records"], root), LATENESS)


def new_sellers_of_topics(t: Tables) -> DataFrame:
    """q8 over the topics that a router wrote, both streams going on part by part."""
    def run(streams: dict[str, DataFrame], root: str) -> DataFrame:
        live.routed(streams["records"], f"{root}/routed")
        return live.new_sellers(*[live.topic_stream(t.spark, f"{root}/routed", e) for e in ("person", "auction")], root=f"{root}/q8")

    return delivery.in_parts(t.spark, [{"records": mixed_texts(part)} for part in in_order(t.numbered, "n", 2)], {}, run, LATENESS)


def decoded_arriving(texts: DataFrame, root: str) -> DataFrame:
    return live.decoded_and_rejected(texts, "auction", root)


def after_crashes(t: Tables) -> DataFrame:
    """A file, an upsert and a changelog sink, each crashed between write and commit in both parts of its input."""
    def over(run, lateness: str = LATENESS) -> DataFrame:
        parts = [{e: derive.DERIVATIONS[e](part) for e in ("auction", "bid")} for part in in_order(t.numbered, "n", 2)]
        return delivery.in_parts(t.spark, parts, {"auction": "date_time", "bid": "date_time"}, delivery.with_crashes(t.spark, run), lateness)

    counts = over(lambda s, root: live.bid_counts(s["bid"], root))
    latest = over(lambda s, root: live.latest_bid_totals(s["bid"], root))
    changes = over(lambda s, root: closing.category_changelog(s["auction"], s["bid"], root), closing.LIFE)
    none = F.lit(None)
    return (counts.select(F.lit("file").alias("sink"), F.col("auction").alias("key"), F.col("bid_count").cast("double").alias("a"),
                          none.cast("double").alias("b"), F.col("window_start").alias("at"))
            .unionByName(latest.select(F.lit("upsert").alias("sink"), F.col("auction").alias("key"), F.col("bids").cast("double").alias("a"),
                                       F.col("highest").cast("double").alias("b"), none.cast("timestamp_ntz").alias("at")))
            .unionByName(changes.select(F.lit("changelog").alias("sink"), F.col("category").alias("key"), F.col("avg_price").alias("a"),
                                        none.cast("double").alias("b"), F.col("max_date_time").alias("at"))))


REDELIVERY = "1 day"


def redelivered(t: Tables) -> DataFrame:
    """Events per kind and window where every tenth event comes twice, those shortly before a restart again after it."""
    again, carried = F.col("event_id") % 10 == 7, []
    parts = []
    for part in in_order(t.events, "ts"):
        twice = part.unionByName(part.where(again))
        parts.append({"events": twice.unionByName(carried[-1]) if carried else twice})
        newest = part.agg(F.max("ts")).first()[0]
        carried.append(part.where(again & (F.col("ts") > F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 6 HOURS"))))
    return delivery.in_parts(t.spark, parts, {"events": "ts"}, lambda streams, root: live_tables.events_per_type(
        delivery.once_each(streams["events"], "event_id", "ts"), root), REDELIVERY)


def state_audit(t: Tables) -> DataFrame:
    """How many keys of q8's two windowed aggregates are behind the watermark after a run: none."""
    parts = [{e: derive.DERIVATIONS[e](part) for e in ("person", "auction")} for part in in_order(t.numbered, "n", 2)]

    def run(streams: dict[str, DataFrame], root: str) -> DataFrame:
        live.new_sellers(streams["person"], streams["auction"], root)
        return audit.windows_behind(t.spark, f"{root}/checkpoint")

    return delivery.in_parts(t.spark, parts, dict.fromkeys(parts[0], "date_time"), run, LATENESS).select("operator", "behind")


def measured_offsets(t: Tables) -> DataFrame:
    """How far a running query has read each of three tables at its last sample, and that no sample lies behind an earlier one."""
    topics = {"events": t.events.select("event_id", "event_type"), "orders": t.orders.select("o_orderkey"),
              "lineitem": t.lineitem.select("l_orderkey", "l_linenumber")}
    taken = sampling.table_offsets(t.spark, topics)
    back = taken.throughput().where("events < 0").groupBy("topic").agg(F.count("*").alias("back"))
    last = taken.offsets.groupBy("topic").agg(F.max_by("total_offset", "ts").alias("total_offset"))
    return last.join(back, "topic", "left").select("topic", "total_offset", F.coalesce("back", F.lit(0)).cast("bigint").alias("samples_back"))


STREAMS: dict[str, Query] = {
    "stream_measured_offsets": batch(measured_offsets),
    "stream_route_events": batch(routed_arriving),
    "stream_q8_of_topics": batch(new_sellers_of_topics),
    "stream_json_decode_with_rejects": records_arriving(decoded_arriving, "auction"),
    "stream_restart_after_failure": batch(after_crashes),
    "stream_redelivered_events": batch(redelivered),
    "stream_state_audit": batch(state_audit),
    "stream_source_epoch_ms": records_arriving(epoch_stream, "epoch bid", whole=True),
    "stream_json_persons_per_state": records_arriving(persons_per_state, "person"),
    "stream_json_rejects_auction": records_arriving(rejected_stream, "auction"),
    "stream_q1_currency_conversion": arriving(live.currency_conversion, "bid"),
    "stream_q2_selection": arriving(live.selection, "bid"),
    "stream_q3_local_item_suggestion": arriving(live.local_item_suggestion, "person", "auction"),
    "stream_q4_bid_in_auction": arriving(closing.bid_in_auction, "auction", "bid", lateness=closing.LIFE),
    "stream_q4_closing_price": arriving(closing.closing_price, "auction", "bid", lateness=closing.LIFE),
    "stream_q4_category_avg": arriving(closing.category_average, "auction", "bid", lateness=closing.LIFE),
    "stream_q4_late_bids": arriving(closing.category_average, "auction", "bid", lateness=closing.LIFE, order=out_of_order),
    "stream_q4_lagging_auctions": batch(lagging_auctions),
    "stream_q4_changelog": arriving(closing.category_changelog, "auction", "bid", lateness=closing.LIFE),
    "stream_q5_bid_counts": arriving(live.bid_counts, "bid"),
    "stream_q5_hot_items": arriving(live.hot_items, "bid"),
    "stream_q6_last10_avg": arriving(live.last_bids_average, "bid"),
    "stream_q7_highest_bid": arriving(live.highest_bid, "bid"),
    "stream_q7_single_highest": arriving(live.single_highest_bid, "bid"),
    "stream_q8_new_sellers": arriving(live.new_sellers, "person", "auction"),
    "stream_q8_one_name": arriving(live.new_sellers_one_name, "person", "auction"),
    "stream_interval_join": arriving(live.auctions_after_registration, "person", "auction"),
    "stream_orders_lineitem_pairs": batch(shipped_arriving),
    "stream_distinct_per_window": arriving(live.distinct_bids, "bid"),
    "stream_tumble_count": arriving(live.tumble_count, "bid"),
    "stream_udf_window_process": arriving(live.window_levels, "bid"),
    "stream_upsert_latest": arriving(live.latest_bid_totals, "bid"),
    "stream_window_udaf": arriving(spread_stream, "bid"),
    "stream_events_purchases": events_arriving(live_tables.purchases),
    "stream_segment_urgent_orders": batch(orders_arriving),
    "stream_events_hop_hot_users": events_arriving(live_tables.hot_users),
    "stream_events_tumble_count": events_arriving(live_tables.events_per_type),
    "stream_events_active_users": events_arriving(live_tables.active_users),
    "stream_events_highest_value": events_arriving(live_tables.highest_value),
    "stream_events_single_highest": events_arriving(live_tables.single_highest),
    "stream_events_last10_value": events_arriving(live_tables.last_values),
    "stream_events_value_spread": events_arriving(
        lambda events, root: live_tables.value_spread(events, PriceSpread(), root)),
    "stream_late_data": batch(in_runs(late_rows)),
    "stream_restart": batch(in_runs(halves)),
}

ALL: dict[str, Query] = BATCH | STREAMS
