"""Streams over several micro-batches, late rows, restarts."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR, at, rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gavelstream.plans import auctions as plan
from gavelstream.operators import joins
from gavelstream.operators.windows import tumble, window_bounds
from gavelstream.registry import PriceSpread, Tables, late_rows
from gavelstream.session import new_path, staging
from gavelstream.sinks import discard, stream_json
from gavelstream.sources import derive
from gavelstream.sources.tables import as_stream, parquet_files, register, table_stream, zone_free
from gavelstream.streaming import auctions as live
from gavelstream.streaming import carried, closing, delivery
from gavelstream.streaming.measure import measured
from gavelstream.streaming.keyed import newest, newest_of_task, reduced_window_process, window_process
from gavelstream.streaming.run import LEAST_STATE, STATE_PER_CORE, dropped_as_late, finish, progress_log, setting, start_batches, start_files, to_files

EVENTS, PARTS = 6000, 4


@pytest.fixture(scope="module")
def entity_files(spark, tmp_path_factory):
    """Each entity in files that follow one another in time."""
    root = tmp_path_factory.mktemp("entities")
    step = EVENTS // PARTS
    for name, make in derive.DERIVATIONS.items():
        for i in range(PARTS):
            part = make(derive.numbers(spark, step, first=i * step)).coalesce(1)
            part.write.mode("append").parquet(f"{root}/{name}")
    return root


@pytest.fixture
def stream(spark, entity_files):
    return lambda name: parquet_files(spark, name, f"{entity_files}/{name}", streaming=True, max_files=1)


@pytest.fixture
def static(spark, entity_files):
    return lambda name: parquet_files(spark, name, f"{entity_files}/{name}")


def closed(df, newest):
    return rows(df.where(F.col("window_end") <= F.lit(newest)))


NEWEST = at(EVENTS / 100 - 0.01 - 5)


def test_hot_items_over_micro_batches(stream, static):
    assert rows(live.hot_items(stream("bid"))) == closed(plan.hot_items(static("bid")), NEWEST)


def test_highest_bid_over_micro_batches(stream, static):
    assert rows(live.highest_bid(stream("bid"))) == closed(plan.highest_bid(static("bid")), NEWEST)


def test_new_sellers_over_micro_batches(stream, static):
    newest = at((EVENTS - 50) / 100 - 5)
    expected = closed(plan.new_sellers(static("person"), static("auction")), newest)
    assert rows(live.new_sellers(stream("person"), stream("auction"))) == expected


def test_last_bids_over_micro_batches(stream, static):
    assert rows(live.last_bids_average(stream("bid"))) == rows(plan.last_bids_average(static("bid")))


def test_local_items_over_micro_batches(stream, static):
    expected = rows(plan.local_item_suggestion(static("person"), static("auction")))
    assert rows(live.local_item_suggestion(stream("person"), stream("auction"))) == expected
    # A limit that is longer than the run changes nothing.
    assert rows(live.local_item_suggestion(stream("person"), stream("auction"), "10 minutes")) == expected


def test_category_averages_over_micro_batches(stream, static, monkeypatch):
    monkeypatch.setattr(carried, "FOLD_EVERY", 2)
    expected = plan.average_price_by_category(static("auction"), static("bid"))
    prices = closing.run(stream("auction"), stream("bid"))
    assert prices.last_batch() >= PARTS - 1
    final = zone_free(prices._read("average", prices.last_batch()))
    assert rows(final) == rows(expected)
    # Replaying the change rows in order gives the same averages.
    state = {}
    for r in prices.all_batches("changes").orderBy("batch_id").collect():
        if r["after"] is None:
            del state[r["before"]["category"]]
        else:
            assert state.get(r["after"]["category"]) == r["before"]
            state[r["after"]["category"]] = r["after"]
    assert {c: v["avg_price"] for c, v in state.items()} == {r["category"]: r["avg_price"] for r in expected.collect()}


def test_bids_meet_each_open_auction_once(stream, static):
    pairs = rows(closing.bid_in_auction(stream("auction"), stream("bid")))
    assert pairs and pairs == rows(plan.bid_auction_pairs(static("auction"), static("bid")))


def joined_in_runs(spark, parts):
    """Averages over (auctions, bids) that come part by part, and how many rows were dropped as late."""
    with progress_log(spark) as log:
        found = rows(delivery.averages_in_runs(spark, parts))
        progress = [p for each in log.rows.values() for p in each]
    return found, dropped_as_late(progress)


def test_late_bids_on_open_auctions_count(spark, auctions, bids):
    """The join has no window, so a bid behind all others meets its auction as long as that is open."""
    day = 86_400
    parts = [(auctions((1, 5, 10, 0, 90_000)), bids((7, 1, 5, 1), (1, 1, 50, 2))),
             (auctions(), bids((1, 1, 60, 90_000), (1, 1, 999, 90_001))),
             (auctions((2, 5, 10, 10, 6 * day)), bids((1, 1, 70, 3), (2, 1, 10, 20))),
             (auctions(), bids((1, 1, 65, 80_000), (2, 1, 30, 5 * day), (2, 1, 20, 11)))]
    assert joined_in_runs(spark, parts) == ([(10, (70 + 30) / 2, at(5 * day))], 0)


def test_auctions_that_lag_behind_their_bids(spark, auctions, bids):
    parts = [(auctions((1, 5, 10, 0, 1000)), bids((1, 1, 50, 1), (1, 1, 60, 100))),
             (auctions((2, 5, 10, 50, 1000)), bids((2, 1, 80, 101))),
             (auctions((9, 5, 11, 1, 90_000)), bids((1, 1, 90, 90)))]
    assert joined_in_runs(spark, parts) == ([(10, (90 + 80) / 2, at(101))], 0)


def test_an_auction_open_too_long_stops_the_query(spark, auctions, bids):
    with pytest.raises(StreamingQueryException, match="open longer"):
        delivery.averages_in_runs(spark, [(auctions((1, 5, 10, 0, 8 * 86_400)), bids((1, 1, 50, 1)))])


def test_last_rows_stay_bounded_over_micro_batches(spark, tmp_path):
    for i in range(50):
        made = spark.createDataFrame([(k, at(100 * i + j), j, 10 * i + j) for k in range(3) for j in range(4)], "bidder bigint, date_time timestamp_ntz, auction bigint, price bigint")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with progress_log(spark) as log, setting(spark, "spark.sql.shuffle.partitions", "1"):
        found = rows(live.last_bids_average(as_stream(source), root=str(tmp_path / "run")))
        progress = [p for each in log.rows.values() for p in each]
    assert len([p for p in progress if p["numInputRows"]]) == 50
    assert found == rows(plan.last_bids_average(spark.read.parquet(str(tmp_path / "in"))))
    held = [op["numRowsTotal"] for p in progress[5:] for op in p["stateOperators"]]
    assert max(held) == held[0]


def test_last_rows_with_a_time_to_live(stream, static):
    order = [("date_time", False), ("auction", True), ("price", True)]
    some = live.last_rows_average(stream("bid").select("bidder", "date_time", "auction", "price"), "bidder", order, "price", 10, ttl="1 hour")
    assert rows(some) == rows(plan.last_bids_average(static("bid")))


def test_newest_rows_order_nulls_as_sql_does(spark):
    import pandas as pd
    frame = pd.DataFrame({"k": [1, 1, 1, 2], "t": [5.0, None, 7.0, None], "v": [1.0, 2.0, None, 4.0]})
    assert newest(frame, "k", [("t", False), ("v", True)], 2).values.tolist()[0][1] == 7.0
    assert newest(frame, "k", [("t", True)], 1)["t"].isna().all()


@pytest.mark.parametrize("watermark, closes", [(14.999, False), (15, True)])
def test_a_window_closes_when_the_watermark_reaches_its_end(spark, tmp_path, bids, watermark, closes):
    bids((1, 1, 5, 3), (1, 1, 9, 4), (2, 2, 2, watermark)).write.parquet(str(tmp_path / "bid"))
    source = lambda: parquet_files(spark, "bid", str(tmp_path / "bid"), streaming=True)
    assert rows(live.window_aggregate(source(), ["auction"], PriceSpread(), "10 seconds")) == (
        [(1, at(0), at(10), 4, 2)] if closes else [])


def test_a_process_function_sees_window_and_elements(spark, tmp_path, bids):
    def sums(key, start, end, elements):
        import pandas as pd
        prices = pd.concat(list(elements))["price"].tolist()
        if len(prices) > 1:
            yield pd.DataFrame({"auction": [key[0]] * 2, "line": [f"{start:%S}-{end:%S}", str(sorted(prices))]})

    bids(*[(1, 1, p, p) for p in range(9)], (2, 1, 5, 1), (3, 1, 1, 30), (1, 1, 7, 11), (1, 1, 8, 12)).write.parquet(str(tmp_path / "bid"))
    windowed = window_bounds(parquet_files(spark, "bid", str(tmp_path / "bid"), streaming=True).select("auction", "price", tumble("date_time", "10 seconds")))
    found = rows(to_files(window_process(windowed, ["auction"], "price bigint", sums, "auction bigint, line string"), "sums"))
    assert found == sorted([(1, "00-10"), (1, str(list(range(9)))), (1, "10-20"), (1, "[7, 8]")])


def test_best_rows_are_one_plan(stream):
    """No micro-batch function: two aggregations and a join keep state in one query."""
    counts = live.best_in_one_plan(lambda: plan.bid_counts(stream("bid")), "bid_count")
    assert counts.isStreaming
    query = counts.writeStream.format("noop").option("checkpointLocation", new_path(counts.sparkSession, "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    names = sorted(op["operatorName"] for op in query.lastProgress["stateOperators"])
    assert names == ["stateStoreSave"] * 3 + ["symmetricHashJoin"]


def test_progress_beyond_what_a_query_keeps(spark, tmp_path):
    spark.range(12).repartition(12).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        rows_ = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        progress = finish(spark, lambda: start_files(rows_, str(tmp_path / "out"), str(tmp_path / "checkpoint")))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert len({p["batchId"] for p in progress if p["numInputRows"]}) >= 10
    assert sum(p["numInputRows"] for p in progress) == 12


def test_late_rows_are_dropped_and_counted(spark):
    parts, to_rows = late_rows(Tables(spark, "/root/testdata/sf0.01"))
    counts, progress = delivery.counted_in_runs(spark, parts, to_rows, plan.SIZE)
    assert counts.agg(F.sum("events")).first()[0] < 9200
    assert dropped_as_late(progress) > 0


def test_two_runs_equal_one(spark):
    numbered = Tables(spark, "/root/testdata/sf0.01").numbered
    parts = [numbered.where(F.col("n") < 6000), numbered.where(F.col("n") >= 6000)]
    twice, _ = delivery.counted_in_runs(spark, parts, derive.bid, plan.SIZE)
    once, _ = delivery.counted_in_runs(spark, [numbered], derive.bid, plan.SIZE)
    assert rows(twice) == rows(once) and len(rows(once)) == 9


def test_json_sink_and_measuring(spark, tmp_path, stream, static):
    df = zone_free(plan.currency_conversion(stream("bid")))
    stream_json(df, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.text(str(tmp_path / "out")).count() == static("bid").count()
    query = discard(plan.selection(stream("bid"))).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == static("bid").count()


def test_stream_of_no_rows(spark, tmp_path, bids):
    bids().write.parquet(str(tmp_path / "none"))
    none = parquet_files(spark, "bid", str(tmp_path / "none"), streaming=True)
    assert live.hot_items(none).count() == 0
    assert live.currency_conversion(none).count() == 0


def test_given_tables_are_read_as_streams(spark):
    assert as_stream(Tables(spark, SF_DIR).bid).schema["date_time"].dataType.typeName() == "timestamp"
    events = table_stream(spark, SF_DIR, "events")
    assert events.isStreaming and to_files(events.select("event_id"), "events").count() == Tables(spark, SF_DIR).events.count()


def test_progress_is_measured_and_the_query_stopped(spark, stream, static):
    progress = measured(plan.selection(stream("bid")), "measured", warmup=0, seconds=4, every="200 milliseconds")
    assert progress.agg(F.sum("input_rows")).first()[0] == static("bid").count()
    assert progress.columns == ["query", "batch_id", "ts", "input_rows", "input_rows_per_sec",
                                "processed_rows_per_sec"]
    assert not spark.streams.active


def test_sql_over_registered_streams_and_tables(spark, static, stream):
    register(bid=static("bid"), live_bid=stream("bid"))
    sql = "SELECT auction, price, date_time FROM {} WHERE auction IN (1007, 1020, 2001, 2019, 2087)"
    assert rows(spark.sql(sql.format("bid"))) == rows(plan.selection(static("bid")))
    assert rows(to_files(spark.sql(sql.format("live_bid")), "sql")) == rows(plan.selection(static("bid")))


def test_windows_are_merged_and_finished_many_at_once(spark, tmp_path, bids):
    class Together(PriceSpread):
        """How many windows are finished in one call, instead of the bids."""

        def finish(self, states):
            return PriceSpread.finish(self, states).assign(bids=len(states))

    for i in range(3):
        bids(*[(k, 1, 10 * i + k % 7, 1 + i) for k in range(200)], (None, 1, i, 2)).write.mode("append").parquet(str(tmp_path / "bid"))
    bids((1, 1, 1, 40)).write.mode("append").parquet(str(tmp_path / "bid"))
    source = lambda: parquet_files(spark, "bid", str(tmp_path / "bid"), streaming=True, max_files=5)
    with setting(spark, "spark.sql.shuffle.partitions", "2"):
        found = live.window_aggregate(source(), ["auction"], Together(), "10 seconds").collect()
        assert {r["auction"]: r["spread"] for r in found} == {k: 20 for k in range(200)} | {None: 2}
        assert min(r["bids"] for r in found) > 50
        counted = live.window_aggregate(source(), ["auction"], PriceSpread(), "10 seconds").collect()
    assert {r["bids"] for r in counted} == {3}


def test_reduced_elements_of_many_windows_go_to_a_function_at_once(spark, tmp_path, bids):
    def sizes(parts):
        whole = parts.groupby(["auction", "window_start", "window_end"], as_index=False, dropna=False).agg(bids=("bids", "sum"))
        return whole.assign(frame=len(whole))

    for i in range(3):
        bids(*[(k, 1, 1, 1 + i) for k in range(200)], (None, 1, i, 2)).write.mode("append").parquet(str(tmp_path / "bid"))
    bids((1, 1, 1, 40)).write.mode("append").parquet(str(tmp_path / "bid"))
    windowed = window_bounds(parquet_files(spark, "bid", str(tmp_path / "bid"), streaming=True).select("auction", tumble("date_time", "10 seconds")))
    with setting(spark, "spark.sql.shuffle.partitions", "2"), setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "70"):
        made = reduced_window_process(windowed, ["auction"], "bids bigint", live.counted, sizes,
                                      "auction bigint, window_start timestamp, window_end timestamp, bids bigint, frame bigint")
        found = to_files(made, "sizes").collect()
    # A null auction is no element of the partial counts, as before; no window is cut by a frame.
    assert sorted((r["auction"], r["bids"]) for r in found) == [(k, 3) for k in range(200)]
    assert {(r["window_start"], r["window_end"]) for r in found} == {(at(0), at(10))} and max(r["frame"] for r in found) > 20


def test_a_task_passes_on_few_rows_of_a_key_from_many_batches():
    import pandas as pd
    order = [("t", False), ("v", True)]
    batches = [pd.DataFrame({"k": [1, 2, None] * 10, "t": [(7 * i + j) % 40 for j in range(30)], "v": [i] * 30}) for i in range(30)]
    batches[3].loc[::4, "t"] = None
    made = list(newest_of_task(iter(batches), "k", order, 4))
    assert len(made) == 1 and len(made[0]) == 12
    whole = pd.concat(batches).sort_values(["t", "v"], ascending=[False, True], na_position="last")
    for k, some in whole.groupby("k", dropna=False):
        mine = made[0][made[0]["k"].isna() if k != k else made[0]["k"] == k]
        assert mine[["t", "v"]].values.tolist() == some.head(4)[["t", "v"]].values.tolist()


def test_a_bid_meets_overlapping_auctions_of_a_category_once(spark, tmp_path, auctions, bids):
    day = 86_400
    many = [(1, 5, 10, i, i + 2 * day) for i in range(50)] + [(1, 5, 11, 5 * day, 6 * day), (1, 5, None, 30, 20), (1, 5, None, 40, 60), (1, 5, None, 50, 55), (1, 5, None, 70, 80)]
    auctions(*many).repartition(5).write.parquet(str(tmp_path / "auction"))
    made = [(1, 1, 9, 25), (1, 1, 8, 49 + 2 * day), (1, 1, 7, 50 + 2 * day), (1, 1, 6, 65), (1, 1, 5, 70), (1, 1, 4, 60), (2, 1, 3, 25), (1, 1, 2, 5 * day)]
    bids(*made).write.parquet(str(tmp_path / "bid"))
    streams = [parquet_files(spark, e, str(tmp_path / e), streaming=True, lateness=closing.LIFE) for e in ("auction", "bid")]
    found = to_files(closing.bids_while_open(*streams), "open").select("category", "price").collect()
    assert sorted(tuple(r) for r in found if r["category"]) == [(10, 4), (10, 5), (10, 6), (10, 8), (10, 9), (11, 2)]
    assert sorted(r["price"] for r in found if r["category"] is None) == [4, 5]


def test_pairs_need_few_rows_of_state(spark, auctions, bids):
    """200 auctions and 300 bids of an id are 60,000 pairs, but few rows for the state store to give out."""
    made = auctions(*[(1, 5, 10 + i % 3, i / 10, 5000) for i in range(200)])
    offered = bids(*[(1, 1, i, 100 + i) for i in range(300)], (2, 1, 5, 7))
    with staging(spark), progress_log(spark) as log:
        parts = [{"auction": made, "bid": offered}]
        found = delivery.in_parts(spark, parts, {"auction": "date_time", "bid": "date_time"},
                                  lambda s, root: closing.bid_in_auction(s["auction"], s["bid"], root), closing.LIFE)
        assert rows(found) == rows(plan.bid_auction_pairs(made, offered))
        assert found.count() == 60_000
        states = [op["numRowsTotal"] for each in log.rows.values() for p in each for op in p["stateOperators"]]
    assert max(states) < 60


def test_pairs_of_auctions_in_full_lists(spark, auctions, bids, monkeypatch):
    monkeypatch.setattr(joins, "LISTED", 3)
    monkeypatch.setattr(joins, "HELD_ROWS", 5)
    made = auctions(*[(i % 2, 5, None if i == 4 else i % 3, i, 20 + 90_000 * (i % 4)) for i in range(30)], (None, 5, 1, 2, 9), (1, 5, 1, 9, 2))
    offered = bids(*[(i % 3, 1, i, 11 + 3_000 * i) for i in range(30)], (None, 1, 5, 7), (1, 1, None, 18), (1, 1, None, 18))
    register(made=made, offered=offered)
    expected = rows_with_nulls(spark.sql(
        "SELECT b.auction, b.price, b.date_time, a.category FROM made a JOIN offered b ON a.id = b.auction AND b.date_time BETWEEN a.date_time AND a.expires"))
    assert len(expected) > 50 and rows_with_nulls(plan.bid_auction_pairs(made, offered)) == expected


def rows_with_nulls(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_written_pairs_grow_like_bids(spark, auctions, bids, tmp_path):
    """Pairs of a bid come together, by category; so written in columns they take no more room than the bids."""
    made = auctions(*[(1, 5, 10 + i % 5, i / 10, 90_000) for i in range(900)])
    offered = bids(*[(1, 1, i * 7919 % 1000, 100 + i * 11.317) for i in range(1500)])
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan.bid_auction_pairs(made, offered).write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1_350_000
    assert sum(f.stat().st_size for f in files) < 200_000


def test_state_partitions_go_by_the_cores_and_not_by_the_shuffles(spark, bids, tmp_path):
    bids(*[(i, 1, 100, i) for i in range(40)]).write.parquet(str(tmp_path / "in"))
    source = parquet_files(spark, "bid", str(tmp_path / "in"), streaming=True)
    most, key, inside = max(LEAST_STATE, STATE_PER_CORE * spark.sparkContext.defaultParallelism), "spark.sql.shuffle.partitions", []

    def state(start):
        return {op["numShufflePartitions"] for p in finish(spark, start) for op in p["stateOperators"]}

    def each(batch, batch_id):
        inside.append((batch.sparkSession.conf.get(key), batch.count()))

    with setting(spark, key, str(most + 40)):
        assert state(lambda: start_files(window_bounds(plan.bid_counts(source)), str(tmp_path / "out"), str(tmp_path / "files"))) == {most}
        totals = source.groupBy("auction").agg(F.max("price").alias("highest"))
        assert state(lambda: start_batches(totals, each, str(tmp_path / "batches"), "update")) == {most}
        assert spark.conf.get(key) == str(most + 40)
    assert {k for k, _ in inside} == {str(most + 40)} and sum(n for _, n in inside) == 40
    # A further run keeps the number of the first; fewer asked for are as many.
    with setting(spark, key, "3"):
        bids((99, 1, 100, 400)).write.mode("append").parquet(str(tmp_path / "in"))
        assert state(lambda: start_files(window_bounds(plan.bid_counts(source)), str(tmp_path / "out"), str(tmp_path / "files"))) == {most}
        assert state(lambda: start_files(window_bounds(plan.bid_counts(source)), str(tmp_path / "out3"), str(tmp_path / "few"))) == {3}


def test_pairs_are_appended_as_counts(spark, auctions, bids, tmp_path):
    """200 auctions in 3 categories and 300 bids of an id are 60,000 pairs, appended as 900 rows with a number."""
    made = auctions(*[(1, 5, None if i % 3 else 10 + i % 2, i / 10, 5000) for i in range(200)])
    offered = bids(*[(1, 1, i, 100 + i) for i in range(300)])
    for name, df in (("auction", made), ("bid", offered)):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    streams = [parquet_files(spark, e, str(tmp_path / e), streaming=True, lateness=closing.LIFE) for e in ("auction", "bid")]
    found = closing.bid_in_auction(*streams, root=str(tmp_path / "run"))
    appended = spark.read.parquet(str(tmp_path / "run" / "out"))
    assert appended.count() == 900 and appended.agg(F.sum("pairs")).first()[0] == 60_000
    assert found.columns == ["auction", "price", "date_time", "category"]
    assert rows_with_nulls(found) == rows_with_nulls(plan.bid_auction_pairs(made, offered))
    # What an earlier version appended pair by pair counts once.
    appended.select("auction", "price", "date_time", F.lit(77).cast("bigint").alias("category")).write.mode("append").parquet(str(tmp_path / "run" / "earlier"))
    old = spark.read.schema(appended.schema).parquet(str(tmp_path / "run" / "earlier"))
    assert closing.each_pair(old).where("category = 77").count() == 900


@pytest.mark.parametrize(("lists", "cells"), [(256, 1 << 18), (2, 1), (1, 40), (7, 1000)])
def test_open_auctions_are_counted_at_each_bid(monkeypatch, lists, cells):
    """As by comparing each bid with each auction, however the lists are cut up."""
    monkeypatch.setattr(closing, "HELD_LISTS", lists)
    monkeypatch.setattr(closing, "HELD_CELLS", cells)
    made, time = np.random.default_rng(7), pa.timestamp("us", tz="UTC")
    met = []
    for i in range(40):
        begin = int(made.integers(-(10**15), 10**17))  # lists far apart in time
        offered = sorted((begin + int(made.integers(0, 30)), int(made.integers(0, 4))) for _ in range(made.integers(1, 20)))
        opened = [(None if c == 3 else int(c), begin + int(a), begin + int(a + d)) for c, a, d in zip(
            np.sort(made.integers(i % 4, 4, 12)), made.integers(-40, 50, 12), made.integers(0, 40, 12), strict=True)]
        met.append((i % 5, offered, opened))
    whole = pa.RecordBatch.from_arrays([
        pa.array([m[0] for m in met], pa.int64()),
        pa.array([[{"date_time": t, "price": p or None} for t, p in m[1]] for m in met], pa.list_(pa.struct({"date_time": time, "price": pa.int64()}))),
        pa.array([[{"category": c, "_opened": a, "_until": b} for c, a, b in m[2]] for m in met],
                 pa.list_(pa.struct({"category": pa.int64(), "_opened": time, "_until": time})))], names=["auction", "_bids", "_auctions"])
    found = []
    for batch in closing._counted(iter([whole.slice(0, 13), whole.slice(13)])):
        columns = [batch["auction"], batch["price"], batch["date_time"].cast(pa.int64()), batch["category"], batch["pairs"]]
        for auction, price, t, category, pairs in zip(*(c.to_pylist() for c in columns), strict=True):
            assert pairs > 0
            found += [(auction, price, t, category)] * pairs
    expected = [(i, p or None, t, c) for i, offered, opened in met for t, p in offered for c, a, b in opened if a <= t <= b]
    assert len(expected) > 500 and sorted(found, key=repr) == sorted(expected, key=repr)
