"""Hand-made edge cases of the queries."""

from conftest import at, rows
from pyspark.sql import functions as F

from gavelstream.operators.changes import changelog, changelog_records, upsert_latest
from gavelstream.operators.windows import hop, tumble, window_bounds, window_count
from gavelstream.plans import auctions as plan
from gavelstream.schemas import BID


def test_equal_top_counts_are_all_hot(bids):
    df = plan.hot_items(bids((1, 7, 5, 0), (2, 7, 5, 1), (1, 8, 5, 1), (2, 8, 5, 0), (3, 8, 5, 0)))
    first = [r for r in rows(df) if r[3] == at(10)]
    assert [(r[0], r[1]) for r in first] == [(1, 2), (2, 2)]


def test_highest_bids_keep_ties_but_not_copies(bids):
    b = bids((1, 7, 90, 3), (2, 8, 90, 1), (1, 7, 90, 3), (3, 9, 10, 2))
    assert [r[:3] for r in rows(plan.highest_bid(b))] == [(1, 7, 90), (2, 8, 90)]
    assert [r[:3] for r in rows(plan.single_highest_bid(b))] == [(2, 8, 90)]


def test_two_names_of_one_person(persons, auctions):
    p = persons((5, "Ann", "or", 3), (5, "Bob", "or", 2), (5, "Ann", "or", 4))
    a = auctions((1, 5, 10, 9, 100), (2, 5, 11, 9.5, 100), (3, 5, 10, 10, 100))
    assert [r[:3] for r in rows(plan.new_sellers(p, a))] == [(5, "Ann", 5), (5, "Bob", 5)]
    assert rows(plan.new_sellers_one_name(p, a)) == [(5, "Bob", 5, at(10))]


def test_event_on_a_window_edge(bids):
    counts = window_bounds(window_count(bids((1, 1, 1, 10)), ["auction"], tumble("date_time", "10 seconds"), "n"))
    assert rows(counts) == [(1, 1, at(10), at(20))]


def test_five_hopping_windows_per_event(bids):
    counts = window_bounds(window_count(bids((1, 1, 1, 0)), ["auction"],
                                        hop("date_time", "2 seconds", "10 seconds"), "n"))
    assert [r[2] for r in rows(counts)] == [at(s) for s in (-8, -6, -4, -2, 0)]


def test_hop_counts_add_up_to_five_copies(bids):
    b = bids(*[(i % 3, i, i, i * 0.37) for i in range(200)])
    assert plan.bid_counts(b).agg(F.sum("bid_count")).first()[0] == 1000


def test_bids_on_the_edges_of_an_auction(bids, auctions):
    a = auctions((1, 5, 10, 2, 4))
    b = bids((1, 1, 10, 2), (1, 1, 20, 4), (1, 1, 30, 1.999), (1, 1, 40, 4.001))
    assert sorted(r["price"] for r in plan.bid_in_auction(a, b).collect()) == [10, 20]


def test_second_grain_moves_the_edges(bids, auctions):
    a = auctions((1, 5, 10, 2.5, 4.2))
    b = bids((1, 1, 10, 2.1), (1, 1, 20, 4.9), (1, 1, 30, 5.0))
    assert plan.bid_in_auction(a, b).count() == 0
    assert sorted(r["price"] for r in plan.bid_in_auction(a, b, "second").collect()) == [10, 20]


def test_expiry_cuts_and_ids_are_reused(bids, auctions):
    a = auctions((1, 5, 10, 0, 10), (1, 6, 10, 5, 20), (1, 7, 11, 15, 30), (2, 5, 10, 0, 1))
    b = bids((1, 1, 100, 7), (1, 1, 300, 18), (1, 1, 999, 31), (2, 1, 50, 0.5), (2, 1, 77, 2))
    got = {r["category"]: r["avg_price"] for r in plan.average_price_by_category(a, b).collect()}
    assert got == {10: (300 + 50) / 2, 11: 300.0}


def test_bid_joined_once_however_many_auctions_overlap(bids, auctions):
    a = auctions(*[(1, 5, 10, i * 0.001, 100 + i) for i in range(300)])
    assert plan.bid_in_auction(a, bids((1, 1, 5, 50))).count() == 1


def test_local_items_keep_repeated_ids(persons, auctions):
    p = persons((5, "Ann", "or", 0), (5, "Bob", "id", 1), (5, "Cy", "az", 1))
    a = auctions((1, 5, 10, 2, 9), (2, 5, 10, 3, 9), (3, 5, 11, 3, 9))
    assert len(rows(plan.local_item_suggestion(p, a))) == 4


def test_last_bids_only(bids):
    b = bids(*[(1, 7, p, p) for p in range(1, 15)])
    assert rows(plan.last_bids_average(b)) == [(7, sum(range(5, 15)) / 10)]


def test_price_is_converted_as_a_decimal(bids):
    assert plan.currency_conversion(bids((1, 1, 100, 0))).first()["price_euros"] == 89.0


def test_empty_inputs_give_empty_results(spark, persons, auctions, bids):
    p, a, b = persons(), auctions(), bids()
    results = [plan.currency_conversion(b), plan.selection(b), plan.local_item_suggestion(p, a),
               plan.average_price_by_category(a, b), plan.hot_items(b), plan.last_bids_average(b),
               plan.highest_bid(b), plan.single_highest_bid(b), plan.new_sellers(p, a),
               plan.new_sellers_one_name(p, a), plan.auctions_after_registration(p, a)]
    assert [r.count() for r in results] == [0] * len(results)
    assert spark.createDataFrame([], BID).schema == b.schema


def test_changelog_rows(spark):
    before = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 4.0)], "category int, avg double")
    after = spark.createDataFrame([(1, 2.0), (2, 5.0), (4, 1.0)], "category int, avg double")
    changes = changelog(before, after, ["category"])
    assert sorted((r["op"], tuple(r["before"] or ()), tuple(r["after"] or ())) for r in changes.collect()) == [
        ("c", (), (4, 1.0)), ("d", (3, 4.0), ()), ("u", (2, 3.0), (2, 5.0))]
    texts = sorted(r["value"] for r in changelog_records(changes).collect())
    assert texts[0] == '{"before":null,"after":{"category":4,"avg":1.0},"op":"c"}'


def test_latest_version_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "k int, v int, x string")
    assert rows(upsert_latest(df, ["k"], ["v"])) == [(1, 3, "c"), (2, 1, "z")]
