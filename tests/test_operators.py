"""Operators against brute force on small random data."""

import os
import random
from datetime import timedelta

import pytest
from conftest import T0, at, rows
from pyspark.sql import functions as F

from gavelstream import session
from gavelstream.operators import aggregates, progress, ranking
from gavelstream.operators.joins import between_join, inside_intervals, interval_join, merged_intervals
from gavelstream.plans import auctions as plan
from gavelstream.registry import PriceSpread
from gavelstream.session import shared_dir, staging

HOUR = timedelta(hours=1)


def random_intervals(seed, count, span_hours, longest_hours):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        start = T0 + HOUR * rng.randint(0, span_hours)
        out.append((rng.randint(1, 3), rng.randint(10, 11), start, start + HOUR * rng.randint(0, longest_hours)))
    return out


@pytest.mark.parametrize("seed,longest", [(1, 3), (2, 30), (3, 100), (4, 0)])
def test_merged_intervals_cover_the_same_points(spark, seed, longest):
    intervals = random_intervals(seed, 40, 200, longest)
    df = spark.createDataFrame(intervals, "id bigint, category bigint, s timestamp_ntz, e timestamp_ntz")
    merged = merged_intervals(df, ["id", "category"], "s", "e")
    pieces = merged.collect()
    half = HOUR / 2
    points = [T0 + half * i for i in range(-4, 700)]
    for key in {(i, c) for i, c, _, _ in intervals}:
        mine = [(p["s"], p["e"]) for p in pieces if (p["id"], p["category"]) == key]
        theirs = [(s, e) for i, c, s, e in intervals if (i, c) == key]
        for t in points:
            inside = sum(s <= t <= e for s, e in mine)
            assert inside == any(s <= t <= e for s, e in theirs)

    times = spark.createDataFrame([(i, t) for i in (1, 2, 3, 4) for t in points], "k bigint, t timestamp_ntz")
    found = rows(inside_intervals(times, merged, {"k": "id"}, "t", "s", "e"))
    expected = sorted((i, t, c) for i in (1, 2, 3) for t in points for c in (10, 11)
                      if any((i, c) == (x, y) and s <= t <= e for x, y, s, e in intervals))
    assert found == expected


def test_shuffled_join_gives_the_same_as_a_broadcast(spark, monkeypatch):
    intervals = random_intervals(5, 60, 100, 20)
    df = spark.createDataFrame(intervals, "id bigint, category bigint, s timestamp_ntz, e timestamp_ntz")
    times = spark.createDataFrame([(i, T0 + HOUR * h) for i in (1, 2, 3) for h in range(130)],
                                  "k bigint, t timestamp_ntz")
    merged = merged_intervals(df, ["id", "category"], "s", "e").persist()
    small = rows(inside_intervals(times, merged, {"k": "id"}, "t", "s", "e"))
    monkeypatch.setattr(session.small_side, "__defaults__", (0,))
    assert rows(inside_intervals(times, merged, {"k": "id"}, "t", "s", "e")) == small


@pytest.mark.parametrize("lower,upper", [(0, 10), (-7, 3), (0, 0), (2, 5)])
def test_interval_join_with_and_without_slots(spark, lower, upper):
    rng = random.Random(lower * 31 + upper)
    left = [(rng.randint(1, 3), at(rng.randint(0, 60))) for _ in range(60)]
    right = [(rng.randint(1, 3), at(rng.randint(0, 60))) for _ in range(60)]
    a = spark.createDataFrame(left, "k bigint, t timestamp_ntz")
    b = spark.createDataFrame(right, "k2 bigint, t2 timestamp_ntz")
    expected = sorted((k, t, k2, t2) for k, t in left for k2, t2 in right
                      if k == k2 and t + timedelta(seconds=lower) <= t2 <= t + timedelta(seconds=upper))
    bounds = (f"{lower} seconds", f"{upper} seconds")
    assert rows(interval_join(a, b, {"k": "k2"}, "t", "t2", *bounds)) == expected
    assert rows(interval_join(a, b, {"k": "k2"}, "t", "t2", *bounds, slot="10 seconds")) == expected


def test_ranked_with_ties_is_rank(spark):
    rng = random.Random(8)
    data = [(rng.randint(0, 4), rng.randint(0, 6), i) for i in range(200)]
    df = spark.createDataFrame(data, "g int, m int, i int")
    for k in (1, 3, 30):
        expected = sorted(r for r in data if 1 + sum(x[0] == r[0] and x[1] > r[1] for x in data) <= k)
        assert rows(ranking.ranked_with_ties(df, ["g"], "m", k)) == expected


def test_large_k_is_cut_in_two_rounds(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    top = ranking.top_k_per_group(df, ["g"], [F.desc("id")], 1500)
    assert rows(top) == sorted((i % 2, i) for i in range(2000, 5000))


def test_user_aggregate_folds_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "HELD_STATES", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 3000, 1, 5).select((F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50)).alias("k"),
                                               (F.col("id") * 37 % 1009).alias("price"))
        got = rows(aggregates.aggregate_with(df, ["k"], PriceSpread()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    expected = rows(df.groupBy("k").agg((F.max("price") - F.min("price")), F.count("*")))
    assert got == expected


def test_statistics_of_no_samples_are_zero(spark):
    none = spark.createDataFrame([], "events bigint")
    assert tuple(progress.sample_stats(none, "events").first()) == (0, 0.0, 0, 0, 0.0)
    some = spark.createDataFrame([(2,), (4,), (4,), (4,), (5,), (5,), (7,), (9,)], "events bigint")
    assert tuple(progress.sample_stats(some, "events").first()) == (8, 5.0, 2, 9, 2.0)


def test_core_seconds(spark):
    samples = spark.createDataFrame([(at(0), 1, 50), (at(0), 2, 70), (at(5), 1, 90), (at(5), 2, 30),
                                     (at(10), 1, 60), (at(10), 2, 60)],
                                    "ts timestamp_ntz, worker bigint, cpu_pct bigint")
    assert progress.core_seconds(samples).first()["core_seconds"] == 12


def test_throughput_is_the_offset_difference(spark):
    offsets = spark.createDataFrame([("a", at(0), 100), ("a", at(10), 300), ("a", at(30), 300)],
                                    "topic string, ts timestamp_ntz, total_offset bigint")
    assert [r["events_per_sec"] for r in progress.topic_throughput(offsets).orderBy("ts").collect()] == [20.0, 0.0]


@pytest.mark.parametrize("at_most", [None, "90 minutes"])
def test_between_join_with_and_without_slots(spark, at_most):
    draw = random.Random(5)
    left = [(i, draw.randrange(3), at(s := draw.randrange(40_000)), at(s + draw.randrange(-500, 20_000))) for i in range(150)]
    left += [(900, 1, None, at(9)), (901, 1, at(9), None), (902, None, at(0), at(40_000))]
    right = [(i, draw.randrange(3), at(draw.randrange(50_000))) for i in range(300)] + [(901, 1, None), (902, None, at(5))]
    a = spark.createDataFrame(left, "i int, k int, start timestamp_ntz, end timestamp_ntz")
    b = spark.createDataFrame(right, "j int, m int, t timestamp_ntz")
    plain, slotted = (between_join(a, b, {"k": "m"}, "start", "end", "t", at_most, slot) for slot in (None, "1 hour"))
    assert slotted.columns == plain.columns
    assert rows(slotted) == rows(plain) and plain.count() > 1000


def test_staged_tables_go_with_their_scope(spark, bids, auctions):
    """The shared folder is as before once the results of q4, q5 and q7 are read."""
    a = auctions((1, 5, 10, 0, 50), (2, 5, 11, 5, 60))
    b = bids(*[(1 + i % 2, i % 5, 10 * i, i) for i in range(40)])
    before = set(os.listdir(shared_dir(spark)))
    with staging(spark):
        with staging(spark):
            inner = plan.hot_items(b).count()
        between = set(os.listdir(shared_dir(spark)))
        results = [plan.average_price_by_category(a, b), plan.hot_items(b), plan.highest_bid(b)]
        counts = [len(r.collect()) for r in results]
        assert len(os.listdir(shared_dir(spark))) > len(before)
    assert inner == counts[1] and all(counts)
    assert between == before == set(os.listdir(shared_dir(spark)))
