"""Carried tables: what is folded is deleted, late windows are counted, broadcasts go by bytes."""

import os

from conftest import at, rows
from pyspark.sql import functions as F

from gavelstream import session
from gavelstream.registry import PriceSpread, in_order
from gavelstream.sources.tables import parquet_files
from gavelstream.streaming import auctions as live
from gavelstream.streaming import closing
from gavelstream.streaming.carried import VERSION, upserts
from gavelstream.streaming.run import dropped_as_late, progress_log


def test_an_upsert_folder_does_not_grow_with_micro_batches(spark, tmp_path):
    table = upserts(spark, str(tmp_path), "k bigint, v bigint", ["k"])
    table.every = 3
    sizes = []
    for b in range(10):
        batch = spark.createDataFrame([(b % 2, b), (7, b)], "k bigint, v bigint")
        table.add(batch.withColumn(VERSION, F.lit(b).cast("bigint")), b)
        sizes.append(sum(len(os.listdir(tmp_path / t)) for t in ("whole", "added")))
        # A repeated micro-batch changes nothing.
        table.add(batch.withColumn(VERSION, F.lit(b).cast("bigint")), b)
        latest = {b % 2: b, 7: b} | ({(b - 1) % 2: b - 1} if b else {})
        assert {r["k"]: r["v"] for r in table.read(b).collect()} == latest
    assert max(sizes) <= 9 and sizes[-1] <= sizes[3]
    assert table.last() == 9
    assert rows(table.read(9, only=spark.createDataFrame([(7,)], "k bigint")).select("k", "v")) == [(7, 9)]


def test_user_aggregate_over_runs_drops_closed_windows(spark, tmp_path, bids):
    def run(made):
        made.write.mode("append").parquet(str(tmp_path / "bid"))
        stream = parquet_files(spark, "bid", str(tmp_path / "bid"), streaming=True)
        return live.window_aggregate(stream, ["auction"], PriceSpread(), "10 seconds", str(tmp_path / "run"))

    assert rows(run(bids((1, 1, 50, 1), (1, 1, 70, 2), (2, 1, 5, 9)))) == []
    assert rows(run(bids((1, 1, 20, 8), (1, 1, 9, 12)))) == []
    # 16 s closes the first window; what comes for it afterwards is dropped and counted by Spark.
    first = [(1, at(0), at(10), 50, 3), (2, at(0), at(10), 0, 1)]
    assert rows(run(bids((1, 1, 9, 16)))) == first
    with progress_log(spark) as log:
        assert rows(run(bids((1, 1, 999, 3), (1, 1, 8, 30)))) == [first[0], (1, at(10), at(20), 0, 2), first[1]]
        progress = [p for each in log.rows.values() for p in each]
    assert dropped_as_late(progress) == 1


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    wide = spark.range(10).select("id", F.expr("repeat('x', 1000)").alias("t"), F.array("id").alias("a"))
    assert "broadcast" in session.small_side(wide)._jdf.queryExecution().toString().lower()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 5000)
    assert "broadcast" not in session.small_side(wide)._jdf.queryExecution().toString().lower()


def test_parts_in_order_hold_every_row_once(spark):
    df = spark.createDataFrame([(None,), (1,), (1,), (5,), (9,)], "n bigint")
    parts = in_order(df, "n")
    assert [rows(p.where("n IS NOT NULL")) for p in parts] == [[(1,), (1,)], [], [(5,)], [(9,)]]
    assert sum(p.count() for p in parts) == 5
    assert len(in_order(df.where("n > 9"), "n")) == 1


def test_micro_batches_leave_only_what_they_carry(spark, tmp_path, bids, auctions):
    auctions((1, 5, 10, 0, 50), (2, 5, 11, 5, 60)).write.parquet(str(tmp_path / "auction"))
    bids(*[(1 + i % 2, i % 5, 10 * i, i) for i in range(40)]).write.parquet(str(tmp_path / "bid"))
    before = set(os.listdir(session.shared_dir(spark)))
    streams = [parquet_files(spark, e, str(tmp_path / e), streaming=True) for e in ("auction", "bid")]
    assert len(rows(closing.category_average(*streams, root=str(tmp_path / "run")))) == 2
    assert set(os.listdir(session.shared_dir(spark))) == before
