"""Failures inside a micro-batch, redelivered records, routing and rejects in one pass, what the state store holds."""

import pytest
from conftest import at, rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gavelstream.registry import mixed_texts
from gavelstream.sources import derive
from gavelstream.sources.tables import as_stream, parquet_files
from gavelstream.streaming import audit, carried, delivery
from gavelstream.streaming import auctions as live
from gavelstream.streaming.run import progress_log, start_batches, to_files


def test_a_failure_after_an_upsert_was_written_adds_nothing_twice(spark, tmp_path, bids):
    bids((1, 1, 5, 1), (1, 1, 9, 2), (2, 1, 7, 3)).write.parquet(str(tmp_path / "bid"))
    table = carried.upserts(spark, str(tmp_path / "latest"), "auction bigint, bids bigint", ["auction"])
    failing = []

    def step(batch, batch_id):
        table.add(batch.withColumn(carried.VERSION, F.lit(batch_id).cast("bigint")), batch_id)
        if not failing:
            failing.append(batch_id)
            raise RuntimeError("lost after the write")

    def run():
        counts = parquet_files(spark, "bid", str(tmp_path / "bid"), streaming=True).groupBy("auction").agg(F.count("*").alias("bids"))
        start_batches(counts, step, str(tmp_path / "checkpoint"), "update").awaitTermination()

    with pytest.raises(StreamingQueryException, match="lost after"):
        run()
    run()
    assert failing == [0] and rows(table.read(table.last()).select("auction", "bids")) == [(1, 2), (2, 1)]


def test_a_lost_commit_is_run_again_without_loss_or_repeat(spark, tmp_path, bids):
    for part, runs_again in (((1, 1, 5, 1), (2, 1, 7, 3)), 0), (((3, 1, 8, 5),), 1):
        bids(*part).write.mode("append").parquet(str(tmp_path / "bid"))

        def run():
            return to_files(parquet_files(spark, "bid", str(tmp_path / "bid"), streaming=True).select("auction"), "a", str(tmp_path / "run"))

        run()
        assert delivery.lose_commit(spark, str(tmp_path / "run" / "checkpoint")) == runs_again
        found = run()
    assert rows(found) == [(1,), (2,), (3,)]
    assert delivery.lose_commit(spark, str(tmp_path / "nowhere")) is None


def test_keys_of_redelivered_records_go_with_the_watermark(spark, tmp_path):
    def run(*records):
        made = spark.createDataFrame([(k, at(t)) for k, t in records], "k bigint, date_time timestamp_ntz")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = as_stream(spark.readStream.schema(made.schema).parquet(str(tmp_path / "in")), lateness="10 seconds")
        found = to_files(delivery.once_each(stream, "k", "date_time"), "once", str(tmp_path / "run"))
        return sorted(r["k"] for r in found.collect()), audit.state(spark, str(tmp_path / "run" / "checkpoint"), 0).count()

    assert run((1, 0), (2, 1), (1, 2)) == ([1, 2], 2)
    assert run((2, 4), (3, 5)) == ([1, 2, 3], 3)
    assert run((4, 100)) == ([1, 2, 3, 4], 1)


def test_routed_topics_are_streams_again(spark, tmp_path):
    numbered = derive.numbers(spark, 600)
    mixed_texts(numbered).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    live.routed(source, str(tmp_path / "routed"))
    for entity, make in derive.DERIVATIONS.items():
        found = to_files(live.topic_stream(spark, str(tmp_path / "routed"), entity), entity)
        assert rows(found) == rows(make(numbered)), entity


def test_the_decoded_stream_is_read_once(spark, tmp_path):
    spark.createDataFrame([('{"auction": 1, "bidder": 2, "price": 3, "date_time": "2024-01-01T00:00:01.000"}',), ("broken",), (None,)], "value string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    with progress_log(spark) as log:
        found = live.decoded_and_rejected(source, "bid", str(tmp_path / "run"))
        assert [(r["sink"], r["auction"], r["value"]) for r in found.orderBy("sink", "value").collect()] == [
            ("good", 1, None), ("reject", None, None), ("reject", None, "broken")]
        progress = [p for each in log.rows.values() for p in each]
    assert sum(p["numInputRows"] for p in progress) == 3


def test_state_behind_the_watermark_is_gone_and_partitions_stay(spark, tmp_path, persons, auctions):
    def run(*times):
        persons(*[(i, "n", "or", t) for i, t in enumerate(times)]).write.mode("append").parquet(str(tmp_path / "person"))
        auctions(*[(i, i, 10, t, t + 50) for i, t in enumerate(times)]).write.mode("append").parquet(str(tmp_path / "auction"))
        live.new_sellers(*[parquet_files(spark, n, str(tmp_path / n), streaming=True) for n in ("person", "auction")], root=str(tmp_path / "run"))
        return audit.windows_behind(spark, str(tmp_path / "run" / "checkpoint")).collect()

    assert [(r["keys"], r["behind"]) for r in run(1, 2, 12)] == [(3, 0)] * 2
    # A later session with another number of partitions keeps that of the checkpoint.
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert [(r["keys"], r["behind"]) for r in run(31)] == [(1, 0)] * 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    kept = audit.operators(spark, str(tmp_path / "run" / "checkpoint")).select("numPartitions").distinct().collect()
    assert [r["numPartitions"] for r in kept] == [int(before)]
