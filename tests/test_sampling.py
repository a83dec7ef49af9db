"""Figures over a measured run: offsets and processor time against the same arithmetic in SQL."""

import json

import duckdb
from conftest import SF_DIR

from gavelstream.registry import Tables
from gavelstream.streaming import sampling


def test_figures_of_a_measured_run_equal_sql(spark):
    t = Tables(spark, SF_DIR)
    taken = sampling.table_offsets(spark, {"events": t.events.select("event_id"), "lineitem": t.lineitem.select("l_orderkey")})
    offsets, usage = (df.toPandas() for df in taken)
    assert dict(offsets.groupby("topic").total_offset.max()) == {"events": t.events.count(), "lineitem": t.lineitem.count()}
    assert offsets.groupby("topic").size().min() >= 3 and (usage.cpu_pct >= 0).all() and usage.cpu_pct.max() > 0
    db = duckdb.connect()
    db.register("offsets", offsets)
    db.register("used", usage)
    rates = db.sql("""SELECT topic, ts, n, s, n / s FROM (SELECT topic, ts, (total_offset - lag(total_offset) OVER w)::bigint AS n,
        date_sub('second', lag(ts) OVER w, ts) AS s FROM offsets WINDOW w AS (PARTITION BY topic ORDER BY ts)) WHERE s IS NOT NULL ORDER BY ALL""").fetchall()
    assert sorted(tuple(r) for r in taken.throughput().collect()) == rates
    assert all(r[3] >= 1 for r in rates)
    cores = db.sql("""SELECT query, count(*), date_sub('second', min(ts), max(ts)) AS e,
        round(sum(cpu_pct) * date_sub('second', min(ts), max(ts)) / (count(*) * 100.0))::bigint FROM used GROUP BY query""").fetchall()
    assert [tuple(r) for r in taken.core_seconds().collect()] == cores
    assert not spark.streams.active


def test_offsets_of_topics_and_of_files():
    topic = {"description": "KafkaV2[Subscribe[bids]]", "numInputRows": 3, "endOffset": json.dumps({"bids": {"0": 7, "1": 5}})}
    files = {"description": "FileStreamSource[file:/x/orders]", "numInputRows": 4, "endOffset": {"logOffset": 0}}
    batches = [{"timestamp": "2024-01-01T00:00:01.000Z", "sources": [topic, files]},
               {"timestamp": "2024-01-01T00:00:01.500Z", "sources": [topic, files]},
               {"timestamp": "2024-01-01T00:00:03.000Z", "sources": [topic, files | {"numInputRows": 0}]}]
    rows = sampling.offset_rows(batches, {"bids": "[bids]", "orders": "/orders]"})
    assert [(r["ts"][-2:], r["total_offset"]) for r in rows if r["topic"] == "bids"] == [("00", 0), ("01", 12), ("03", 12)]
    assert [(r["ts"][-2:], r["total_offset"]) for r in rows if r["topic"] == "orders"] == [("00", 0), ("01", 8), ("03", 8)]


def test_a_run_without_rows(spark):
    taken = sampling.table_offsets(spark, {"events": Tables(spark, SF_DIR).events.where("false").select("event_id")})
    assert taken.throughput().where("events > 0").count() == 0
