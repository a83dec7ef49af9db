"""Decoding, bad records, routing, start positions, sinks."""

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from gavelstream.registry import json_text
from gavelstream.schemas import AUCTION, BID
from gavelstream.sinks import json_records, save_json
from gavelstream.sources import derive, records, routing, tables

GOOD = '{"auction":1,"bidder":2,"price":3,"channel":"c","url":"u","date_time":"2024-01-01T00:00:01.040","extra":"x"}'


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


BAD = {
    "junk": "not an object",
    "": "not an object",
    "[1]": "not an object",
    GOOD.replace('"auction":1', '"auction":12.5'): "not a whole number",
    GOOD.replace('"price":3', '"price":"many"'): "not a whole number",
    GOOD.replace('"2024-01-01T00:00:01.040"', "null"): "no event time",
    GOOD.replace('"2024-01-01T00:00:01.040"', '"soon"'): "no event time",
    "{}": "no event time",
}


def test_drop_mode_keeps_good_and_lists_bad(spark):
    loose = [GOOD, GOOD.replace('"auction":1', '"auction":1345.0'), GOOD.replace("{", '{"unknown":[1],', 1),
             GOOD.replace('"channel":"c",', "")]
    df = texts(spark, *loose, *BAD)
    kept = records.decode(df, "bid", bad_data="drop")
    assert kept.schema == BID
    assert sorted(r["auction"] for r in kept.collect()) == [1, 1, 1, 1345]
    assert [r["channel"] for r in kept.collect()].count(None) == 1
    assert {r["value"]: r["reject_reason"] for r in records.rejects(df, "bid").collect()} == BAD


@pytest.mark.parametrize("bad", list(BAD))
def test_fail_mode_stops(spark, bad):
    assert records.decode(texts(spark, GOOD), "bid").count() == 1
    with pytest.raises(Exception, match="bad bid record"):
        records.decode(texts(spark, GOOD, bad), "bid").collect()


def test_strict_ids_refuse_float_text(spark):
    df = texts(spark, GOOD.replace('"auction":1', '"auction":1345.0'))
    assert records.decode(df, "bid", bad_data="drop").count() == 1
    assert records.decode(df, "bid", bad_data="drop", lenient_ids=False).count() == 0


def test_large_ids_stay_exact(spark):
    df = texts(spark, GOOD.replace('"auction":1', '"auction":9007199254740993'))
    assert records.decode(df, "bid").first()["auction"] == 9007199254740993


def test_both_time_encodings_give_one_table(spark):
    auctions = derive.auction(derive.numbers(spark, 500))
    iso = records.decode(json_text(auctions, AUCTION), "auction")
    epoch = records.decode(json_text(auctions, AUCTION, epoch=True), "auction", time_encoding="epoch_ms")
    assert rows(iso) == rows(epoch) == rows(auctions)


def test_time_shift_and_second_grain(spark):
    df = texts(spark, GOOD)
    shifted = records.decode(df, "bid", time_shift_ms=7_200_000).first()["date_time"]
    assert shifted == at(7201.04)
    assert records.decode(df, "bid", grain="second").first()["date_time"] == at(1)


def test_routing_by_fields(spark):
    df = texts(spark, '{"id":4,"email_address":"a"}', '{"id":5,"reserve":1,"price":2,"auction":3}',
               '{"auction":6,"price":1}', '{"auction":7}')
    routed = routing.route(df, unknown="reject")
    assert [(r["topic"], r["key"]) for r in routed.collect()] == [
        ("person", "4"), ("auction", "5"), ("bid", "6"), (None, "7")]
    with pytest.raises(Exception, match="unknown event"):
        routing.route(df).collect()


def test_start_position(tmp_path):
    note = tmp_path / "start.txt"
    assert tables.kafka_options("bid", start_file=str(note))["startingOffsets"] == "latest"
    note.write_text("1704067200000\n")
    options = tables.kafka_options("bid", start_file=str(note), servers="h:1", group="g")
    assert options["startingTimestamp"] == "1704067200000" and "startingOffsets" not in options
    assert options["kafka.bootstrap.servers"] == "h:1" and options["kafka.group.id"] == "g"
    note.write_text("soon")
    assert tables.start_millis(str(note)) is None


def test_brokers_from_the_environment(monkeypatch):
    monkeypatch.delenv("KAFKA_BOOTSTRAP_SERVERS", raising=False)
    assert tables.brokers() == "localhost:9092"
    monkeypatch.setenv("KAFKA_BOOTSTRAP_SERVERS", "b:1")
    assert tables.brokers() == "b:1" and tables.brokers("c:2") == "c:2"


def test_json_files_round_trip(spark, tmp_path, bids):
    df = bids((1, 2, 3, 4.5), (6, 7, 8, 9))
    save_json(df, str(tmp_path / "bids"), files=2)
    assert rows(tables.json_files(spark, "bid", str(tmp_path / "bids"))) == rows(df)


def test_strings_are_escaped_and_nulls_kept(spark):
    df = spark.createDataFrame([('a"b', None)], "name string, n int")
    assert json_records(df).first()["value"] == '{"name":"a\\"b","n":null}'


def test_derivation_mix_and_bounds(spark):
    numbered = derive.numbers(spark, 5000, partitions=3)
    counts = {r["kind"]: r["events"] for r in derive.split_counts(numbered).collect()}
    assert counts == {"person": 100, "auction": 300, "bid": 4600}
    a = derive.auction(numbered)
    assert a.where(~F.col("category").between(10, 14) | (F.col("reserve") < F.col("initial_bid") + 100)
                   | ~F.col("id").between(1000, 1999) | ~F.length("extra").between(25, 50)).count() == 0
    b = derive.bid(numbered)
    assert b.where((F.col("price") < 100) | ~F.col("auction").between(1000, 1999)).count() == 0
    # Any share of the numbers gives the same rows, in whatever order.
    part = derive.bid(derive.numbers(spark, 1000, first=2000))
    assert rows(part) == [r for r in rows(b) if at(20) <= r[5] < at(30)]


def test_unreadable_expires_is_a_reject(spark):
    good = '{"id":1345.0,"item_name":"i","description":"d","initial_bid":1,"reserve":2,"date_time":1704067200000,' \
           '"expires":1704067300000,"seller":1200.0,"category":10,"extra":"e"}'
    bad = good.replace("1704067300000", '"junk"')
    iso = good.replace("1704067200000", '"2024-01-01T00:00:00.000"').replace("1704067300000", '"junk"')
    table = records.epoch_table(texts(spark, good), "auction").first()
    assert (table["id"], table["seller"], table["expires"], table["event_time"]) == (1345, 1200, 1704067300000, at(0))
    assert records.epoch_table(texts(spark, good, bad, "junk"), "auction", bad_data="drop").count() == 1
    for broken in (bad, "junk"):
        with pytest.raises(Exception, match="bad auction record"):
            records.epoch_table(texts(spark, broken), "auction").collect()
    assert [r["reject_reason"] for r in records.rejects(texts(spark, iso), "auction").collect()] == ["unreadable time"]
    with pytest.raises(Exception, match="unreadable time"):
        records.decode(texts(spark, iso), "auction").collect()
    person = '{"id":1,"name":"n","email_address":"e","credit_card":"c","city":"x","state":"or","date_time":"2024-01-01T00:00:01.000","extra":""}'
    assert records.decode(texts(spark, person), "person").first()["date_time"] == at(1)
    assert records.rejects(texts(spark, person.replace("2024-01-01T", "soon ")), "person").count() == 1
