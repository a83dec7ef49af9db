"""Declared schemas of the three entities; nothing is inferred."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _struct(*fields):
    return StructType([StructField(name, kind()) for name, kind in fields])


PERSON = _struct(
    ("id", LongType),
    ("name", StringType),
    ("email_address", StringType),
    ("credit_card", StringType),
    ("city", StringType),
    ("state", StringType),
    ("date_time", TimestampNTZType),
    ("extra", StringType),
)

AUCTION = _struct(
    ("id", LongType),
    ("item_name", StringType),
    ("description", StringType),
    ("initial_bid", LongType),
    ("reserve", LongType),
    ("date_time", TimestampNTZType),
    ("expires", TimestampNTZType),
    ("seller", LongType),
    ("category", LongType),
    ("extra", StringType),
)

BID = _struct(
    ("auction", LongType),
    ("bidder", LongType),
    ("price", LongType),
    ("channel", StringType),
    ("url", StringType),
    ("date_time", TimestampNTZType),
    ("extra", StringType),
)

ENTITIES = {"person": PERSON, "auction": AUCTION, "bid": BID}

# Columns that refer to another entity, or number this one.
ID_COLUMNS = {"person": ["id"], "auction": ["id", "seller"], "bid": ["auction", "bidder"]}

EVENTS = _struct(
    ("event_id", LongType),
    ("ts", TimestampNTZType),
    ("user_id", LongType),
    ("event_type", StringType),
    ("value", DoubleType),
    ("props", StringType),
)

ORDERS = _struct(
    ("o_orderkey", LongType),
    ("o_custkey", LongType),
    ("o_orderstatus", StringType),
    ("o_totalprice", DoubleType),
    ("o_orderdate", TimestampNTZType),
    ("o_orderpriority", StringType),
)

LINEITEM = _struct(
    ("l_orderkey", LongType),
    ("l_partkey", LongType),
    ("l_suppkey", LongType),
    ("l_linenumber", IntegerType),
    ("l_quantity", DoubleType),
    ("l_extendedprice", DoubleType),
    ("l_discount", DoubleType),
    ("l_tax", DoubleType),
    ("l_returnflag", StringType),
    ("l_linestatus", StringType),
    ("l_shipdate", TimestampNTZType),
)

TABLES = {"events": EVENTS, "orders": ORDERS, "lineitem": LINEITEM}
