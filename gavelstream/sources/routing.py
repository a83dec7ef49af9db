"""One mixed event stream to one topic per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOPICS = {"person": "person", "auction": "auction", "bid": "bid"}


# The fields that tell the entities apart, or name the record.
_FIELDS = ["email_address", "reserve", "price", "auction", "id"]


def _topic(topics: dict[str, str]) -> Column:
    return (F.when(F.col("email_address").isNotNull(), topics["person"])
            .when(F.col("reserve").isNotNull(), topics["auction"])
            .when(F.col("price").isNotNull() & F.col("auction").isNotNull(), topics["bid"]))


def route(df: DataFrame, topics: dict[str, str] = TOPICS, unknown: str = "fail") -> DataFrame:
    """``value`` rows to ``(topic, key, value)``; the key is the id, else the auction.

    The fields present decide the topic; a record is parsed once. Records of no known
    kind stop the job, or with ``unknown='reject'`` get a null topic.
    """
    fields = df.select("value", F.json_tuple("value", *_FIELDS).alias(*_FIELDS))
    topic = _topic(topics)
    if unknown == "fail":
        stop = F.raise_error(F.concat(F.lit("unknown event: "), F.col("value")))
        topic = F.coalesce(topic, stop.cast("string"))
    elif unknown != "reject":
        raise ValueError(f"unknown must be fail or reject, not {unknown!r}")
    return fields.select(topic.alias("topic"), F.coalesce("id", "auction").alias("key"), "value")


def of_topic(routed: DataFrame, topic: str) -> DataFrame:
    return routed.where(F.col("topic") == topic).select("key", "value")
