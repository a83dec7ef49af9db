"""Results as JSON records to files or Kafka topics, to the console, or nowhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..functions import json_row
from ..sources.tables import brokers

# Producer settings of the workload: batches of 16 KB, 10 ms, lz4.
PRODUCER = {"kafka.compression.type": "lz4", "kafka.batch.size": "16384", "kafka.linger.ms": "10"}


def json_records(df: DataFrame) -> DataFrame:
    """One JSON object per row in ``value``; null fields stay, strings are escaped."""
    return df.select(json_row(df.columns).alias("value"))


def keyed_records(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JSON ``key`` and ``value`` columns."""
    return df.select(json_row(list(keys)).alias("key"), json_row(df.columns).alias("value"))


def kafka_writer(df: DataFrame, topic: str, checkpoint: str, *, servers: str | None = None,
                 keys: Sequence[str] = (), mode: str = "append") -> DataStreamWriter:
    """A stream into a topic: keyed records in update mode make an upsert topic.

    Delivery is at least once, so a reader that needs each row once goes by key.
    """
    records = keyed_records(df, keys) if keys else json_records(df)
    return (records.writeStream.format("kafka").outputMode(mode)
            .option("kafka.bootstrap.servers", brokers(servers))
            .options(**PRODUCER).option("topic", topic)
            .option("checkpointLocation", checkpoint))


def stream_json(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream into text files of JSON records, each exactly once."""
    return (json_records(df).writeStream.format("text").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint))


def save_json(df: DataFrame, path: str, files: int | None = None, by: Sequence[str] = ()) -> None:
    """Text files of JSON records; ``files`` spreads rows round-robin, or by columns."""
    if files:
        df = df.repartition(files, *by)
    json_records(df).write.text(path)


def console(df: DataFrame, rows: int = 20):
    """Print a result; a stream prints each micro-batch."""
    if df.isStreaming:
        return df.writeStream.format("console").option("numRows", rows).outputMode("update")
    return df.show(rows, truncate=False)


def discard(df: DataFrame, checkpoint: str | None = None):
    """Compute everything and keep nothing, to measure."""
    if df.isStreaming:
        writer = df.writeStream.format("noop").outputMode("append")
        return writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return df.write.format("noop").mode("overwrite").save()
