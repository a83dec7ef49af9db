"""Entities from Kafka topics, JSON or Parquet files, as static or streaming DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import ENTITIES, TABLES
from .records import decode

LATENESS = "5 seconds"
BROKERS_VARIABLE, DEFAULT_BROKERS = "KAFKA_BOOTSTRAP_SERVERS", "localhost:9092"
VALUE = StructType([StructField("value", StringType())])


def brokers(given: str | None = None) -> str:
    return given or os.environ.get(BROKERS_VARIABLE) or DEFAULT_BROKERS


def start_millis(path: str) -> int | None:
    """The start time noted in a file's first line, or None when there is none to read."""
    try:
        with open(path) as note:
            return int(note.readline().strip())
    except (OSError, ValueError):
        return None


def kafka_options(topic: str, *, servers: str | None = None, group: str | None = None,
                  start_file: str = "benchmark_timestamp.txt") -> dict[str, str]:
    """Reader options: start at the noted time if there is one, else at the newest record."""
    options = {"kafka.bootstrap.servers": brokers(servers), "subscribe": topic}
    if group:
        options["kafka.group.id"] = group
    start = start_millis(start_file)
    if start is None:
        options["startingOffsets"] = "latest"
    else:
        options["startingTimestamp"] = str(start)
        options["startingOffsetsByTimestampStrategy"] = "latest"
    return options


def kafka_stream(spark: SparkSession, entity: str, *, topic: str | None = None,
                 servers: str | None = None, group: str | None = None,
                 start_file: str = "benchmark_timestamp.txt",
                 min_partitions: int | None = None, **decoding) -> DataFrame:
    """An entity's topic as a watermarked stream; the record key is not read."""
    options = kafka_options(topic or entity, servers=servers, group=group, start_file=start_file)
    if min_partitions:
        options["minPartitions"] = str(min_partitions)
    raw = spark.readStream.format("kafka").options(**options).load()
    values = raw.select(F.col("value").cast("string").alias("value"))
    return as_stream(decode(values, entity, **decoding))


def json_files(spark: SparkSession, entity: str, path: str, *, streaming: bool = False,
               max_files: int | None = None, **decoding) -> DataFrame:
    """Text files of one JSON record per line."""
    if streaming:
        reader = spark.readStream.schema(VALUE)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return as_stream(decode(reader.text(path), entity, **decoding))
    return decode(spark.read.text(path), entity, **decoding)


def parquet_files(spark: SparkSession, entity: str, path: str, *, streaming: bool = False,
                  max_files: int | None = None, lateness: str | None = LATENESS) -> DataFrame:
    """Parquet with the entity's declared columns; filters and columns reach the scan."""
    schema = ENTITIES[entity]
    if not streaming:
        return spark.read.schema(schema).parquet(path)
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return as_stream(reader.parquet(path), lateness=lateness)


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """One of the given Parquet tables as a stream with its declared schema."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(TABLES[name])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path + "*")


def register(**entities: DataFrame) -> None:
    """Name frames for SQL: ``register(bid=bids)`` and then ``SELECT ... FROM bid``."""
    for name, df in entities.items():
        df.createOrReplaceTempView(name)


def as_stream(df: DataFrame, time: str = "date_time", lateness: str | None = LATENESS) -> DataFrame:
    """Zone-free times as TIMESTAMP, which watermarks need, with the watermark set."""
    zoned = df.withColumns({f.name: F.col(f.name).cast("timestamp")
                            for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"})
    return zoned.withWatermark(time, lateness) if lateness else zoned


def zone_free(df: DataFrame) -> DataFrame:
    """Stream results back to zone-free times."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz")
                           for f in df.schema.fields if f.dataType.typeName() == "timestamp"})


def from_time(df: DataFrame, start: str | None, time: str = "date_time") -> DataFrame:
    """Rows at or after a start time; the comparison is pushed to a Parquet scan."""
    return df if start is None else df.where(F.col(time) >= F.expr(f"timestamp_ntz'{start}'"))


def second_grain(df: DataFrame, *times: str) -> DataFrame:
    """Event times cut to whole seconds."""
    return df.withColumns({t: F.date_trunc("second", F.col(t)).cast(df.schema[t].dataType)
                           for t in times})
