"""What a checkpoint's state store holds, read as tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a checkpoint: number, name, state store, partitions and batches."""
    return spark.read.format("state-metadata").load(checkpoint)


def state(spark: SparkSession, checkpoint: str, operator: int, store: str = "default") -> DataFrame:
    """Keys and values of one operator after the last committed micro-batch, with the partition they are in."""
    return (spark.read.format("statestore").option("operatorId", operator).option("storeName", store).load(checkpoint))


def watermark(spark: SparkSession, checkpoint: str) -> Column:
    """The watermark that the last micro-batch ran under, as a timestamp."""
    logs = spark.read.text(f"{checkpoint}/offsets", wholetext=True).select(
        F.regexp_extract(F.input_file_name(), "([0-9]+)$", 1).cast("bigint").alias("batch"), "value")
    last = logs.where(F.col("value").contains("batchWatermarkMs")).orderBy(F.desc("batch")).first()
    # A version, then the batch's metadata, then a line for each source.
    return F.timestamp_millis(F.lit(int(json.loads(last["value"].splitlines()[1])["batchWatermarkMs"])))


def windows_behind(spark: SparkSession, checkpoint: str) -> DataFrame:
    """For each windowed aggregate: its keys, and how many of them belong to windows that the watermark has passed."""
    reached, found = watermark(spark, checkpoint), None
    for row in operators(spark, checkpoint).where("operatorName = 'stateStoreSave'").select("operatorId").distinct().orderBy("operatorId").collect():
        held = state(spark, checkpoint, row["operatorId"])
        window = next(c for c in held.schema["key"].dataType.fieldNames() if "window" in c)
        counted = held.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col(f"key.`{window}`.end") <= reached).alias("behind")).select(
            F.lit(int(row["operatorId"])).cast("bigint").alias("operator"), "keys", "behind")
        found = counted if found is None else found.unionByName(counted)
    return found
