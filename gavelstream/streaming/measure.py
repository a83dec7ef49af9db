"""Run a streaming query for a while and keep its progress as a table."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import new_path
from .run import progress_log

PROGRESS = ("query string, batch_id bigint, ts timestamp_ntz, input_rows bigint, "
            "input_rows_per_sec double, processed_rows_per_sec double")


def wait_until_running(query: StreamingQuery, timeout: float = 60.0) -> bool:
    """True once the query has finished a micro-batch; False if it ends or the time is up."""
    until = time.monotonic() + timeout
    while time.monotonic() < until:
        if query.lastProgress is not None:
            return True
        if not query.isActive:
            return False
        time.sleep(0.1)
    return False


def progress_rows(spark: SparkSession, progress: list[dict]) -> DataFrame:
    """Progress as a table, one row per micro-batch."""
    rows = [json.dumps({"query": p["name"] or p["id"], "batch_id": p["batchId"], "ts": p["timestamp"].rstrip("Z"),
                        "input_rows": p["numInputRows"], "input_rows_per_sec": p.get("inputRowsPerSecond"),
                        "processed_rows_per_sec": p.get("processedRowsPerSecond")}) for p in progress]
    texts = spark.createDataFrame([(r,) for r in rows], "value string")
    return texts.select(F.from_json("value", PROGRESS).alias("p")).select("p.*")


def measured(df: DataFrame, name: str, warmup: float = 30.0, seconds: float = 120.0,
             every: str = "1 second") -> DataFrame:
    """Start a query without a sink, let it warm up, measure it, stop it.

    Returns the progress of every micro-batch of the measured span; those of the warm-up are left out.
    """
    spark = df.sparkSession
    with progress_log(spark) as log:
        query = (df.writeStream.queryName(name).format("noop").outputMode("append")
                 .option("checkpointLocation", new_path(spark, f"{name}-checkpoint"))
                 .trigger(processingTime=every).start())
        try:
            if not wait_until_running(query):
                raise RuntimeError(f"query {name} did not start: {query.exception()}")
            time.sleep(warmup)
            first = query.lastProgress["batchId"] if warmup else -1
            time.sleep(seconds)
        finally:
            query.stop()
        return progress_rows(spark, [p for p in log.of(query) if p["batchId"] > first])
