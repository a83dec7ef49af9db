"""Start, finish and observe streaming queries; results and checkpoints go to shared folders."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from ..session import new_path, staging
from ..sources.tables import zone_free

BATCH = "batch_id"
ADAPTIVE = "spark.sql.adaptive.enabled"
SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
STATE_PER_CORE, LEAST_STATE = 2, 16


class ProgressLog(StreamingQueryListener):
    """The progress of every micro-batch of all queries that run meanwhile; a query itself keeps only the newest."""

    def __init__(self) -> None:
        self.rows: dict[str, list[dict]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows.setdefault(str(event.progress.runId), []).append(json.loads(event.progress.json))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def of(self, query: StreamingQuery, timeout: float = 60.0) -> list[dict]:
        """The progress of a query that has ended; events come in order, its end last."""
        until = time.monotonic() + timeout
        while str(query.runId) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)
        return self.rows.get(str(query.runId), [])


@contextmanager
def progress_log(spark: SparkSession) -> Iterator[ProgressLog]:
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        yield log
    finally:
        spark.streams.removeListener(log)


def finish(spark: SparkSession, start: Callable[[], StreamingQuery]) -> list[dict]:
    """Start a query, wait until all available input is done, return the progress of every micro-batch."""
    with progress_log(spark) as log:
        query = start()
        query.awaitTermination()
        return log.of(query)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that a query started inside keeps."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """Streams started inside have ``STATE_PER_CORE`` state partitions per core, or as many as ``spark.sql.shuffle.partitions`` if fewer.

    Every state operator commits files for each partition in every micro-batch, with or without rows, so further partitions
    cost time and hold no more. The checkpoint keeps the number of the first start. At least ``LEAST_STATE``, for a
    cluster whose executors have yet to come.
    """
    asked = int(spark.conf.get(SHUFFLE_PARTITIONS))
    most = max(LEAST_STATE, STATE_PER_CORE * spark.sparkContext.defaultParallelism)
    with setting(spark, SHUFFLE_PARTITIONS, str(min(asked, most))):
        yield


def start_files(df: DataFrame, out: str, checkpoint: str, by: Sequence[str] = ()) -> StreamingQuery:
    """Append to Parquet files, exactly once per checkpoint; columns ``by`` become folders, each a sink of its own."""
    with state_partitions(df.sparkSession):
        return (df.writeStream.format("parquet").outputMode("append").partitionBy(*by)
                .option("path", out).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())


def to_files(df: DataFrame, name: str, root: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Run a stream over all input there is and return what it appended.

    With ``root``, a folder of the shared kind, a further run goes on from there.
    """
    spark = df.sparkSession
    root = root or new_path(spark, name)
    out = f"{root}/out"
    start_files(df, out, f"{root}/checkpoint", by).awaitTermination()
    return zone_free(spark.read.schema(df.schema).parquet(out))


def batch_path(root: str, batch_id: int) -> str:
    return f"{root}/{BATCH}={batch_id}"


def read_batches(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All micro-batch folders below ``root``, with the number of each."""
    return spark.read.schema(StructType([*schema.fields, StructField(BATCH, LongType())])).parquet(root)


def start_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append", hold: bool = True) -> StreamingQuery:
    """Call ``each`` with every micro-batch, computed once and held while it runs.

    Without ``hold`` it is not kept, for an ``each`` that reads it only once. A stream turns adaptive planning off for its own plan. The rows of a micro-batch are
    settled by then, so the jobs over them plan as the session does. Stages that a micro-batch
    writes for itself are removed at its end.
    """
    adaptive, shuffled = (df.sparkSession.conf.get(k) for k in (ADAPTIVE, SHUFFLE_PARTITIONS))

    def held(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if hold:
            batch.persist()
        try:
            with setting(session, ADAPTIVE, adaptive), setting(session, SHUFFLE_PARTITIONS, shuffled), staging(session):
                each(batch, batch_id)
        finally:
            if hold:
                batch.unpersist()

    with state_partitions(df.sparkSession):
        return (df.writeStream.foreachBatch(held).outputMode(mode)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def to_batches(df: DataFrame, transform: Callable[[DataFrame], DataFrame], schema: StructType,
               name: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """Write a batch transformation of every micro-batch under its number.

    A repeated micro-batch overwrites its own folder, so a restart adds nothing twice.
    """
    spark = df.sparkSession
    root = root or new_path(spark, name)
    # An empty folder keeps the result readable when no micro-batch ran.
    spark.createDataFrame([], schema).write.mode("ignore").parquet(batch_path(f"{root}/out", -1))

    def each(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(batch_path(f"{root}/out", batch_id))

    start_batches(df, each, f"{root}/checkpoint", mode).awaitTermination()
    return zone_free(read_batches(spark, f"{root}/out", schema))


def dropped_as_late(progress: list[dict]) -> int:
    """Rows that state operators dropped for being behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])
