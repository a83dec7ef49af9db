"""Samples of a running query: how far each source has been read, and the processor time of its tasks.

Both are tables for ``operators.progress``: offsets come out of the progress of every micro-batch,
processor time out of Spark's stage metrics, read once a second while the query runs.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Mapping
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import progress
from ..session import new_path
from .run import progress_log

OFFSETS = "topic string, ts timestamp_ntz, total_offset bigint"
USAGE = "query string, worker bigint, ts timestamp_ntz, cpu_pct bigint"


class Samples(NamedTuple):
    offsets: DataFrame  # topic, ts, total_offset
    usage: DataFrame  # query, worker, ts, cpu_pct: of all executors, as worker 0

    def throughput(self) -> DataFrame:
        return progress.topic_throughput(self.offsets)

    def core_seconds(self) -> DataFrame:
        return progress.core_seconds(self.usage, ["query"])


class ProcessorTime:
    """Nanoseconds that tasks have used, by stage; a stage that Spark has forgotten keeps what was last seen."""

    def __init__(self, spark: SparkSession):
        self.sc = spark.sparkContext
        self.seen: dict[tuple[int, int], int] = {}
        self.read()
        self.before = dict(self.seen)

    def read(self) -> int:
        jvm = self.sc._jvm
        none = self.sc._gateway.new_array(jvm.double, 0)
        stages = self.sc._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
        for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages):
            self.seen[s.stageId(), s.attemptId()] = s.executorCpuTime()
        return sum(self.seen.values())


def reached(source: dict, so_far: int) -> int:
    """Rows of a source up to a micro-batch: the offsets of a topic's partitions if it has any, else what was counted."""
    end = source.get("endOffset")
    end = json.loads(end) if isinstance(end, str) and end.startswith("{") else end
    if isinstance(end, dict) and end and all(isinstance(p, dict) for p in end.values()):
        return sum(offset for partitions in end.values() for offset in partitions.values())
    return so_far + source["numInputRows"]


def offset_rows(batches: list[dict], topics: Mapping[str, str]) -> list[dict]:
    """One sample per topic and second in which a micro-batch began: what was read by its end.

    ``topics`` tells a source by a part of its description. A topic begins with a sample of nothing read.
    """
    so_far, samples = dict.fromkeys(topics, 0), {}
    for batch in batches:
        second = batch["timestamp"][:19]
        for topic, part in topics.items():
            before = so_far[topic]
            for source in batch["sources"]:
                if part in source["description"]:
                    so_far[topic] = reached(source, so_far[topic])
            if not any(t == topic for t, _ in samples):
                first = datetime.fromisoformat(second).timestamp() - 1
                samples[topic, datetime.fromtimestamp(first).isoformat()] = before
            samples[topic, second] = so_far[topic]
    return [{"topic": topic, "ts": ts, "total_offset": n} for (topic, ts), n in samples.items()]


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    texts = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return texts.select(F.from_json("value", schema).alias("r")).select("r.*")


def sampled(df: DataFrame, name: str, topics: Mapping[str, str], every: str = "1 second") -> Samples:
    """Run a query over all input there is, without a sink, and return its samples.

    Rows are few: one per topic and micro-batch, and one per second.
    """
    spark = df.sparkSession
    usage = []
    with progress_log(spark) as log:
        spent = ProcessorTime(spark)
        total, at = sum(spent.before.values()), time.monotonic()
        query = (df.writeStream.queryName(name).format("noop").outputMode("append")
                 .option("checkpointLocation", new_path(spark, f"{name}-checkpoint"))
                 .trigger(processingTime=every).start())
        try:
            reader = threading.Thread(target=query.processAllAvailable, daemon=True)
            reader.start()
            going = True
            while going:
                reader.join(1.0)
                going = reader.is_alive()
                now, clock = spent.read(), time.monotonic()
                percent = round(100 * (now - total) / 1e9 / max(clock - at, 1e-3))
                usage.append({"query": name, "worker": 0, "ts": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f"), "cpu_pct": percent})
                total, at = now, clock
            if query.exception() is not None:
                raise query.exception()
        finally:
            query.stop()
        return Samples(_table(spark, offset_rows(log.of(query), topics), OFFSETS), _table(spark, usage, USAGE))


def table_offsets(spark: SparkSession, tables: Mapping[str, DataFrame], parts: int = 4) -> Samples:
    """The tables as topics of one running query, each in ``parts`` files, one of them a micro-batch."""
    root = new_path(spark, "topics")
    streams = []
    for topic, table in tables.items():
        path = f"{root}/{topic}"
        table.repartition(parts).write.parquet(path)
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
        streams.append(stream.select(F.lit(topic).alias("topic"), F.struct(*stream.columns).cast("string").alias("value")))
    whole = streams[0]
    for stream in streams[1:]:
        whole = whole.unionByName(stream)
    return sampled(whole, "tables", {topic: f"{root.rsplit('/', 1)[-1]}/{topic}]" for topic in tables})
