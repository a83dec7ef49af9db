"""Progress samples read off the events table, and the measurement queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import progress
from ..session import written

WORKERS = 9
EVERY = "6 hours"
# Which topics a query reads, and where its result goes.
READS = {"q1": ["click"], "q2": ["view"], "q3": ["click", "signup"], "q4": ["signup", "view"]}
WRITES = {"q1": ["purchase"], "q2": ["error"], "q3": ["purchase"], "q4": ["error"]}


def samples(events: DataFrame) -> DataFrame:
    """One sample per topic, worker and 6 hours: events so far, and processor use.

    Events are counted per sample before anything is ordered; the running sum goes over
    sample times only. A topic's missing samples of single workers are filled in.
    """
    counted = written(events.groupBy(
        F.col("event_type").alias("topic"), (F.col("user_id") % WORKERS).alias("worker"),
        F.window("ts", EVERY)["end"].alias("ts")).agg(
        F.count("*").alias("events"), F.max(F.floor("value")).alias("cpu_pct")))
    workers = F.sequence(F.lit(0), F.lit(WORKERS - 1)).cast("array<bigint>")
    times = counted.select("topic", "ts").distinct().withColumn("worker", F.explode(workers))
    filled = times.join(counted, ["topic", "worker", "ts"], "left").fillna(0, ["events", "cpu_pct"])
    so_far = Window.partitionBy("topic", "worker").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select("topic", "worker", "ts", F.sum("events").over(so_far).alias("offset"), "cpu_pct")


def throughput(sampled: DataFrame) -> DataFrame:
    return progress.topic_throughput(progress.topic_offsets(sampled))


def input_rates(sampled: DataFrame) -> DataFrame:
    return progress.query_throughput(throughput(sampled), READS)


def output_rates(sampled: DataFrame) -> DataFrame:
    return progress.query_throughput(throughput(sampled), WRITES)


def stats(sampled: DataFrame) -> DataFrame:
    """Per topic, over the ten days after a two-day warm-up."""
    measured = progress.after_warmup(throughput(sampled), F.expr("timestamp_ntz'2024-01-01 00:00:00'"),
                                     "2 days", "10 days")
    return progress.sample_stats(measured, "events", ["topic"])


def core_seconds(sampled: DataFrame) -> DataFrame:
    """Processor time of the workers while each query's topics were fed."""
    return progress.core_seconds(sampled.withColumn("query", F.explode(progress.readers(READS))), ["query"])


def summary(sampled: DataFrame) -> DataFrame:
    return progress.summary(input_rates(sampled), output_rates(sampled), core_seconds(sampled))
