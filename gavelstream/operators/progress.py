"""Throughput and processor-time figures over progress samples.

Samples are rows ``(topic, worker, ts, offset, cpu_pct)``: at time ``ts`` a topic's
partition on that worker had reached ``offset`` and the worker used ``cpu_pct``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import json_row


def topic_offsets(samples: DataFrame) -> DataFrame:
    """A topic's total offset at each sample time: the sum over its partitions."""
    return samples.groupBy("topic", "ts").agg(F.sum("offset").alias("total_offset"))


def topic_throughput(offsets: DataFrame) -> DataFrame:
    """Events since the previous sample and per second of it.

    The window runs over one row per topic and sample time, not over events.
    """
    by_time = Window.partitionBy("topic").orderBy("ts")
    before, since = F.lag("total_offset").over(by_time), F.lag("ts").over(by_time)
    return (offsets.select("topic", "ts", (F.col("total_offset") - before).alias("events"),
                           F.timestamp_diff("SECOND", since, F.col("ts")).alias("seconds"))
            .where(F.col("seconds").isNotNull())
            .withColumn("events_per_sec", F.col("events") / F.col("seconds")))


def readers(query_topics: dict[str, Sequence[str]]) -> Column:
    """The queries that use a row's topic, as an array."""
    queries = F.lit(None).cast("array<string>")
    for topic in sorted({t for topics in query_topics.values() for t in topics}):
        using = F.array(*[F.lit(q) for q, topics in query_topics.items() if topic in topics])
        queries = F.when(F.col("topic") == topic, using).otherwise(queries)
    return queries


def query_throughput(throughput: DataFrame, query_topics: dict[str, Sequence[str]]) -> DataFrame:
    """A query's rate: the sum over the topics it uses."""
    return (throughput.withColumn("query", F.explode(readers(query_topics)))
            .groupBy("query", "ts")
            .agg(F.sum("events").alias("events"), F.max("seconds").alias("seconds"))
            .withColumn("events_per_sec", F.col("events") / F.col("seconds")))


def after_warmup(df: DataFrame, start: Column, warmup: str, measured: str) -> DataFrame:
    """Samples of the measured span, which begins when the warm-up is over."""
    begin = start + F.expr(f"INTERVAL {warmup}")
    return df.where((F.col("ts") >= begin) & (F.col("ts") < begin + F.expr(f"INTERVAL {measured}")))


def sample_stats(df: DataFrame, sample: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, average, extremes and population deviation of whole-number samples, 0 if none.

    Sums are exact decimals, so the figures do not depend on how rows are spread.
    """
    x = F.col(sample).cast("decimal(19,0)")
    sums = df.groupBy(*keys).agg(
        F.count(sample).alias("samples"), F.sum(x).alias("_s"),
        F.sum((x * x).cast("decimal(28,0)")).alias("_q"),
        F.min(sample).alias("_lo"), F.max(sample).alias("_hi"))
    n, total, squares = F.col("samples"), F.col("_s").cast("double"), F.col("_q").cast("double")
    spread = F.sqrt(squares * n - total * total) / n
    return sums.select(
        *keys, "samples",
        F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("average"),
        F.coalesce("_lo", F.lit(0)).alias("minimum"),
        F.coalesce("_hi", F.lit(0)).alias("maximum"),
        F.when(n > 0, spread).otherwise(F.lit(0.0)).alias("deviation"))


def core_seconds(samples: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average over samples of the summed worker percentage, times elapsed time, over 100."""
    per_sample = samples.groupBy(*keys, "ts").agg(F.sum("cpu_pct").alias("cpu_pct"))
    elapsed = F.timestamp_diff("SECOND", F.min("ts"), F.max("ts"))
    return per_sample.groupBy(*keys).agg(
        F.sum("cpu_pct").alias("_cpu"), F.count("*").alias("samples"), elapsed.alias("elapsed_sec")
    ).select(*keys, "samples", "elapsed_sec",
             F.round(F.col("_cpu") * F.col("elapsed_sec") / (F.col("samples") * 100)).cast("bigint")
             .alias("core_seconds"))


def summary(inputs: DataFrame, outputs: DataFrame, cores: DataFrame) -> DataFrame:
    """One record per query: input rate, output rate, core-seconds, and the same as JSON."""
    rates = inputs.groupBy("query").agg(
        (F.sum("events") / F.sum("seconds")).alias("input_events_per_sec"),
        F.sum("events").alias("input_events"))
    out = outputs.groupBy("query").agg(
        (F.sum("events") / F.sum("seconds")).alias("output_events_per_sec"),
        F.sum("events").alias("output_events"))
    joined = rates.join(out, "query").join(cores, "query")
    return joined.withColumn("record", json_row(["query", "input_events", "output_events",
                                                 "elapsed_sec", "core_seconds"]))
