"""Late rows, lagging inputs and restarts: input that arrives in parts, one run on the same checkpoint for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.windows import tumble, window_bounds, window_count
from ..schemas import ENTITIES
from ..session import new_path
from ..sources.tables import as_stream, parquet_files, zone_free
from . import closing
from .run import finish, start_files


def counted_in_runs(spark: SparkSession, parts: list[DataFrame],
                    to_rows: Callable[[DataFrame], DataFrame], size: str) -> tuple[DataFrame, list[dict]]:
    """Append closed-window counts while the input arrives part by part.

    Every part becomes new files, then a new run continues from the checkpoint of the
    last one. Returns the appended rows and the progress of all runs.
    """
    incoming, out, checkpoint = (new_path(spark, n) for n in ("incoming", "counts", "counts-checkpoint"))
    progress: list[dict] = []
    counts = None
    for i, part in enumerate(parts):
        part.write.parquet(f"{incoming}/part={i}")
        raw = spark.readStream.schema(part.schema).parquet(f"{incoming}/part=*")
        rows = as_stream(to_rows(raw))
        counts = window_bounds(window_count(rows, [], tumble("date_time", size), "events"))
        progress += finish(spark, lambda: start_files(counts, out, checkpoint))  # noqa: B023
    return zone_free(spark.read.schema(counts.schema).parquet(out)), progress


def averages_in_runs(spark: SparkSession, parts: list[tuple[DataFrame | None, DataFrame | None]]) -> DataFrame:
    """Streamed q4 over (auctions, bids) that arrive part by part, a restart between them."""
    root = new_path(spark, "q4-runs")
    prices = None
    for part in parts:
        for name, rows in zip(("auction", "bid"), part, strict=True):
            # An empty part still makes a folder that the stream can read.
            (spark.createDataFrame([], ENTITIES[name]) if rows is None else rows).write.mode("append").parquet(f"{root}/{name}")
        streams = [parquet_files(spark, name, f"{root}/{name}", streaming=True, lateness=closing.LIFE) for name in ("auction", "bid")]
        prices = closing.run(*streams, root=f"{root}/state")
    return closing.current_average(prices)


def lose_commit(spark: SparkSession, checkpoint: str) -> int | None:
    """Leave a checkpoint as a crash does between a sink's write and the commit of its micro-batch; returns which one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(f.getPath().getName()) for f in files.listStatus(folder) if f.getPath().getName().isdigit()] if files.exists(folder) else []
    if not done:
        return None
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, str(max(done))), False)
    return max(done)


def with_crashes(spark: SparkSession, run: Callable[[dict[str, DataFrame], str], DataFrame],
                 checkpoint: str = "checkpoint") -> Callable[[dict[str, DataFrame], str], DataFrame]:
    """``run``, crashed after the write and before the commit of its last micro-batch, and restarted."""
    def crashed(streams: dict[str, DataFrame], root: str) -> DataFrame:
        run(streams, root)
        lose_commit(spark, f"{root}/{checkpoint}")
        return run(streams, root)

    return crashed


def once_each(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Records by key once, however often they are delivered within the watermark's delay; the keys go with the watermark."""
    return rows.dropDuplicatesWithinWatermark([key]).select(*rows.columns)


def in_parts(spark: SparkSession, parts: list[dict[str, DataFrame]], times: dict[str, str],
             run: Callable[[dict[str, DataFrame], str], DataFrame], lateness: str) -> DataFrame:
    """Run a query over inputs that arrive part by part, a restart from its checkpoint between them.

    ``parts`` are named inputs, ``times`` their event-time columns; an input without one gets no
    watermark here. ``run`` gets the streams and the folder it keeps its state in; what it returns
    after the last part is the result.
    """
    root = new_path(spark, "parts")
    result = None
    for part in parts:
        for name, rows in part.items():
            rows.write.mode("append").parquet(f"{root}/in/{name}")
        streams = {}
        for name, rows in part.items():
            raw = spark.readStream.schema(rows.schema).parquet(f"{root}/in/{name}")
            streams[name] = as_stream(raw, times[name], lateness) if name in times else raw
        result = run(streams, f"{root}/run")
    return result
