"""Numbers of rows within ordered groups, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Staged


def numbered(df: DataFrame, group: str, order: Sequence[str], staged: Staged, out: str = "rank") -> DataFrame:
    """Add ``out``: 0, 1, ... within each group by ``order``, nulls first. ``group`` must not hold nulls.

    Rows are dealt out by ranges of (group, order, where they were read), so a group of any size spreads over
    tasks, even one of equal rows. A task numbers the runs of its own range; only the group that a range
    begins with can have begun before it, so one offset per range is all that is added afterwards. ``df`` is
    read twice, to find the ranges and to deal the rows: it should be a written table. Rows that tie are numbered in any order.
    """
    placed = df.withColumn("\x01at", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(group, *order, "\x01at").sortWithinPartitions(group, *order, "\x01at").drop("\x01at")
    schema = StructType([*df.schema.fields, StructField("\x01part", LongType()), StructField("\x01own", LongType())])
    at = df.columns.index(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n, key = batch.num_rows, batch.column(at)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            goes_on = last is not None and key[0].equals(last)
            starts = np.nonzero(new)[0]
            own = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            if goes_on:
                own[:starts[1] if len(starts) > 1 else n] += seen
            last, seen = key[n - 1], int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(own.astype(np.int64))],
                                             names=schema.fieldNames())

    rows = staged.put(ranged.mapInArrow(count, schema), "numbered")
    # One row for each range: its first and last group, and how many rows of the last it holds.
    ends = rows.groupBy("\x01part").agg(F.min(group).alias("first"), F.max(F.struct(group, "\x01own")).alias("last"))
    ends = ends.select("\x01part", "first", F.col(f"last.{group}").alias("last"), (F.col("last.\x01own") + 1).alias("n"))
    by_range = Window.orderBy("\x01part")
    ends = ends.withColumn("until", F.sum("n").over(Window.partitionBy("last").orderBy("\x01part")))
    offset = F.when(F.lag("last").over(by_range) == F.col("first"), F.lag("until").over(by_range)).otherwise(0)
    offsets = ends.select("\x01part", F.col("first").alias("\x01first"), offset.alias("\x01before"))
    # As many rows as there were shuffle partitions.
    return rows.join(F.broadcast(offsets), "\x01part").select(
        *df.columns, (F.col("\x01own") + F.when(F.col(group) == F.col("\x01first"), F.col("\x01before")).otherwise(0)).alias(out))
