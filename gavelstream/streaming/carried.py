"""An upsert sink: keyed tables of the shared folder to which micro-batches add rows that merge.

Everything is written under the micro-batch number, so a repeated micro-batch writes the same
folders again, and what only older micro-batches could read is deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import upsert_latest
from ..session import remove
from .run import BATCH, batch_path, read_batches

FOLD_EVERY = 16

Change = Callable[[DataFrame], DataFrame]


class Folded:
    """A keyed table below ``root`` to which each micro-batch adds rows; ``fold`` merges the rows of a key.

    A reader folds the last whole table and what was added since. Every ``every`` micro-batches
    all of it becomes a new whole table, and one micro-batch later the old one and what it took
    in are deleted, so the folder holds each key a bounded number of times. Folding what was
    folded before must change nothing. Micro-batches are numbered without gaps, from 0.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], fold: Change,
                 every: int | None = None):
        self.spark, self.root, self.schema, self.keys, self.fold = spark, root, schema, list(keys), fold
        self.every = every or FOLD_EVERY
        for table in ("whole", "added"):
            self._empty().write.mode("ignore").parquet(self._path(table, -1))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _path(self, table: str, batch_id: int) -> str:
        return batch_path(f"{self.root}/{table}", batch_id)

    def _since(self, whole: int, batch_id: int) -> list[str]:
        """The whole table of a micro-batch and what was added after it."""
        first = [self._path("whole", whole)] if whole >= 0 else []
        return first + [self._path("added", i) for i in range(max(0, whole + 1), batch_id + 1)]

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self._empty()

    def add(self, df: DataFrame, batch_id: int) -> DataFrame:
        """Write a micro-batch's rows; returns them as written."""
        path = self._path("added", batch_id)
        df.write.mode("overwrite").parquet(path)
        if batch_id % self.every == 0:
            before = self._rows(self._since(batch_id - self.every, batch_id))
            self.fold(before).write.mode("overwrite").parquet(self._path("whole", batch_id))
        elif batch_id % self.every == 1:
            for old in self._since(batch_id - 1 - self.every, batch_id - 1):
                remove(self.spark, old)
        return self._rows([path])

    def read(self, batch_id: int, only: DataFrame | None = None) -> DataFrame:
        """The table after a micro-batch; with ``only``, the rows of the keys there, picked before folding."""
        if batch_id < 0:
            return self._empty()
        rows = self._rows(self._since(batch_id - batch_id % self.every, batch_id))
        if only is not None:
            rows = rows.join(only.select(*self.keys), self.keys, "left_semi")
        return self.fold(rows)

    def last(self) -> int:
        """The newest micro-batch that holds rows, -1 before any; empty ones after it change nothing."""
        newest = [read_batches(self.spark, f"{self.root}/{t}", self._empty().schema).agg(F.max(BATCH)).first()[0]
                  for t in ("whole", "added")]
        return max((n for n in newest if n is not None), default=-1)


VERSION = "version"


def upserts(spark: SparkSession, root: str, columns: str, keys: Sequence[str]) -> Folded:
    """A table of the latest row per key; rows are added with the micro-batch number as ``version``."""
    return Folded(spark, root, f"{columns}, {VERSION} bigint", keys, lambda df: upsert_latest(df, keys, [VERSION]))
