"""Small helpers of the operators: Arrow columns, row keys, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import new_path

# One Arrow batch of whole texts is cut into pieces of about this many bytes of work.
SLICE_BYTES = 8_000_000


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` apart from these; an output replaces an input column of its name."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col(f"`{name.replace('`', '``')}`")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. Texts of ASCII alone take the quick way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def add_columns(df: DataFrame, inputs: Sequence[str], outputs: str,
                function: Callable[..., Sequence[pa.Array]], keep: Sequence[str] | None = None,
                done: Callable[[], object] | None = None) -> DataFrame:
    """Append columns that ``function`` makes from whole Arrow arrays of the input columns.

    No shuffle. ``outputs`` is a DDL schema. Kept columns pass through as they are; those
    that bear the name of an output are replaced. Workers outlive their tasks: when a task ends, ``done`` is called and what
    Arrow keeps for further batches goes back.
    """
    added = StructType.fromDDL(outputs)
    kept = without(df.select(*map(quoted, df.columns if keep is None else keep)), *added.fieldNames())
    n = len(kept)
    # Inputs travel under names of their own, so that no extra column can clash with them.
    rows = df.select(*map(quoted, kept), *[quoted(c).alias(f"\x01in{i}") for i, c in enumerate(inputs)])
    schema = StructType([*rows.schema.fields[:n], *added.fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = batch = made = None
        try:
            for whole in batches:
                rows_each = max(1, min(whole.num_rows, whole.num_rows * SLICE_BYTES // max(1, whole.nbytes)))
                for start in range(0, whole.num_rows, rows_each):
                    batch = whole.slice(start, rows_each)
                    made = list(function(*batch.columns[n:]))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=names)
        finally:
            del whole, batch, made
            if done is not None:
                done()
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote below the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Staged:
    """Tables in the shared folder: they cut lineage, survive lost executors, and can be dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def put(self, df: DataFrame, key: str) -> DataFrame:
        path = new_path(self.spark, f"{self.name}-{key}")
        df.write.parquet(path)
        self.paths.setdefault(key, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, key: str, keep_last: int = 0) -> None:
        """Delete what was put under ``key`` apart from the newest tables."""
        old = self.paths.get(key, [])
        gone, self.paths[key] = old[:len(old) - keep_last], old[len(old) - keep_last:]
        for path in gone:
            remove(self.spark, path)


def partitions(spark: SparkSession) -> int:
    """Tasks for processor-bound steps whose rows are few and small."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
