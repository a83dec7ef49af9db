"""Session defaults, the shared working folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A broadcast side must hold no more rows and no more bytes than this, as counted while it is written.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64_000_000

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A commit writes what changed, not a snapshot.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
} | STATE_STORE

_local_dirs: dict[str, str] = {}
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def build_session(app: str = "gavelstream", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; keyword keys use ``__`` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """What keyed state with lists and timers needs, for a session that was built elsewhere."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="gavelstream-")
    return _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path, made = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", _made.get()
    if made is not None:
        made.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote below the shared folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Remove at its end what was put below the shared folder within: stages, stream results, checkpoints.

    Results are lazy and read those tables, so save or count them inside. Scopes nest, and each
    holds only what its own thread makes.
    """
    mine: list[str] = []
    outer = _made.set(mine)
    try:
        yield
    finally:
        _made.reset(outer)
        for path in mine:
            remove(spark, path)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: text by its length, nested columns by their JSON, 8 for any other."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("array", "map", "struct"):
            column = F.octet_length(F.to_json(F.struct(column)))
        else:
            column = F.octet_length(column) if kind in ("string", "binary") else F.lit(0)
        total = total + F.coalesce(column, F.lit(0)) + 8
    return total


def _write(df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """Write to the shared folder; return what was written, its row count and about its bytes."""
    spark = df.sparkSession
    path, seen = new_path(spark, name), Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df)).alias("bytes"))
    counted.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get.get("rows") or 0, seen.get.get("bytes") or 0


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """A frame that several steps read, computed once: a table in the shared folder.

    It survives the loss of executors and cuts the lineage of what follows.
    """
    return _write(df, name)[0]


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Compute a join side once and broadcast it only if its counted rows and bytes allow.

    Above the bound the caller's join stays a shuffled one, which the adaptive
    planner splits where a key is skewed.
    """
    side, rows, size = _write(df, "side")
    return F.broadcast(side) if rows <= max_rows and size <= BROADCAST_BYTES else side


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan has fewer splits than there are cores.

    Meant for narrow rows before costly work. A large table has more splits than cores
    and is left as it is.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
