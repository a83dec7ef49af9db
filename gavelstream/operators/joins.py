"""Interval joins, window joins, and the cover of points by many overlapping intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..session import small_side, written

LISTED, HELD_ROWS = 1024, 200_000


def _slot(time: str | Column, width: str) -> Column:
    """Start of the time slot that holds ``time``."""
    return F.window(time, width)["start"]


def _slots(start: Column, end: Column, width: str) -> Column:
    """One row for every slot from the slot start ``start`` up to ``end``."""
    return F.explode(F.sequence(start, end, F.expr(f"INTERVAL {width}")))


def interval_join(left: DataFrame, right: DataFrame, on: dict[str, str], left_time: str,
                  right_time: str, lower: str = "0 seconds", upper: str = "0 seconds",
                  slot: str | None = None) -> DataFrame:
    """Pairs with equal keys and ``left_time + lower <= right_time <= left_time + upper``.

    The bounds are part of the join condition, which lets a stream drop old state.
    With ``slot`` (at best as long as the interval) the time becomes part of the join
    key: one key's rows spread over many tasks and meet only rows near them in time.
    Column names of the two sides must differ.
    """
    condition = F.lit(True)
    for left_key, right_key in on.items():
        condition = condition & (F.col(left_key) == F.col(right_key))
    low = F.col(left_time) + F.expr(f"INTERVAL {lower}")
    high = F.col(left_time) + F.expr(f"INTERVAL {upper}")
    if slot:
        left = (left.withColumns({"_low": low, "_high": high})
                .withColumn("_low_slot", _slot("_low", slot))
                .withColumn("_left_slot", _slots(F.col("_low_slot"), F.col("_high"), slot))
                .drop("_low", "_high", "_low_slot"))
        right = right.withColumn("_right_slot", _slot(right_time, slot))
        condition = condition & (F.col("_left_slot") == F.col("_right_slot"))
    at = F.col(right_time)
    condition = condition & (at == low if lower == upper else at.between(low, high))
    return left.join(right, condition, "inner").drop("_left_slot", "_right_slot")


def between_join(left: DataFrame, right: DataFrame, on: dict[str, str], start: str, end: str,
                 time: str, at_most: str | None = None, slot: str | None = None) -> DataFrame:
    """Pairs with equal keys and ``time`` of the right row within the left row's own interval.

    On streams ``at_most`` bounds the interval's length from its start, so that state ends.
    With ``slot`` (about as long as most intervals) the time becomes part of the join key: a left
    row is copied to each slot its interval touches, and a hot key spreads over its slots.
    An interval that lacks a bound or ends before it starts holds nothing.
    """
    condition = F.lit(True)
    if slot:
        until = F.least(F.col(end), F.col(start) + F.expr(f"INTERVAL {at_most}")) if at_most else F.col(end)
        left = (left.where(F.col(start) <= F.col(end)).withColumn("_low_slot", _slot(start, slot))
                .withColumn("_left_slot", _slots(F.col("_low_slot"), until, slot)).drop("_low_slot"))
        right = right.withColumn("_right_slot", _slot(time, slot))
        condition = F.col("_left_slot") == F.col("_right_slot")
    for left_key, right_key in on.items():
        condition = condition & (F.col(left_key) == F.col(right_key))
    condition = condition & F.col(time).between(F.col(start), F.col(end))
    if at_most:
        condition = condition & (F.col(time) <= F.col(start) + F.expr(f"INTERVAL {at_most}"))
    return left.join(right, condition, "inner").drop("_left_slot", "_right_slot")


def _listed(rows: pa.Table, by: list[str], fields: list[str], newest: str | None, most: int) -> pa.RecordBatch:
    rows = rows.sort_by([(c, "ascending") for c in (*by, *fields)]).combine_chunks()
    values = [rows[c].cast(pa.int64()).to_numpy() for c in by]
    begins = np.ones(len(rows), dtype=bool)
    begins[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
    at = np.arange(len(rows))
    since = at - np.maximum.accumulate(np.where(begins, at, 0))
    first = np.flatnonzero(since % most == 0)
    columns = {c: rows[c].combine_chunks().take(pa.array(first)) for c in by}
    if newest:
        latest = np.maximum.reduceat(rows[newest].cast(pa.int64()).to_numpy(), first)
        columns["_newest"] = pa.array(latest).cast(rows[newest].type)
    structs = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in fields], names=fields)
    columns["_listed"] = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)), type=pa.int32()), structs)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def listed(df: DataFrame, by: Sequence[str], fields: Sequence[str], newest: str | None = None) -> DataFrame:
    """Rows of equal ``by`` in lists ``_listed`` of their ``fields``, sorted by these, and the latest ``newest`` of each list.

    A task lists the rows it has, at most ``LISTED`` in one list, and holds a bounded number of rows; so there may be many
    lists of the same ``by``. Those columns are whole numbers or times; rows where one of them or ``newest`` is null go.
    """
    by, fields = list(by), list(fields)
    schema, most, hold = df.select(*by, *fields).schema, LISTED, HELD_ROWS
    made = [schema[c] for c in by] + ([StructField("_newest", schema[newest].dataType)] if newest else [])
    made.append(StructField("_listed", ArrayType(StructType([schema[c] for c in fields]))))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= hold:
                yield _listed(pa.Table.from_batches(held), by, fields, newest, most)
                held = []
        if any(b.num_rows for b in held):
            yield _listed(pa.Table.from_batches(held), by, fields, newest, most)

    present = df.dropna(subset=[*by, *([newest] if newest else [])]).select(*by, *fields)
    return present.mapInArrow(lists, StructType(made))


def listed_between_join(left: DataFrame, right: DataFrame, on: dict[str, str], start: str, end: str, time: str,
                        others: Sequence[str], slot: str) -> DataFrame:
    """``between_join`` by ``slot`` with the left rows of a key and slot in lists, sorted by ``others``, the columns they add.

    A right row meets a list at a time, and its pairs come one after another.
    """
    keys = list(on)
    slotted = (left.where(F.col(start) <= F.col(end)).withColumn("_low_slot", _slot(start, slot))
               .withColumn("_left_slot", _slots(F.col("_low_slot"), F.col(end), slot)))
    lists = listed(slotted.repartition(*keys, "_left_slot"), [*keys, "_left_slot"], [*others, start, end])
    condition = F.col("_left_slot") == F.col("_right_slot")
    for left_key, right_key in on.items():
        condition = condition & (F.col(left_key) == F.col(right_key))
    met = right.withColumn("_right_slot", _slot(time, slot)).join(lists, condition)
    each = met.select(*keys, *right.columns, F.inline("_listed"))
    return each.where(F.col(time).between(F.col(start), F.col(end)))


def window_join(left: DataFrame, right: DataFrame, on: dict[str, str], window: str = "window") -> DataFrame:
    """Inner join on keys and the same window; both sides keep their key columns."""
    renamed = right.withColumnRenamed(window, "_other_window")
    condition = F.col(window) == F.col("_other_window")
    for left_key, right_key in on.items():
        condition = condition & (F.col(left_key) == F.col(right_key))
    return left.join(renamed, condition, "inner").drop("_other_window")


def merged_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str,
                     slot: str = "1 day") -> DataFrame:
    """Per key, disjoint pieces that cover exactly the union of the closed intervals.

    Work is split by (key, time slot). Equal starts collapse before the shuffle, so a
    slot holds at most one row per time unit however many intervals a key has. What
    reaches into a slot from earlier ones arrives as one carried row, found by a running
    maximum over the key's slots.
    """
    keys = list(keys)
    starts = written(df.where(F.col(start) <= F.col(end))
                     .groupBy(*keys, start).agg(F.max(end).alias(end))
                     .withColumn("_slot", _slot(start, slot)))
    by_slot = Window.partitionBy(*keys).orderBy("_slot")
    earlier = by_slot.rowsBetween(Window.unboundedPreceding, -1)
    slots = (starts.groupBy(*keys, "_slot").agg(F.max(end).alias("_reach"))
             .select(*keys, "_slot", F.max("_reach").over(earlier).alias("_carried"),
                     F.lead("_slot").over(by_slot).alias("_next_slot")))
    carried = (slots.where(F.col("_carried") >= F.col("_slot"))
               .select(*keys, F.col("_slot").alias(start), F.col("_carried").alias(end), "_slot"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(start, end)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    swept = starts.unionByName(carried).select(
        *keys, "_slot", start, F.max(end).over(before).alias("_seen"),
        F.max(end).over(Window.partitionBy(*keys, "_slot")).alias("_last"))
    opening = swept.where(F.col("_seen").isNull() | (F.col(start) > F.col("_seen")))
    next_seen = F.lead("_seen").over(Window.partitionBy(*keys, "_slot").orderBy(start))
    pieces = opening.select(*keys, "_slot", start, F.coalesce(next_seen, "_last").alias(end))
    # A later slot repeats what reaches into it, so a piece ends where that slot begins.
    until = F.least(F.col(end), F.col("_next_slot") - F.expr("INTERVAL 1 MICROSECOND"))
    return (pieces.join(slots.select(*keys, "_slot", "_next_slot"), [*keys, "_slot"])
            .select(*keys, start, until.alias(end)))


def inside_intervals(points: DataFrame, pieces: DataFrame, on: dict[str, str], time: str,
                     start: str, end: str, slot: str = "1 day") -> DataFrame:
    """Points that lie in a disjoint piece with the same key, with the piece's other columns.

    ``on`` maps point columns to piece columns. A point meets at most one piece for each
    combination of the remaining piece columns, so the result grows with the points and
    not with the number of intervals. Pieces are joined by key and time slot.
    """
    kept = [c for c in pieces.columns if c not in (start, end, *on.values())]
    side = (pieces.withColumn("_first", _slot(start, slot))
            .select(*[F.col(p).alias(f"_{p}") for p in on.values()], *kept,
                    F.col(start).alias("_start"), F.col(end).alias("_end"),
                    _slots(F.col("_first"), F.col(end), slot).alias("_piece_slot")))
    condition = F.col("_slot") == F.col("_piece_slot")
    for point_key, piece_key in on.items():
        condition = condition & (F.col(point_key) == F.col(f"_{piece_key}"))
    condition = condition & F.col(time).between(F.col("_start"), F.col("_end"))
    slotted = points.withColumn("_slot", _slot(time, slot))
    return slotted.join(small_side(side), condition, "inner").select(*points.columns, *kept)
