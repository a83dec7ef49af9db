"""Keyed streams whose state is in Spark's state store: last rows, window functions, user aggregates.

Each processor gets what tasks have reduced already, so a hot key is a few rows per task and micro-batch.
Event-time timers fire once the watermark has reached a window's end; what comes for a window after
that is dropped by Spark as late and counted in its progress.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators.aggregates import MergeableAggregate, finished, folded_states, partial_states
from ..session import keep_state_in_rocksdb

Order = Sequence[tuple[str, bool]]  # columns, each with whether it ascends
READ_AT_ONCE = 10_000
HELD_ROWS = 50_000
START, END = "_start", "_end"  # a window's bounds as microseconds, part of the key


def plain_row(rows: pd.DataFrame, at: int) -> tuple:
    """A row as Python values, null for what is missing."""
    values = (rows[c].iloc[at] for c in rows.columns)
    return tuple(None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else v.item() if isinstance(v, np.generic) else v
                 for v in values)


def micros(df: DataFrame) -> DataFrame:
    """Times as whole microseconds, which no session's time zone changes."""
    return df.select([F.unix_micros(F.col(f.name).cast("timestamp")).alias(f.name) if f.dataType.typeName().startswith("timestamp")
                      else F.col(f.name) for f in df.schema.fields])


# --- the last rows of each key ---

def newest(rows: pd.DataFrame, key: str, order: Order, last: int) -> pd.DataFrame:
    """The first ``last`` rows per key in this order; nulls first where it ascends, else last."""
    by = []
    for c, up in order:
        missing, values = rows[c].isna().to_numpy(), rows[c].to_numpy()
        values = values if values.dtype.kind == "i" else np.where(missing, 0, values).astype("float64")
        by += [~missing, values] if up else [missing, ~values if values.dtype.kind == "i" else -values]
    ranked = rows.iloc[np.lexsort(by[::-1])]
    return ranked.groupby(key, sort=False, dropna=False).head(last)


def newest_of_task(batches: Iterator[pd.DataFrame], key: str, order: Order, last: int) -> Iterator[pd.DataFrame]:
    """About ``last`` rows per key and task; a task holds a bounded number of rows."""
    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count > HELD_ROWS:
            held = [newest(pd.concat(held, ignore_index=True), key, order, last)]
            count = len(held[0])
            if count > HELD_ROWS // 2:
                yield held.pop()
                count = 0
    if count:
        yield newest(pd.concat(held, ignore_index=True), key, order, last)


class LastRows(StatefulProcessor):
    """A list of the last rows of a key; every change gives the average of one column."""

    def __init__(self, schema: StructType, key: str, order: Order, value: str, last: int, ttl_ms: int | None):
        self.schema, self.key, self.last, self.ttl_ms = schema, key, last, ttl_ms
        self.order = [(schema.fieldNames().index(c), up) for c, up in order]
        self.value = schema.fieldNames().index(value)

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", self.schema, self.ttl_ms)

    def _place(self, row: tuple) -> list:
        """Nulls first where the order ascends, else last."""
        return [(row[i] is not None, row[i] or 0) if up else (row[i] is None, -(row[i] or 0)) for i, up in self.order]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = sorted([tuple(r) for some in (self.rows.get(), rows) for r in some], key=self._place)[:self.last]
        self.rows.put(held)
        values = [r[self.value] for r in held if r[self.value] is not None]
        yield Row(**{self.key: key[0], "average": sum(values) / len(values) if values else None})

    def close(self) -> None:
        pass


def last_rows(rows: DataFrame, key: str, order: Order, value: str, last: int, ttl: str | None = None) -> DataFrame:
    """``key`` and ``average`` of the ``value`` of each key's last rows, for every key that a micro-batch changes.

    Columns are whole numbers and times. State is ``last`` rows per key, with ``ttl`` no longer than that after a
    key's last change. A task passes on no more than ``last`` rows of a key from ``HELD_ROWS`` of its rows.
    """
    keep_state_in_rocksdb(rows.sparkSession)
    plain = micros(rows)
    cut = plain.mapInPandas(lambda batches: newest_of_task(batches, key, order, last), plain.schema)
    ttl_ms = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)
    kind = plain.schema[key].dataType.simpleString()
    return cut.groupBy(key).transformWithState(
        LastRows(plain.schema, key, order, value, last, ttl_ms), f"`{key}` {kind}, average double", "Update",
        "None" if ttl is None else "ProcessingTime")


# --- windows that close by a timer ---

def _close_at(handle, end: int, watermark_ms: int) -> bool:
    """Set the timer of a window's end; false if the window is closed already."""
    ends_ms = -(-end // 1000)
    if ends_ms <= watermark_ms:
        return False
    handle.registerTimer(ends_ms)
    return True


class WindowProcess(StatefulProcessor):
    """The elements of a key and window in a list, handed to a user's function when the window closes."""

    def __init__(self, names: list[str], elements: StructType, function: Callable, results: list[str]):
        self.names, self.elements, self.function, self.results = names, elements, function, results

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getListState("elements", self.elements)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if _close_at(self.handle, key[-1], timerValues.getCurrentWatermarkInMs()):
            for some in rows:
                some = some[self.elements.fieldNames()]
                self.held.appendList([plain_row(some, i) for i in range(len(some))])
        return iter(())

    def _chunks(self) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for row in self.held.get():
            held.append(row)
            if len(held) == READ_AT_ONCE:
                yield pd.DataFrame(held, columns=self.elements.fieldNames())
                held = []
        if held:
            yield pd.DataFrame(held, columns=self.elements.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, end = pd.Timestamp(key[-2], unit="us"), pd.Timestamp(key[-1], unit="us")
        for made in self.function(tuple(key[:-2]), start, end, self._chunks()):
            if len(made):
                yield made[self.results]
        self.held.clear()

    def close(self) -> None:
        pass


EVENT_TIME = {"spark.watermarkDelayMs": 0}  # Spark's mark of a column that the watermark judges


def _by_window(rows: DataFrame, keys: Sequence[str]):
    """Rows of (key, window) with the bounds as ``START`` and ``END``, grouped.

    What a Python step returns has lost the mark of its event time. The window's end gets it back, so that Spark drops and
    counts what comes for a closed window as it does for its own windowed aggregates.
    """
    bounds = {START: F.unix_micros("window_start"), END: F.unix_micros("window_end")}
    return rows.withMetadata("window_end", EVENT_TIME).withColumns(bounds).groupBy(*keys, START, END)


def _key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def _with_bounds(df: DataFrame, keys: Sequence[str], others: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.timestamp_micros(START).alias("window_start"), F.timestamp_micros(END).alias("window_end"), *others)


def _with_micros(windowed: DataFrame) -> DataFrame:
    """The bounds as whole microseconds, for steps in Python."""
    return windowed.withColumns({START: F.unix_micros("window_start"), END: F.unix_micros("window_end")}).drop("window_start", "window_end")


def _of_closed(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The rows of each window that closes, those of a key and window one after another.

    Spark's own windowed aggregate keeps them as a list per key and open window, and drops and counts what comes for a closed
    one. Tasks have reduced the rows, so a list is as long as there were tasks and micro-batches that met the key.
    """
    ends = F.timestamp_micros(END).alias("_ends", metadata=EVENT_TIME)
    lists = rows.select("*", ends).groupBy(*keys, START, "_ends").agg(F.collect_list(F.struct(*fields)).alias("_held"))
    return lists.select(*keys, START, F.unix_micros("_ends").alias(END), F.inline("_held"))


def window_states(windowed: DataFrame, keys: Sequence[str], function: MergeableAggregate) -> DataFrame:
    """A user aggregate per key and window, emitted when the window closes.

    ``windowed`` has ``window_start`` and ``window_end`` and comes from a watermarked stream. Tasks make states of their rows;
    the state store holds these per key and open window, and a task merges and finishes those of many closed windows at once.
    """
    keep_state_in_rocksdb(windowed.sparkSession)
    keys = list(keys)
    by = [*keys, START, END]
    states = partial_states(_with_micros(windowed), by, function)
    closed = folded_states(_of_closed(states, keys, StructType.fromDDL(function.state).fieldNames()), by, function)
    return _with_bounds(finished(closed, by, function), keys, StructType.fromDDL(function.result).fieldNames())


def window_process(windowed: DataFrame, keys: Sequence[str], elements: str, function: Callable, result: str) -> DataFrame:
    """A user's function over all elements of a key and window, called once when the window closes.

    ``function(key, start, end, elements)`` gets the key's values, the window's bounds and an iterator of frames with the
    columns ``elements`` (DDL), and yields any number of frames with the columns ``result`` (DDL).
    """
    keep_state_in_rocksdb(windowed.sparkSession)
    keys, schema = list(keys), StructType.fromDDL(elements)
    return _by_window(windowed, keys).transformWithStateInPandas(
        WindowProcess(keys, schema, function, StructType.fromDDL(result).fieldNames()), result, "Append", "EventTime")


def reduced_window_process(windowed: DataFrame, keys: Sequence[str], elements: str, reduce: Callable[[pd.DataFrame], pd.DataFrame],
                           function: Callable[[pd.DataFrame], pd.DataFrame], result: str) -> DataFrame:
    """A user's function over the elements of many closed windows at once, for elements that tasks can reduce first.

    ``reduce`` gets a frame of the key, the bounds and the input's columns, as a task reads them, and returns fewer rows of the
    key, the bounds and ``elements`` (DDL). ``function`` gets frames of such rows, all those of a key and window in one
    frame, and returns one with the columns ``result`` (DDL).
    """
    keep_state_in_rocksdb(windowed.sparkSession)
    keys, schema, names = list(keys), StructType.fromDDL(elements), StructType.fromDDL(result).fieldNames()
    by, bounds = [*keys, START, END], {START: "window_start", END: "window_end"}

    def with_times(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**{c: pd.to_datetime(rows[c], unit="us") for c in bounds}).rename(columns=bounds)

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                made = reduce(with_times(batch)).rename(columns={v: k for k, v in bounds.items()})
                yield made.assign(**{c: made[c].astype("datetime64[us]").astype("int64") for c in bounds})

    def process(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _whole_groups(batches, by):
            yield function(with_times(whole))[names]

    flat = _with_micros(windowed)
    parts = flat.mapInPandas(reduced, f"{_key_ddl(flat, by)}{elements}")
    return _of_closed(parts, keys, schema.fieldNames()).mapInPandas(process, result)


def _whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Frames cut so that rows of a key, which come one after another, stay together."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = batch[by].iloc[-1]
        goes_on = ((batch[by] == last) | (batch[by].isna() & last.isna())).all(axis=1).to_numpy()
        begins = len(batch) if not goes_on.any() else len(batch) - int(np.argmin(goes_on[::-1])) if not goes_on.all() else 0
        if begins:
            yield pd.concat([*held, batch.iloc[:begins]], ignore_index=True)
            held = []
        held.append(batch.iloc[begins:])
    if held:
        yield pd.concat(held, ignore_index=True)
