"""Two-level aggregation, user-defined mergeable aggregates, window process functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame


def two_level(df: DataFrame, inner_keys: Sequence[str], inner: Sequence[Column],
              outer_keys: Sequence[str], outer: Sequence[Column]) -> DataFrame:
    """Aggregate by the inner keys, then aggregate those rows by the outer keys."""
    return df.groupBy(*inner_keys).agg(*inner).groupBy(*outer_keys).agg(*outer)


class MergeableAggregate:
    """A user-defined aggregate: rows become states, states merge, a state gives a result.

    ``state`` and ``result`` are Spark DDL column lists. Each method gets pandas data and
    returns a frame; merging must not depend on order.
    """

    state: str
    result: str

    def add(self, groups) -> pd.DataFrame:
        """One state row per group of input rows (a pandas groupby)."""
        raise NotImplementedError

    def merge(self, groups) -> pd.DataFrame:
        """One state row per group of state rows (a pandas groupby)."""
        raise NotImplementedError

    def finish(self, states: pd.DataFrame) -> pd.DataFrame:
        """One result row per state row, same index."""
        raise NotImplementedError


HELD_STATES = 100_000


def _key_ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def _merge(states: list[pd.DataFrame], keys: list[str], function: MergeableAggregate) -> pd.DataFrame:
    rows = pd.concat(states, ignore_index=True)
    return function.merge(rows.groupby(keys, sort=False, dropna=False)).reset_index()


def partial_states(df: DataFrame, keys: Sequence[str], function: MergeableAggregate) -> DataFrame:
    """Keys and states, about one per key and task: a task folds its rows batch by batch and holds a
    bounded number of states."""
    keys = list(keys)

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = 0
        for batch in batches:
            if batch.empty:
                continue
            held.append(function.add(batch.groupby(keys, sort=False, dropna=False)).reset_index())
            count += len(held[-1])
            if count > HELD_STATES:
                held = [_merge(held, keys, function)]
                count = len(held[0])
                if count > HELD_STATES // 2:
                    yield held.pop()
                    count = 0
        if held:
            yield _merge(held, keys, function)

    return df.mapInPandas(combine, f"{_key_ddl(df, keys)}, {function.state}")


def folded_states(states: DataFrame, keys: Sequence[str], function: MergeableAggregate) -> DataFrame:
    """One state per key, of states that come with those of a key one after another: no group is gathered whole."""
    keys = list(keys)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            states = _merge([*open_key, batch], keys, function)
            # The last key of a batch may go on in the next one.
            open_key = [states.tail(1)]
            if len(states) > 1:
                yield states.head(-1)
        if open_key:
            yield open_key[0]

    return states.mapInPandas(fold, f"{_key_ddl(states, keys)}, {function.state}")


def merged_states(states: DataFrame, keys: Sequence[str], function: MergeableAggregate) -> DataFrame:
    """One state per key; states are sorted by key and folded as they come."""
    return folded_states(states.repartition(*keys).sortWithinPartitions(*keys), keys, function)


def finished(states: DataFrame, keys: Sequence[str], function: MergeableAggregate) -> DataFrame:
    """The result of each state."""
    keys = list(keys)

    def result(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                yield pd.concat([batch[keys], function.finish(batch)], axis=1)

    return states.mapInPandas(result, f"{_key_ddl(states, keys)}, {function.result}")


def aggregate_with(df: DataFrame, keys: Sequence[str], function: MergeableAggregate) -> DataFrame:
    """Apply a user-defined aggregate per key: states per task, one shuffle of them, results."""
    return finished(merged_states(partial_states(df, keys, function), keys, function), keys, function)


def process_windows(aggregated: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame],
                    schema: str) -> DataFrame:
    """Pass aggregated (key, window) rows, with window bounds, to a pandas function.

    The function may return none, one or several rows per input row. It sees batches of
    already aggregated rows, on a stream those of windows that have just closed.
    """
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return aggregated.mapInPandas(each, schema)
