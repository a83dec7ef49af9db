"""Event-time windows: tumbling and hopping counts, distinct rows, window context."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = "window"


def tumble(time: str, size: str) -> Column:
    return F.window(F.col(time), size).alias(WINDOW)


def hop(time: str, slide: str, size: str) -> Column:
    """Hopping window with the slide first, the order the SQL function takes."""
    return F.window(F.col(time), size, slide).alias(WINDOW)


def window_count(df: DataFrame, keys: Sequence[str], window: Column, name: str) -> DataFrame:
    """Rows per key and window. Counting starts before the shuffle, so a hot key costs
    each task one row per window."""
    return df.groupBy(*keys, window).agg(F.count("*").alias(name))


def hop_count(df: DataFrame, keys: Sequence[str], time: str, slide: str, size: str, name: str) -> DataFrame:
    """Rows per key and hopping window, counted per slide first.

    Every row lies in size/slide windows. Counting by slide-wide panes before the copies
    are made copies one row per key and pane, not every row; it pays where keys repeat
    within a slide. Streams, and sizes that are no whole number of slides, count directly.
    """
    if df.isStreaming or pd.Timedelta(size) % pd.Timedelta(slide):
        return window_count(df, keys, hop(time, slide, size), name)
    pane = F.window(F.col(time), slide)["start"].alias("_pane")
    panes = df.groupBy(*keys, pane).agg(F.count("*").alias("_rows"))
    return panes.groupBy(*keys, hop("_pane", slide, size)).agg(F.sum("_rows").alias(name))


def distinct_per_window(df: DataFrame, columns: Sequence[str], window: Column) -> DataFrame:
    """Distinct rows of each window; the time column goes, which a stream needs."""
    return df.select(*columns, window).dropDuplicates([*columns, WINDOW])


def window_bounds(df: DataFrame) -> DataFrame:
    """The window struct as ``window_start`` and ``window_end`` columns."""
    others = [c for c in df.columns if c != WINDOW]
    return df.select(*others, F.col(f"{WINDOW}.start").alias("window_start"),
                     F.col(f"{WINDOW}.end").alias("window_end"))


def closed_windows(df: DataFrame, newest: Column, lateness: str = "5 seconds") -> DataFrame:
    """Windows that a stream with this newest event time has already emitted."""
    return df.where(F.col("window_end") <= newest - F.expr(f"INTERVAL {lateness}"))
