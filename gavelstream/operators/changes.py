"""Updating results: latest row per key, and change rows between two snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_row


def upsert_latest(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row with the greatest version per key; later rows replace earlier ones."""
    values = [c for c in df.columns if c not in keys and c not in version]
    newest = F.max_by(F.struct(*version, *values), F.struct(*version, *values)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def changelog(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``before``, ``after`` and ``op`` (c, u, d) for every key whose row differs."""
    old = before.select(*keys, F.struct(*before.columns).alias("before"))
    new = after.select(*keys, F.struct(*after.columns).alias("after"))
    op = (F.when(F.col("before").isNull(), "c")
          .when(F.col("after").isNull(), "d")
          .otherwise("u"))
    return (old.join(new, list(keys), "full_outer")
            .where(~F.col("before").eqNullSafe(F.col("after")))
            .select("before", "after", op.alias("op")))


def changelog_records(changes: DataFrame) -> DataFrame:
    """Change rows as JSON text, with nulls for an absent side."""
    return changes.select(json_row(["before", "after", "op"]).alias("value"))
