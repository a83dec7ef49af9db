"""Top-k, best-with-ties, arg-max and first-value per group, safe for hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side, written

# Up to this k Spark itself keeps only k rows per group and task before the shuffle.
GROUP_LIMIT = 1000


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group by a total order.

    Filtering on ``row_number`` lets the planner cut every group to ``k`` rows per task
    before the shuffle. Larger ``k`` gets the same cut from a salted first round.
    """
    if k > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.spark_partition_id() % 256)
        df = _first_k(salted, [*keys, "_salt"], order, k).drop("_salt")
    return _first_k(df, keys, order, k)


def _first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def best_with_ties(df: DataFrame, keys: Sequence[str], measure: str, from_scan: bool = False) -> DataFrame:
    """Rows whose measure is the largest of their group, all ties kept: rank() = 1.

    The maxima are aggregated before the shuffle and joined back, so no task ever holds
    a whole group, not even one made of ties, and few maxima mean that the rows are not
    shuffled for it. Rows that a shuffle made are written once for the two readings;
    ``from_scan`` says they come straight from a scan, which is then read twice.
    """
    rows = df if from_scan else written(df)
    best = rows.groupBy(*keys).agg(F.max(measure).alias(measure))
    return rows.join(small_side(best), [*keys, measure], "left_semi").select(*df.columns)


def ranked_with_ties(df: DataFrame, keys: Sequence[str], measure: str, k: int) -> DataFrame:
    """rank() <= k by descending measure: all rows not below the group's k-th value."""
    if k == 1:
        return best_with_ties(df, keys, measure)
    df = written(df)
    kept = top_k_per_group(df.select(*keys, measure), keys, [F.desc(measure)], k)
    floor = kept.groupBy(*keys).agg(F.min(measure).alias("_floor"))
    joined = df.join(small_side(floor), list(keys))
    return joined.where(F.col(measure) >= F.col("_floor")).select(*df.columns)


def arg_max(df: DataFrame, keys: Sequence[str | Column], values: Sequence[str],
            order: Sequence[Column]) -> DataFrame:
    """One row per group: the values at the greatest ``order``. It combines before the
    shuffle and runs on streams."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_best")
    grouped = df.groupBy(*keys).agg(best)
    names = [c for c in grouped.columns if c != "_best"]
    return grouped.select(*names, "_best.*")


def first_value(df: DataFrame, keys: Sequence[str | Column], value: str, order: Sequence[str]) -> DataFrame:
    """One row per group with the earliest value; ties fall to the smaller value."""
    earliest = F.min_by(F.col(value), F.struct(*order, value)).alias(value)
    return df.groupBy(*keys).agg(earliest)
