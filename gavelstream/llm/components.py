"""Connected components of a link table, by rounds of joins with minima that Spark combines early."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Staged


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Hang each node's larger (or all smaller) neighbours on the smallest node around it."""
    around = _both_ways(links) if larger else links
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("at"), F.least("at", "m").alias("m"))
    hung = around.join(least, F.col("a") == F.col("at"))
    if larger:
        return hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return own.unionByName(least.select(F.col("at").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, staged: Staged) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every linked node.

    ``links`` has bigint columns ``a`` and ``b`` in any order, repeated or not. Large and small
    stars alternate until a round changes nothing; a node's neighbours never meet in one task,
    only their minimum does. Nodes without links are not in the result, nulls link nothing.
    """
    spark = staged.spark
    current = staged.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .where("a > b").distinct(), "links")
    before = None
    while True:
        seen = Observation()
        # Sums of digests tell whether the links of two rounds are the same set.
        digest = F.xxhash64("a", "b").cast("decimal(20,0)")
        after = _stars(_stars(current, larger=True), larger=False)
        after = staged.put(after.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(digest).alias("sum")), "links")
        staged.drop("links", keep_last=1)
        state = (seen.get.get("n"), seen.get.get("sum"))
        if not state[0]:
            return spark.createDataFrame([], "node bigint, component bigint")
        if state == before:
            break
        current, before = after, state
    # All is stars now: every node hangs on its root.
    roots = after.select("b").distinct()
    return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
