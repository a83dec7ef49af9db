"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search over it.

A query starts at its own node and at the nearest of a few entry nodes. Each step looks at the
neighbours of all nodes in its beam that were not looked at yet and keeps the nearest; it ends
when the whole beam was. All queries step together, in joins with the graph. Graph and beam are
ordered by the unrounded components, so that very near copies are told apart; what the beam holds
is scored in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged
from .neighbours import SEED, build, edges, packed, restored, squared, usable, whole

K, ROUNDS = 24, 5
BEAM = 160
ENTRIES, STARTS = 64, 8


def _distances(rows: DataFrame, codes: DataFrame, asked: DataFrame) -> DataFrame:
    """``query``, ``node`` with their approximate squared ``dist``."""
    there = codes.select(F.col("id").alias("node"), "q", "scale")
    here = asked.select(F.col("id").alias("query"), F.col("q").alias("qq"), F.col("scale").alias("qscale"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = restored(batch.column(2), batch.column(3)) - restored(batch.column(4), batch.column(5))
                dist = np.einsum("ij,ij->i", apart, apart).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dist)], names=["query", "node", "dist"])

    full = rows.join(there, "node").join(here, "query").select("query", "node", "q", "scale", "qq", "qscale")
    return full.mapInArrow(measure, "query bigint, node bigint, dist float")


def _entered(codes: DataFrame, asked: DataFrame) -> DataFrame:
    """Each query's nearest of the entry nodes, a fixed number of nodes of smallest digest."""
    top = codes.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(ENTRIES).toArrow()
    ids = top.column("id").to_numpy()
    x = restored(top.column("q").combine_chunks(), top.column("scale").combine_chunks()) if len(ids) else None

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = squared(restored(batch.column(1), batch.column(2)), x)
                near = np.argsort(d, axis=1, kind="stable")[:, :STARTS]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(np.arange(len(d)), near.shape[1]))), pa.array(ids[near.ravel()]),
                     pa.array(np.take_along_axis(d, near, axis=1).ravel().astype(np.float32))], names=["query", "node", "dist"])

    return asked.select("id", "q", "scale").mapInArrow(nearest, "query bigint, node bigint, dist float")


def search(codes: DataFrame, lists: DataFrame, asked: DataFrame, staged: Staged, beam: int = BEAM) -> DataFrame:
    """``query``, ``node``, ``dist`` (approximate) of the ``beam`` nearest nodes found for each query.

    ``asked`` are codes of the queries, all of them nodes of the graph.
    """
    forward = edges(lists).select(F.col("id").alias("node"), F.col("nbr").alias("next"))
    graph = staged.put(forward.unionByName(forward.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct(), "graph")
    own = asked.select(F.col("id").alias("query"), F.col("id").alias("node"), F.lit(0.0).cast("float").alias("dist"))
    nearest = Window.partitionBy("query").orderBy("dist", "node")
    held = own.unionByName(_entered(codes, asked).where("query != node")).withColumn("done", F.lit(False))
    held = staged.put(held, "beam")
    while True:
        front = held.where("NOT done").select("query", "node")
        if front.isEmpty():
            break
        seen = held.select("query", "node")
        found = front.join(graph, "node").select("query", F.col("next").alias("node")).distinct()
        found = _distances(found.join(seen, ["query", "node"], "left_anti"), codes, asked)
        both = held.withColumn("done", F.lit(True)).unionByName(found.withColumn("done", F.lit(False)))
        held = staged.put(both.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= beam).drop("n"), "beam")
        staged.drop("beam", keep_last=1)
    return held.select("query", "node", "dist")


def euclidean(rows: DataFrame, one: str, other: str, out: str = "score") -> DataFrame:
    """Add the distance of two array<double> columns, in double precision; the arrays go."""
    kept = [c for c in rows.columns if c not in (one, other)]
    schema = rows.select(*kept).schema.add(out, "double")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = packed(batch.column(len(kept))) - packed(batch.column(len(kept) + 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(np.sqrt(np.einsum("ij,ij->i", apart, apart)))],
                                                 names=schema.fieldNames())

    return rows.select(*kept, one, other).mapInArrow(measure, schema)


def nearest(df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", top: int = 10,
            k: int = K, beam: int = BEAM) -> DataFrame:
    """``query_id``, ``rank``, the id of the neighbour and ``score`` (distance) for the queries among the rows.

    ``is_query`` is a condition on the column ``id`` of long ids. The ``top`` nearest found by
    Euclidean distance, all other rows if there are fewer, ties to the smaller id. Equal vectors
    are one node; their ids come back in order. Rows without id and vectors that are null, empty,
    zero, of unusual length or hold null or non-finite components take no part, neither as query
    nor as candidate. Ids are expected to be distinct; rows repeated whole count once. Other
    columns are not read. The graph is fitted on all rows; only its trees see a bounded sample.
    """
    staged = Staged(df.sparkSession, "ann")
    rows = usable(df, id, vector).distinct()
    # A class holds the ids of equal vectors; of many only the smallest can be among the nearest.
    by_vector = Window.partitionBy("v").orderBy("id")
    nodes = staged.put(rows.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"), "nodes")
    codes = staged.put(whole(nodes), "codes")
    lists = build(codes, k, ROUNDS, staged)
    members = (rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= top + 1)
               .join(nodes.withColumnRenamed("id", "node"), "v").select("node", F.col("id").alias("vec_id")))
    members = staged.put(members, "members")
    queries = staged.put(rows.where(is_query).join(nodes.withColumnRenamed("id", "node"), "v").select("node", F.col("id").alias("query_id")), "queries")
    asked = codes.join(queries.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    asked = staged.put(asked, "asked")
    held = search(codes, lists, asked, staged, beam)
    scored = euclidean(held.select("query", "node").join(nodes.select(F.col("id").alias("node"), F.col("v").alias("there")), "node")
                       .join(nodes.select(F.col("id").alias("query"), F.col("v").alias("here")), "query"), "here", "there")
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    best = (scored.join(members, "node").withColumn("n", F.row_number().over(order)).where(F.col("n") <= top + 1)
            .select(F.col("query").alias("node"), "vec_id", "score"))
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (queries.join(best, "node").where("query_id != vec_id").withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"))
