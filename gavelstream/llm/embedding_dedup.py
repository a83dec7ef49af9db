"""Near-duplicate vectors by a neighbour graph: the links of its lists that reach a cosine, and their components.

A list all of whose places are that near is saturated: there may be more. Such nodes and their
neighbours get a graph of their own with lists twice as long, again while that helps. Nodes that stay
saturated are compared exactly across components: they fall into cells with a centre and a radius,
and pairs of cells too far apart by the triangle inequality for any link are skipped. What is linked is
then completed exactly: within each component every pair is compared, tile by tile, and counted
where it is compared. A brute-force audit of some vectors, half of them those whose lists begin
nearest, measures the recall of links, and of nearest vectors where links are few; where it falls short, the
graph goes on from other trees with longer lists, and at last all nodes are compared by cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, quoted
from .components import components
from .neighbours import SEED, build, edges, leaf_of, packed, quantised, usable

K, ROUNDS, TREES = 12, 4, 8
ENLARGEMENTS = 2  # nodes saturated beyond that are compared exactly by cells
MARGIN = 0.03  # of squared distance between bytes, so that no true link is lost to rounding
TILE = 1024
CELLS = 512  # whose centres are compared at once
ROUNDING = 1e-6  # of distances between unit vectors, centres and radii in double precision, amply
AUDITED, WANTED, PASSES = 128, 0.99, 3
# With fewer linked vectors in the audit, this share of nearest vectors must be in the lists. Links are much
# nearer than what is merely nearest: a list that holds the half of those is a graph at work.
LINKED, WANTED_NEAREST = 32, 0.5
UNSURE = 1e-12  # products of matrices and of single pairs round differently


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the unit vectors of each row."""
    return np.einsum("ij,ij->i", x, y)


def _reaches(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit vectors reach the cosine, as ``_cosines`` tells of each pair alone."""
    cosine = x @ y.T
    near = cosine >= threshold
    a, b = np.nonzero(np.abs(cosine - threshold) < UNSURE)
    near[a, b] = _cosines(x[a], y[b]) >= threshold
    return near


def _near_places(lists: DataFrame, threshold: float) -> DataFrame:
    return edges(lists).where(F.col("dist") <= 2 - 2 * threshold + MARGIN)


def _saturated(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    return lists.where((F.size("nbrs") >= k) & (F.try_element_at("dists", F.lit(-1)) <= 2 - 2 * threshold + MARGIN))


def _enlarged(codes: DataFrame, lists: DataFrame, k: int, threshold: float, staged: Staged) -> tuple[list[DataFrame], DataFrame]:
    """Further lists for the saturated parts of the graph, and the ``id`` of what stays saturated in the last."""
    found = []
    for step in range(ENLARGEMENTS):
        full = _saturated(lists, k, threshold)
        around = full.select(F.explode("nbrs").alias("id")).unionByName(full.select("id")).distinct()
        part = staged.put(codes.join(around, "id", "left_semi"), f"part{step}")
        if part.isEmpty():
            break
        k *= 2
        lists = build(part, k, 1, staged, trees=2, seed=SEED + 100 + step, key=f"lists{step}")
        found.append(lists)
    return found, _saturated(lists, k, threshold).select("id")


def _links(places: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The places whose vectors reach the cosine in double precision."""
    pairs = places.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()
    full = (pairs.join(nodes.select(F.col("id").alias("a"), F.col("v").alias("one")), "a")
            .join(nodes.select(F.col("id").alias("b"), F.col("v").alias("other")), "b").select("a", "b", "one", "other"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = _cosines(_unit(packed(batch.column(2))), _unit(packed(batch.column(3))))
                near = pa.array(np.flatnonzero(cosine >= threshold))
                yield pa.RecordBatch.from_arrays([c.take(near) for c in batch.columns[:2]], names=["a", "b"])

    return full.mapInArrow(check, "a bigint, b bigint")


def _bridges(some: DataFrame, codes: DataFrame, nodes: DataFrame, found: DataFrame, threshold: float, staged: Staged) -> DataFrame | None:
    """Links ``a``, ``b`` that connect all components with a link between nodes of ``some`` (``id``); None if there is nothing to compare.

    Every pair of these nodes in different components is compared in double precision, but for pairs of
    cells whose centres are farther apart than their radii and the link's distance allow. A pair of cells
    returns one link for each pair of components.
    """
    some = staged.put(some, "some")
    total = some.count()
    if total < 2:
        return None
    leaves = leaf_of(codes.join(some, "id", "left_semi"), total)
    sizes = leaves.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("cuts"))
    cell = F.xxhash64("leaf", F.pmod(F.xxhash64("id"), F.col("cuts")))
    rows = (leaves.join(sizes, "leaf").select("id", cell.alias("cell")).join(nodes.select("id", "v"), "id")
            .join(found, F.col("id") == F.col("node"), "left").select("cell", "id", "v", F.coalesce("component", "id").alias("component")))
    rows = staged.put(rows, "celled")
    reach = np.sqrt(2 - 2 * threshold) + ROUNDING

    def bound(table: pa.Table) -> pa.Table:
        x = _unit(packed(table.column("v").combine_chunks()))
        centre, component = x.mean(axis=0), table.column("component").to_numpy()
        return pa.table({"cell": table.column("cell")[:1], "centre": pa.array([centre.tolist()], pa.list_(pa.float64())),
                         "radius": [float(np.linalg.norm(x - centre, axis=1).max())], "low": [component.min()], "high": [component.max()]})

    cells = staged.put(rows.groupBy("cell").applyInArrow(bound, "cell bigint, centre array<double>, radius double, low bigint, high bigint"), "cells")
    blocks = -(-cells.count() // CELLS)
    own = F.pmod(F.xxhash64("cell", F.lit(SEED)), F.lit(blocks))
    dealt = cells.withColumn("c", own).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    dealt = dealt.select(F.least("c", F.col("o").cast("bigint")).alias("i"), F.greatest("c", F.col("o").cast("bigint")).alias("j"),
                         (F.col("c") > F.col("o")).cast("int").alias("side"), "cell", "centre", "radius", "low", "high")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        cell, radius, low, high, side = (table.column(c).to_numpy() for c in ("cell", "radius", "low", "high", "side"))
        x = packed(table.column("centre").combine_chunks())
        same = key[0].as_py() == key[1].as_py()
        left, right = (np.arange(len(cell)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        one, other = [], []
        for a in left:
            near = np.linalg.norm(x[right] - x[a], axis=1) <= radius[a] + radius[right] + reach
            # A pair of cells that lie in one component has no bridge.
            near &= (low[a] != high[a]) | (low[right] != high[right]) | (low[a] != low[right])
            if same:
                near &= right >= a
            one.append(np.repeat(cell[a], near.sum()))
            other.append(cell[right[near]])
        return pa.table({"one": np.concatenate([np.array([], np.int64), *one]), "other": np.concatenate([np.array([], np.int64), *other])})

    pairs = staged.put(dealt.groupBy("i", "j").applyInArrow(meet, "one bigint, other bigint").select(
        F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")), "pairs")
    if pairs.isEmpty():
        return None
    content = rows.select(F.col("cell"), "id", "v", "component")
    left = pairs.join(content, F.col("one") == F.col("cell")).select("one", "other", F.lit(0).alias("side"), "id", "v", "component")
    right = pairs.where("one != other").join(content, F.col("other") == F.col("cell")).select("one", "other", F.lit(1).alias("side"), "id", "v", "component")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        node, component, side = (table.column(c).to_numpy() for c in ("id", "component", "side"))
        x = _unit(packed(table.column("v").combine_chunks()))
        same = key[0].as_py() == key[1].as_py()
        left, right = (np.arange(len(node)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        a, b = np.nonzero(_reaches(x[left], x[right], threshold) & (component[left][:, None] != component[right][None, :]))
        a, b = left[a], right[b]
        ends = np.stack([np.minimum(component[a], component[b]), np.maximum(component[a], component[b])])
        first = np.unique(ends, axis=1, return_index=True)[1] if len(a) else np.array([], np.int64)
        return pa.table({"a": node[a[first]], "b": node[b[first]]})

    return left.unionByName(right).groupBy("one", "other").applyInArrow(compare, "a bigint, b bigint")


def _counted(nodes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """``node``, ``near``: how many vectors of its component reach the cosine, itself and its equals included.

    A component beyond a tile is cut, and each pair of its tiles is a group; small ones share groups.
    """
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    rows = (found.join(sizes, "component").join(nodes, F.col("node") == F.col("id"))
            .select("component", "node", "v", "n", F.ceil(F.col("size") / TILE).cast("int").alias("cuts")))
    total = found.count()
    small = rows.where("cuts = 1").select(
        F.lit(-1).cast("bigint").alias("whole"), F.pmod(F.xxhash64("component"), F.lit(total // TILE + 1)).alias("i"), F.lit(-1).cast("bigint").alias("j"),
        "component", "node", "v", "n", F.lit(0).alias("side"))
    cut = F.pmod(F.xxhash64("node"), F.col("cuts"))
    large = rows.where("cuts > 1").withColumn("c", cut).select("*", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("o"))
    large = large.select(F.col("component").alias("whole"), F.least("c", "o").alias("i"), F.greatest("c", F.col("o").cast("bigint")).alias("j"),
                         "component", "node", "v", "n", (F.col("c") > F.col("o")).cast("int").alias("side"))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        component, node, n, side = (table.column(c).to_numpy() for c in ("component", "node", "n", "side"))
        x = _unit(packed(table.column("v").combine_chunks()))
        near = np.zeros(len(node), np.int64)
        if key[0].as_py() == -1:
            order = np.argsort(component, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
                near[rows] = _reaches(x[rows], x[rows], threshold) @ n[rows]
        elif key[1].as_py() == key[2].as_py():
            near = _reaches(x, x, threshold) @ n
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            same = _reaches(x[left], x[right], threshold)
            near[left], near[right] = same @ n[right], same.T @ n[left]
        return pa.table({"node": node, "near": near})

    parts = small.unionByName(large).groupBy("whole", "i", "j").applyInArrow(count, "node bigint, near bigint")
    return parts.groupBy("node").agg(F.sum("near").alias("near"))


class Audit(NamedTuple):
    """What brute force over all vectors says of some."""
    sampled: int  # vectors drawn at random, and as many whose lists begin nearest
    linked: int  # of these, those with any true link
    recall: float | None  # share of its true links that was counted for a linked vector, on average; None if none was seen
    nearest: float  # share of the vectors drawn at random whose list holds their nearest vector

    @property
    def passed(self) -> bool:
        """Links decide where enough were seen; where few or none were, the lists must also hold the nearest vectors."""
        return (self.recall is None or self.recall >= WANTED) and (self.linked >= LINKED or self.nearest >= WANTED_NEAREST)


def _audited(nodes: DataFrame, lists: DataFrame, near: DataFrame, threshold: float) -> Audit:
    """Measured on ``AUDITED`` vectors drawn at random and as many more whose lists begin at the least distance:
    where links are rare, those are the ones to have them. A large group does not outweigh the small ones."""
    drawn = nodes.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(AUDITED).select("id").withColumn("random", F.lit(True))
    close = (lists.select("id", F.get("dists", F.lit(0)).alias("first")).where("first IS NOT NULL").orderBy("first", F.xxhash64("id", F.lit(SEED)), "id")
             .limit(AUDITED).select("id").withColumn("random", F.lit(False)))
    chosen = drawn.unionByName(close).groupBy("id").agg(F.max("random").alias("random"))
    some = nodes.join(F.broadcast(chosen), "id").select("id", "v", "n", "random").toArrow()
    if some.num_rows < 2:
        return Audit(some.num_rows, 0, None, 1.0)
    ids, x = some.column("id").to_numpy(), _unit(packed(some.column("v").combine_chunks()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, best, nearest = np.zeros(len(ids), np.int64), np.full(len(ids), -2.0), np.full(len(ids), -1, np.int64)
        for batch in batches:
            if batch.num_rows:
                other, y = batch.column(0).to_numpy(), _unit(packed(batch.column(1)))
                total += _reaches(x, y, threshold) @ batch.column(2).to_numpy()
                cosine = np.where(other[None, :] == ids[:, None], -2.0, x @ y.T)
                first = cosine.argmax(axis=1)
                here = cosine[np.arange(len(ids)), first]
                nearest, best = np.where(here > best, other[first], nearest), np.maximum(here, best)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, total, best, nearest)], names=["node", "true", "best", "nearest"])

    true = nodes.select("id", "v", "n").mapInArrow(compare, "node bigint, true bigint, best double, nearest bigint").groupBy("node").agg(
        F.sum("true").alias("true"), F.max(F.struct("best", "nearest")).getField("nearest").alias("nearest"))
    own = nodes.select(F.col("id").alias("node"), "n").join(F.broadcast(chosen.withColumnRenamed("id", "node")), "node")
    held = lists.select(F.col("id").alias("node"), "nbrs")
    counted = true.join(own, "node").join(near, "node", "left").join(held, "node", "left")
    has, random = F.col("true") > F.col("n"), F.col("random")
    share = (F.coalesce("near", "n") - F.col("n")) / (F.col("true") - F.col("n"))
    hit = F.coalesce(F.array_contains("nbrs", F.col("nearest")), F.lit(False)).cast("double")
    return Audit(*counted.agg(F.count(F.lit(1)), F.count_if(has), F.avg(F.when(has, share)), F.coalesce(F.avg(F.when(random, hit)), F.lit(0.0))).first())


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95,
                    k: int = K, audits: list[Audit] | None = None) -> DataFrame:
    """``id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Links are pairs of different rows whose cosine in double precision reaches the threshold; a
    component's id is the smallest id that links reach, and its row is kept. Equal vectors are one
    node that counts for all its rows. Rows without id and vectors that are null, empty, zero, of
    unusual length or hold null or non-finite components link with nothing and are kept. Ids are
    expected to be distinct. An empty table gives an empty result; other columns are not read.
    The audit of every pass is added to ``audits``.
    """
    staged = Staged(df.sparkSession, "near")
    rows = usable(df, id, vector)
    nodes = staged.put(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "v", "n"), "nodes")
    codes = staged.put(quantised(nodes, unit=True), "codes")
    lists = None

    def joined_by(found: DataFrame, some: DataFrame) -> DataFrame:
        bridges = _bridges(some, codes, nodes, found, threshold, staged)
        if bridges is None:
            return found
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return staged.put(components(stars.unionByName(bridges), staged), "found")

    for number in range(PASSES):
        lists = build(codes, k, ROUNDS, staged, TREES, SEED + number, lists)
        places = _near_places(lists, threshold)
        longer, rest = _enlarged(codes, lists, k, threshold, staged)
        for more in longer:
            places = places.unionByName(_near_places(more, threshold))
        found = staged.put(components(_links(places, nodes, threshold), staged), "found")
        found = joined_by(found, rest)
        near = staged.put(_counted(nodes, found, threshold), "near")
        audit = _audited(nodes, lists, near, threshold)
        if audits is not None:
            audits.append(audit)
        if audit.passed:
            break
        k *= 2
    else:
        # The graph does not do: every pair of nodes is compared, but for cells that are too far apart.
        found = joined_by(found, nodes.select("id"))
        near = staged.put(_counted(nodes, found, threshold), "near")
    classes = (nodes.join(found, F.col("id") == F.col("node"), "left").drop("node")
               .join(near, F.col("id") == F.col("node"), "left")
               .select(F.col("v").alias("of"), F.coalesce("component", "id").alias("component_id"),
                       (F.coalesce("near", "n") - 1).alias("n_links")))
    all_rows = df.select(quoted(id).cast("bigint").alias("id"), quoted(vector).cast("array<double>").alias("v"))
    joined = all_rows.join(classes, (F.col("v") == F.col("of")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                         component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
