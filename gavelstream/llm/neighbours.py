"""Neighbour graphs by NN-descent, in Spark joins over bounded groups.

Every vector starts with the nearest ones of its leaves in a few random projection trees. Each
round then brings together, at every node, its neighbours and those it is a neighbour of, and
compares them with each other: neighbours of neighbours are likely to be neighbours. Pairs with
at least one side new in a list are compared, once; a pair that improves neither list is dropped
where it was compared. Vectors travel as codes: one byte per component and a scale, which orders all
but very near copies, or the components as they are, which orders those too; whoever reads the graph
scores exactly on the original vectors.

A node with many reverse neighbours is cut into groups of bounded size, dealt anew each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import Staged, quoted

SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32_000_000  # what the trees are fitted on, at most
LEAF, TREES, SEED = 256, 8, 11
GROUP = 96  # members that are compared at one node at once
ENOUGH = 0.01  # rounds end when fewer than this share of all list places changed

LISTS = "id bigint, nbrs array<bigint>, dists array<float>, fresh array<boolean>"


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (array<double>) of the rows that can be compared.

    Left out are rows without id, and vectors that are null, empty, zero, hold null or non-finite
    components, or have another length than most.
    """
    rows = df.select(quoted(id).cast("bigint").alias("id"), quoted(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


def packed(column: pa.Array) -> np.ndarray:
    """An Arrow array of equally long lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def quantised(vectors: DataFrame, unit: bool) -> DataFrame:
    """``id``, ``q`` (a byte per component) and ``scale`` of the vectors, scaled to length one first if ``unit``."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = packed(batch.column(1))
                if unit:
                    # By the largest part first, so that squares neither vanish nor overflow.
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                most = np.abs(x).max(axis=1)
                q = np.rint(x / most[:, None] * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in q], pa.binary()),
                                                  pa.array((most / 127).astype(np.float32))], names=["id", "q", "scale"])

    return vectors.select("id", "v").mapInArrow(make, "id bigint, q binary, scale float")


def whole(vectors: DataFrame) -> DataFrame:
    """``id``, ``q`` and ``scale`` like ``quantised``, but ``q`` holds the components unrounded."""
    return vectors.select("id", F.col("v").alias("q"), F.lit(1.0).cast("float").alias("scale"))


def restored(q: pa.Array, scale: pa.Array) -> np.ndarray:
    """The vectors of codes: float32 of bytes, double precision of what ``whole`` made."""
    if pa.types.is_list(q.type):
        return packed(q).astype(np.float64, copy=False)
    data = np.frombuffer(b"".join(q.to_pylist()), np.int8)
    return data.reshape(len(q), -1).astype(np.float32) * scale.to_numpy()[:, None]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T)


def smallest(owner: np.ndarray, other: np.ndarray, dist: np.ndarray, k: np.ndarray | int):
    """Distinct (owner, other) rows, the ``k`` nearest of each owner, by owner, distance, other."""
    order = np.lexsort((dist, other, owner))
    owner, other, dist = owner[order], other[order], dist[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, dist = owner[first], other[first], dist[first]
    order = np.lexsort((other, dist, owner))
    owner, other, dist = owner[order], other[order], dist[order]
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.array([], int)
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
    keep = rank < k
    return owner[keep], other[keep], dist[keep]


class Trees:
    """Random projection trees: each split halves its sample at the median of a random direction."""

    def __init__(self, sample: np.ndarray, leaf: float, n: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(sample, np.arange(len(sample)), leaf, rng) for _ in range(n)]

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: float, rng) -> tuple | int:
        if len(rows) <= max(leaf, 8):
            return int(rng.integers(1 << 62))
        a, b = x[rng.choice(rows, 2, replace=False)]
        way = (a - b).astype(np.float32)
        at = x[rows] @ way
        middle = float(np.median(at))
        low = at <= middle
        if low.all():
            return int(rng.integers(1 << 62))
        return way, middle, self._grow(x, rows[low], leaf, rng), self._grow(x, rows[~low], leaf, rng)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """A leaf for each row and tree."""
        out = np.zeros((len(x), len(self.trees)), np.int64)
        for t, root in enumerate(self.trees):
            todo = [(root, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if isinstance(node, int):
                    out[rows, t] = node
                elif len(rows):
                    way, middle, low, high = node
                    left = x[rows] @ way <= middle
                    todo += [(low, rows[left]), (high, rows[~left])]
        return out


def _fit_trees(codes: DataFrame, rows: int, seed: int, trees: int) -> Trees:
    """On a bounded sample: the rows of smallest digest, at most ``SAMPLE_ROWS`` and ``SAMPLE_BYTES``."""
    each = 4 * F.octet_length("q") if codes.schema["q"].dataType == BinaryType() else 8 * F.size("q")
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // codes.select(each).first()[0]))
    part = codes.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < (1 << 20) * min(1.0, 1.2 * most / rows)).limit(most)
    got = part.toArrow()
    sample = restored(got.column("q").combine_chunks(), got.column("scale").combine_chunks())
    return Trees(sample, LEAF * len(sample) / rows, trees, seed)


def _placed(codes: DataFrame, trees: Trees) -> DataFrame:
    """The codes with a ``leaf`` of each tree, a row for each."""
    shared = codes.sparkSession.sparkContext.broadcast(trees)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaves = shared.value.leaves(restored(batch.column(1), batch.column(2)))
                n = leaves.shape[1]
                each = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([*[c.take(each) for c in batch.columns], pa.array(leaves.ravel())],
                                                 names=["id", "q", "scale", "leaf"])

    return codes.mapInArrow(assign, StructType([*codes.schema.fields, StructField("leaf", LongType())]))


def leaf_of(codes: DataFrame, rows: int, seed: int = SEED) -> DataFrame:
    """``id`` and its ``leaf`` in one tree: what lies near each other mostly has the same."""
    return _placed(codes, _fit_trees(codes, rows, seed, 1)).select("id", "leaf")


def _from_leaves(codes: DataFrame, trees: Trees, rows: int, k: int, seed: int) -> DataFrame:
    """``id``, ``nbr``, ``dist`` of the ``k`` nearest of each row within each of its leaves."""
    placed = _placed(codes, trees)
    # Leaves may be larger than fitted: cut them, so that no group grows with the data.
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / (2 * LEAF)).alias("cuts"))
    cut = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("cuts"))
    groups = (placed.join(sizes, "leaf").groupBy("leaf", cut.alias("cut"))
              .agg(F.collect_list("id").alias("ids"), F.collect_list("q").alias("qs"), F.collect_list("scale").alias("scales")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values.to_numpy()
                if len(ids) < 2:
                    continue
                x = restored(batch.column(1)[i].values, batch.column(2)[i].values)
                d = squared(x, x)
                np.fill_diagonal(d, np.inf)
                n = min(k, len(ids) - 1)
                near = np.argpartition(d, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, n)), pa.array(ids[near.ravel()]),
                     pa.array(np.take_along_axis(d, near, axis=1).ravel().astype(np.float32))], names=["id", "nbr", "dist"])

    return groups.select("ids", "qs", "scales").mapInArrow(compare, "id bigint, nbr bigint, dist float")


def _merged(candidates: DataFrame, lists: DataFrame | None, k: int) -> DataFrame:
    """Lists of the ``k`` nearest among candidates and current lists; what was not there before is fresh."""
    rows = candidates.groupBy("id").agg(F.collect_list("nbr").alias("nbrs"), F.collect_list("dist").alias("dists")).select(
        "id", "nbrs", "dists", F.lit(False).alias("old"))
    if lists is not None:
        rows = rows.unionByName(lists.select("id", "nbrs", "dists", F.lit(True).alias("old")))
    grouped = rows.groupBy("id").agg(F.collect_list(F.struct("nbrs", "dists", "old")).alias("parts"))
    nbrs = F.flatten(F.transform("parts", lambda p: p["nbrs"]))
    dists = F.flatten(F.transform("parts", lambda p: p["dists"]))
    old = F.flatten(F.transform("parts", lambda p: F.transform(p["nbrs"], lambda _: p["old"])))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lengths)
            other, dist = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            old = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            # Half a step for age: of the two rows of a pair that is in the list, the old one comes first.
            order = np.lexsort((~old, other, row))
            row, other, dist, old = row[order], other[order], dist[order], old[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (other[1:] != other[:-1])
            row, other, dist, old = row[first], other[first], dist[first], old[first]
            order = np.lexsort((other, dist, row))
            row, other, dist, old = row[order], other[order], dist[order], old[order]
            starts = np.searchsorted(row, np.arange(batch.num_rows))
            keep = np.arange(len(row)) - starts[row] < k
            row, other, dist, old = row[keep], other[keep], dist[keep], old[keep]
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends, pa.array(other)),
                 pa.ListArray.from_arrays(ends, pa.array(dist)), pa.ListArray.from_arrays(ends, pa.array(~old))],
                names=["id", "nbrs", "dists", "fresh"])

    return grouped.select("id", nbrs.alias("nbrs"), dists.alias("dists"), old.alias("old")).mapInArrow(merge, LISTS)


def _improvements(lists: DataFrame, codes: DataFrame, k: int, number: int) -> DataFrame:
    """Candidates ``id``, ``nbr``, ``dist`` from comparing what meets at each node."""
    places = lists.select("id", F.explode(F.arrays_zip("nbrs", "fresh")).alias("e")).select(
        "id", F.col("e.nbrs").alias("nbr"), F.col("e.fresh").alias("fresh"))
    both = places.select(F.col("id").alias("at"), F.col("nbr").alias("member"), "fresh").unionByName(
        places.select(F.col("nbr").alias("at"), F.col("id").alias("member"), "fresh"))
    # One row per meeting; a node all of whose members are old has been done before.
    counts = both.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.max("fresh").alias("any")).where("any")
    meet = (both.join(counts.select("at", F.ceil(F.col("n") / GROUP).alias("cuts")), "at")
            .select("at", F.pmod(F.xxhash64("member", F.lit(number)), F.col("cuts")).alias("cut"), "member", "fresh"))
    last = F.when(F.size("dists") < k, F.lit(float("inf"))).otherwise(F.element_at("dists", -1)).cast("float")
    known = codes.join(lists.select(F.col("id").alias("of"), last.alias("worst")), F.col("id") == F.col("of"), "left").select(
        F.col("id").alias("member"), "q", "scale", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"))
    groups = meet.join(known, "member").groupBy("at", "cut").agg(
        *[F.collect_list(c).alias(c) for c in ("member", "fresh", "worst", "q", "scale")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, other, dist = [], [], []
            for i in range(batch.num_rows):
                member, fresh, worst, q, scale = (c[i].values for c in batch.columns)
                member, worst = member.to_numpy(), worst.to_numpy()
                if len(member) < 2:
                    continue
                fresh = fresh.to_numpy(zero_copy_only=False)
                x = restored(q, scale)
                d = squared(x, x).astype(np.float32)
                new = (d < worst[:, None]) & (fresh[:, None] | fresh[None, :]) & (member[:, None] != member[None, :])
                a, b = np.nonzero(new)
                owner.append(member[a])
                other.append(member[b])
                dist.append(d[a, b])
            if owner:
                found = smallest(np.concatenate(owner), np.concatenate(other), np.concatenate(dist), k)
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["id", "nbr", "dist"])

    return groups.select("member", "fresh", "worst", "q", "scale").mapInArrow(compare, "id bigint, nbr bigint, dist float")


def build(codes: DataFrame, k: int, rounds: int, staged: Staged, trees: int = TREES, seed: int = SEED,
          lists: DataFrame | None = None, key: str = "lists") -> DataFrame:
    """Neighbour lists (``id``, ``nbrs``, ``dists`` squared and approximate, nearest first, ``fresh``).

    ``codes`` are distinct vectors from ``quantised``, staged. With ``lists`` the graph goes on from
    there, with further trees of another ``seed``, to ``k`` places a list.
    """
    spark = codes.sparkSession
    rows = codes.count()
    if rows < 2:
        return spark.createDataFrame([], LISTS)
    start = _from_leaves(codes, _fit_trees(codes, rows, seed, trees), rows, k, seed)
    lists = staged.put(_merged(start, lists, k), key)
    for number in range(rounds):
        seen = Observation()
        after = _merged(_improvements(lists, codes, k, seed + number), lists, k)
        changed = F.sum(F.size(F.filter("fresh", lambda f: f))).alias("changed")
        lists = staged.put(after.observe(seen, changed), key)
        staged.drop(key, keep_last=1)
        if (seen.get.get("changed") or 0) < ENOUGH * rows * k:
            break
    return lists


def edges(lists: DataFrame) -> DataFrame:
    """``id``, ``nbr``, ``dist`` of every list place."""
    return lists.select("id", F.explode(F.arrays_zip("nbrs", "dists")).alias("e")).select(
        "id", F.col("e.nbrs").alias("nbr"), F.col("e.dists").alias("dist"))
