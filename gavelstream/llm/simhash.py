"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile.

Distinct fingerprints fall into cells by the population counts of their two halves. Two
fingerprints within the radius lie in cells whose counts differ by no more than the radius in
sum, so all other pairs of cells are skipped. Cells are cut into tiles of bounded size, and each
pair of tiles that is left is one exclusive-or and bit count in numpy, in blocks, which are in
turn skipped by the counts of their quarters. A pair of tiles reports a spanning forest of its
links and not every link, so groups of near copies cost no more rows than they have members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from ..session import small_side
from .common import Staged, add_columns, partitions, quoted, without
from .components import components

SEED, BITS = 42, 64
SHINGLES_AT_ONCE = 65_280
TILE, BLOCK = 4096, 512
SKETCH = 1 << 16
POSTED_AT_ONCE = 500
HOT = 100_000


def fingerprint(text: str | None, shingle: int = 4, seen: list[np.ndarray] | None = None) -> int:
    """Signed 64-bit fingerprint; zero for a text without words. The shingles' digests are added to ``seen``."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:]
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, SHINGLES_AT_ONCE):
        spans = map(slice, starts[k:min(n, k + SHINGLES_AT_ONCE)].tolist(), ends[k:k + SHINGLES_AT_ONCE].tolist())
        digests = b"".join(map(xxh64_digest, map(joined.__getitem__, spans), repeat(SEED)))
        if seen is not None:
            seen.append(np.unique(np.frombuffer(digests, np.int64)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, BITS)
        # At most 255 rows to a sum, so that bytes hold it.
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = 4, out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a signed bigint. Null and empty texts have zero."""
    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([fingerprint(t, shingle) for t in texts.to_pylist()], pa.int64())]

    return add_columns(df, [text], f"`{out}` bigint", make)


def as_hex(column):
    """A signed bigint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


class Forest:
    """Union-find over the positions of two tiles, many links at a time."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(self.root, jumped := self.root[self.root]):
                self.root = jumped


def _quarters(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _sorted_blocks(prints: np.ndarray):
    """Positions in an order that brings like population counts together, in blocks with their bounds."""
    counts = _quarters(prints)
    order = np.lexsort(counts.T[::-1])
    for k in range(0, len(order), BLOCK):
        where = order[k:k + BLOCK]
        yield where, counts[where].min(axis=0), counts[where].max(axis=0)


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Root of each position of two tiles (or one tile with itself) under links within the radius."""
    prints = left if right is None else np.concatenate([left, right])
    forest, shift = Forest(len(prints)), 0 if right is None else len(left)
    blocks = list(_sorted_blocks(left))
    others = blocks if right is None else [(w + shift, low, high) for w, low, high in _sorted_blocks(right)]
    for i, (a, low_a, high_a) in enumerate(blocks):
        for b, low_b, high_b in others[i:] if right is None else others:
            if np.maximum(0, np.maximum(low_b - high_a, low_a - high_b)).sum() > radius:
                continue
            near = np.bitwise_count(prints[a][:, None] ^ prints[b][None, :]) <= radius
            x, y = np.nonzero(near)
            forest.link(a[x], b[y])
    return forest.root


def _tile_pairs(prints: DataFrame, radius: int, staged: Staged, tile: int, item: str | Column) -> DataFrame:
    """``same`` and the lists of ``item`` of all pairs of tiles that can hold fingerprints within the radius."""
    halves = staged.put(prints.select(
        "*", F.bit_count(F.shiftrightunsigned("fingerprint", 32)).cast("int").alias("hi"),
        F.bit_count(F.col("fingerprint").bitwiseAND(0xFFFFFFFF)).cast("int").alias("lo")), "halves")
    # At most 33 x 33 cells.
    sizes = halves.groupBy("hi", "lo").agg(F.ceil(F.count(F.lit(1)) / tile).alias("chunks"))
    tiles = staged.put(
        halves.join(F.broadcast(sizes), ["hi", "lo"])
        .withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int"))
        .groupBy("hi", "lo", "chunk").agg(F.collect_list(item).alias("prints"))
        .withColumn("tile", F.struct("hi", "lo", "chunk")), "tiles")
    steps = [(h, l) for h in range(radius + 1) for l in range(-radius, radius + 1)
             if h + abs(l) <= radius and (h, l) >= (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(l).alias("l")) for h, l in steps]))
    near = tiles.select("tile", "hi", "lo", step.alias("s")).select(
        F.col("tile").alias("one"), (F.col("hi") + F.col("s.h")).alias("hi"), (F.col("lo") + F.col("s.l")).alias("lo"))
    pairs = near.join(tiles.select("hi", "lo", F.col("tile").alias("other")), ["hi", "lo"]).where("one <= other")
    content = tiles.select("tile", "prints")
    left = pairs.select("one", "other").join(content.toDF("one", "one_prints"), "one")
    return (left.repartition(partitions(staged.spark), "other").join(content.toDF("other", "other_prints"), "other")
            .select((F.col("one") == F.col("other")).alias("same"), "one_prints", "other_prints"))


def links(prints: DataFrame, radius: int, staged: Staged, tile: int = TILE) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct ``fingerprint`` values within ``radius`` bits.

    All pairs within the radius are compared, none is left out; the links keep their components.
    """
    both = _tile_pairs(prints.select("fingerprint"), radius, staged, tile, "fingerprint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, one, other = (c[k] for c in batch.columns)
                one = one.values.to_numpy().view(np.uint64)
                other = None if same.as_py() else other.values.to_numpy().view(np.uint64)
                members = (one if other is None else np.concatenate([one, other])).view(np.int64)
                root = tile_links(one, other, radius)
                found = np.nonzero(root != np.arange(len(root)))[0]
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(members[found]), pa.array(members[root[found]])],
                                                     names=["a", "b"])

    return both.mapInArrow(compare, "a bigint, b bigint")


def _classes(df: DataFrame, id: str, text: str, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """``id``, ``digest`` of the text and ``print`` of every row, and the ``root`` of every print."""
    staged = Staged(df.sparkSession, "simhash")
    narrow = df.select(quoted(id).cast("bigint").alias("id"), quoted(text).alias("text"), F.xxhash64(quoted(text)).alias("digest"))
    prints = staged.put(with_fingerprint(narrow, "text", shingle, "print").select("id", "digest", "print"), "prints")
    distinct = prints.select(F.col("print").alias("fingerprint")).distinct()
    found = components(links(distinct, radius, staged), staged)
    roots = distinct.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        F.col("fingerprint").alias("of"), F.coalesce("component", "fingerprint").alias("root"))
    roots = staged.put(roots, "roots")
    for key in ("halves", "tiles"):
        staged.drop(key)
    return prints, roots


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4,
                    radius: int = 4, ids_only: bool = False) -> DataFrame:
    """Add ``fingerprint`` (16 hex digits) and ``component_id`` to every row (to ``id`` alone if ``ids_only``).

    A component is what links of at most ``radius`` differing bits reach; its id is the smallest
    id in it. Null and empty texts have fingerprint zero and link like any other. Rows may share an
    id; a row without one gets the id of its component, null if no row there has any. An empty
    table gives an empty result. Input columns named like the outputs are replaced.
    """
    prints, roots = _classes(df, id, text, shingle, radius)
    least = (prints.groupBy("print").agg(F.min("id").alias("least"))
             .join(roots, F.col("print") == F.col("of")).groupBy("root").agg(F.min("least").alias("component_id")))
    named = roots.join(least, "root").select("of", "component_id")
    if ids_only:
        kept, rows = [id], prints.withColumnRenamed("id", id)
    else:
        kept = without(df, "fingerprint", "component_id")
        rows = with_fingerprint(df.select(*map(quoted, kept)), text, shingle, "\x01print").withColumnRenamed("\x01print", "print")
    return rows.join(named, F.col("print") == F.col("of")).select(
        *map(quoted, kept), as_hex(F.col("print")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct digests of the shingles, those that ``fingerprint`` counts; none for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.array([], np.int64)
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = map(slice, (ends - lengths)[:max(1, len(words) - shingle + 1)].tolist(), ends[min(shingle, len(words)) - 1:].tolist())
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, map(joined.__getitem__, spans), repeat(SEED))), np.int64))


def _texts(narrow: DataFrame, sets: DataFrame) -> DataFrame:
    """``set`` and ``text`` of these sets. Shingles take more room than texts, so they are made anew where they are needed."""
    wanted = small_side(sets.select("set", F.col("first.id").alias("of"), F.col("first.digest").alias("known")))
    return narrow.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.coalesce("digest", F.lit(0)) == F.coalesce("known", F.lit(0)))).select("set", "text")


def _sketch(texts: DataFrame, shingle: int) -> np.ndarray:
    """About how many sets hold a shingle, by ``SKETCH`` places of its digest: one count per place and task to sum up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts += np.bincount(shingle_set(text.as_py(), shingle) & (SKETCH - 1), minlength=SKETCH)
        met = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["place", "n"])

    sketch = np.zeros(SKETCH, np.int64)
    summed = texts.select("text").mapInArrow(count, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # SKETCH rows at most
        sketch[r["place"]] = r["n"]
    return sketch


def _postings(texts: DataFrame, sketch: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """``shingle``, ``set`` and ``hot`` for the rarest shingles of each set, as many as must hold one that a similar set shares.

    Two sets of at least the similarity share all but a few of their shingles, so in any order of all shingles that is the same
    everywhere they share one among the first few. Rare ones first, by the sketch, keeps what many texts share out of the join.
    ``hot`` are shingles that more than ``HOT`` sets may hold.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, POSTED_AT_ONCE):
                shingles, members = [], []
                part = batch.slice(start, POSTED_AT_ONCE)
                for of, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    own = shingle_set(text.as_py(), shingle)
                    if len(own):
                        n = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1
                        shingles.append(own[np.lexsort((own, sketch[own & (SKETCH - 1)]))[:n]])
                        members.append(np.full(len(shingles[-1]), of, np.int64))
                if shingles:
                    posted = np.concatenate(shingles)
                    yield pa.RecordBatch.from_arrays([pa.array(posted), pa.array(np.concatenate(members)), pa.array(sketch[posted & (SKETCH - 1)] > HOT)],
                                                     names=["shingle", "set", "hot"])

    return texts.mapInArrow(first, "shingle bigint, `set` bigint, hot boolean")


def _shared(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``shingle``, ``set`` and ``least``, the least set that posted it, of shingles that more than one set posted.

    A window costs one shuffle and holds ``HOT`` rows at most. Hot shingles are counted where they are read and joined back,
    which the adaptive planner can split.
    """
    sketch = _sketch(texts, shingle)
    posted = _postings(texts, sketch, shingle, similarity)
    of_shingle = Window.partitionBy("shingle")
    cold = posted.where("NOT hot").select("shingle", "set", F.min("set").over(of_shingle).alias("least"), F.max("set").over(of_shingle).alias("most"))
    found = cold.where("least < most").drop("most")
    if (sketch > HOT).any():
        hot = posted.where("hot").select("shingle", "set")
        counted = hot.groupBy("shingle").agg(F.min("set").alias("least"), F.max("set").alias("most")).where("least < most").drop("most")
        found = found.unionByName(hot.join(counted, "shingle"))
    return found


def _relabelled(sets: DataFrame, found: DataFrame) -> DataFrame:
    return sets.join(found, F.col("set") == F.col("node"), "left").select("set", "n", F.coalesce("component", "set").alias("label"))


def _confirmed(pairs: DataFrame, narrow: DataFrame, sets: DataFrame, shingle: int, similarity: float, staged: Staged) -> DataFrame:
    """The pairs whose shingle sets have at least this Jaccard similarity, counted exactly. Only the sets of pairs are made."""
    pairs = staged.put(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set"))).distinct()

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in texts], pa.binary())]

    bodies = add_columns(_texts(narrow, sets.join(small_side(needed), "set", "left_semi")), ["text"], "shingles binary", make, keep=["set"])
    # A set may have been read from several equal rows.
    bodies = staged.put(bodies.groupBy("set").agg(F.first("shingles").alias("shingles")), "bodies")
    full = (pairs.join(bodies.select(F.col("set").alias("a"), F.col("shingles").alias("one")), "a")
            .join(bodies.select(F.col("set").alias("b"), F.col("shingles").alias("other")), "b").select("a", "b", "one", "other"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                one, other = np.frombuffer(one.as_py(), np.int64), np.frombuffer(other.as_py(), np.int64)
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(common >= similarity * (len(one) + len(other) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return full.mapInArrow(check, "a bigint, b bigint")


def first_of_similar(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5,
                     similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """One row of each group of texts linked by shingle sets of at least this Jaccard similarity: that of the smallest id.

    Fingerprints within ``radius`` bits, found by tiles, come first; each link is confirmed on the sets. Then come
    the pairs that share one of their rarest shingles, which no similar pair can lack: first each set with the least one of
    those it shares a shingle with (one for each), then all pairs that are in different groups still. So no link is missed, and a
    group of near copies costs few rows. Otherwise like ``first_of_each``.
    """
    staged = Staged(df.sparkSession, "similar")
    narrow = df.select(quoted(id).cast("bigint").alias("id"), quoted(text).alias("text"), F.xxhash64(quoted(text)).alias("digest"))

    def make(texts: pa.Array) -> list[pa.Array]:
        prints, sets, sizes = [], [], []
        for t in texts:
            seen = []
            prints.append(fingerprint(t.as_py(), shingle, seen))
            own = np.unique(np.concatenate(seen)) if seen else np.array([], np.int64)
            sets.append(int.from_bytes(xxh64_digest(own.tobytes(), SEED), "big", signed=True))
            sizes.append(len(own))
        return [pa.array(prints, pa.int64()), pa.array(sets, pa.int64()), pa.array(sizes, pa.int64())]

    rows = staged.put(add_columns(narrow, ["text"], "fingerprint bigint, set bigint, n bigint", make, keep=["id", "digest"]), "rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    # Texts of one set can differ in how often a shingle repeats, and so in their prints: the least one counts.
    sets = staged.put(rows.groupBy("set").agg(F.min("fingerprint").alias("fingerprint"), F.first("n").alias("n"), F.min(order).alias("first")), "sets")
    least = sets.groupBy("fingerprint").agg(F.min("set").alias("least"))
    few = links(sets.select("fingerprint").distinct(), radius, staged)
    close = (few.join(least.toDF("a", "one"), "a").join(least.toDF("b", "other"), "b").select(F.col("one").alias("a"), F.col("other").alias("b"))
             .unionByName(sets.join(least, "fingerprint").where("set != least").select(F.col("set").alias("a"), F.col("least").alias("b"))))
    found = staged.put(components(_confirmed(close, narrow, sets, shingle, similarity, staged), staged), "found")
    for key in ("halves", "tiles"):
        staged.drop(key)

    shared = staged.put(_shared(_texts(narrow, sets), shingle, similarity), "shared")
    for all_pairs in (False, True):
        labels = _relabelled(sets, found)
        if all_pairs:
            # A shingle all of whose sets are in one group has no pair left; the label travels with the posting.
            marked = shared.drop("least").join(labels, "set")
            split = marked.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
            open_ = staged.put(marked.join(split, "shingle"), "open")
            one, other = (open_.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("set", "label", "n")]) for side in "ab")
            met = one.join(other, "shingle").where((F.col("set_a") < F.col("set_b")) & (F.col("label_a") != F.col("label_b")))
            # Of the text whose posted shingles end first all common ones among them are seen here; the rest can all be common.
            rest = F.ceil(similarity * F.greatest("n_a", "n_b") - 1e-9) - 1
            least_common = similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b"))
            fits = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
            pairs = (met.where(fits).groupBy(F.col("set_a").alias("a"), F.col("set_b").alias("b"), "n_a", "n_b").agg(F.count(F.lit(1)).alias("seen"))
                     .where(F.col("seen") + rest >= least_common - 1e-6).select("a", "b"))
        else:
            # Each set with the one that it shares most with, of those that are the least at a shingle.
            counted = shared.where("set != least").groupBy("set", "least").agg(F.count(F.lit(1)).alias("seen"))
            best = counted.groupBy("set").agg(F.max(F.struct("seen", "least")).alias("best")).select("set", F.col("best.least").alias("b"))
            to = labels.select(F.col("set").alias("b"), F.col("label").alias("label_b"))
            pairs = best.join(labels, "set").join(to, "b").where("label != label_b").select(F.col("set").alias("a"), "b")
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        more = _confirmed(pairs, narrow, sets, shingle, similarity, staged)
        found = staged.put(components(stars.unionByName(more), staged), "found")
    for key in ("shared", "open", "pairs", "bodies"):
        staged.drop(key)
    roots = rows.select("id", "digest", "set").join(found, F.col("set") == F.col("node"), "left").withColumn("root", F.coalesce("component", "set"))
    order = F.struct(F.col("id").isNull().alias("n"), "id", "digest")
    return _kept(df, roots.groupBy("root").agg(F.min(order).alias("best")), id, text)


def first_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id. Columns as in ``df``.

    An id comes before none; rows that share id and text are one row. Rows that differ only in
    other columns count as repeated, and any one of them stays.
    """
    prints, roots = _classes(df, id, text, shingle, radius)
    order = F.struct(F.col("id").isNull().alias("n"), "id", "digest")
    best = (prints.groupBy("print").agg(F.min(order).alias("best"))
            .join(roots, F.col("print") == F.col("of")).groupBy("root").agg(F.min("best").alias("best")))
    return _kept(df, best, id, text)


def _kept(df: DataFrame, best: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of ``df`` whose id and digest of text are a ``best``."""
    name = F.concat_ws(":", F.coalesce(F.col("best.id").cast("string"), F.lit("none")), F.hex("best.digest"))
    own = F.concat_ws(":", F.coalesce(quoted(id).cast("bigint").cast("string"), F.lit("none")), F.hex(F.xxhash64(quoted(text))))
    rows = df.withColumn("\x01key", own).join(best.select(name.alias("\x01key")), "\x01key", "left_semi")
    return rows.dropDuplicates(["\x01key"]).drop("\x01key")
