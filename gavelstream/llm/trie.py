"""Prefix tries of conversations by van Emde Boas recursion.

Sequences are cut at half depth, the upper halves and the parts below each cut again, all of one size at the
same time, down to runs of ``RUN`` turns that are solved where they lie. On the way the prefix at each cut gets a
name from the name of the cut above it and that of the segment between: as many rounds as the longest
conversation has binary digits, not one for each depth. Nodes are then the distinct names. Totals are first those of the runs; round by
round, from the smallest, the totals of the forest below a cut are grafted onto the nodes between it and the cut above.

A conversation is rows of (conversation, run), never one list, and what many conversations share is
summed where it is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .common import Staged, quoted
from .numbering import numbered

RUN = 16
ROOT = b"root"
OPENINGS, LONGEST_OPENING = 5, 8
PIECE = 4096  # ids to a piece of a list that is hashed
HOT_CHILDREN = 4096


def turns(df: DataFrame, staged: Staged, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``pos`` (from 1), ``digest`` of role and text, and ``cost`` (UTF-8 bytes of the text) of every turn.

    Turns are in order of ``turn``, null first, equal ones by digest; null role or text is empty. Repeated
    rows are turns of their own. Rows without an id belong to no conversation and take no part.
    """
    who, what = (F.coalesce(quoted(c).cast("string"), F.lit("")) for c in (role, text))
    said = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what)
    rows = df.where(quoted(id).isNotNull()).select(
        quoted(id).cast("bigint").alias("conv"), quoted(turn).alias("turn"), F.unhex(F.sha2(said, 256)).alias("digest"),
        F.octet_length(what).cast("bigint").alias("cost"))
    ranked = numbered(staged.put(rows, "turns"), "conv", ["turn", "digest"], staged)
    return ranked.select("conv", (F.col("rank") + 1).alias("pos"), "digest", "cost")


def with_openings(rows: DataFrame, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """Every conversation behind the opening of the one whose id is the next lower multiple of ``OPENINGS``.

    Its first h turns (h by digest of the id, at most ``LONGEST_OPENING``) are replaced by as many there, or by what there is.
    Returns the turns with the new length ``n``, and ``conv`` and ``n`` of all conversations, those left without turns too.
    """
    lengths = staged.put(rows.groupBy("conv").agg(F.max("pos").alias("own")), "lengths")
    base = F.col("conv") - F.col("conv") % OPENINGS
    h = F.crc32(F.encode(F.col("conv").cast("string"), "utf-8")) % (LONGEST_OPENING + 1)
    asked = lengths.select("conv", "own", base.alias("base"), h.alias("h"))
    told = asked.join(lengths.select(F.col("conv").alias("base"), F.col("own").alias("there")), "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"), "own")
    convs = staged.put(told.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "convs")
    heads = rows.where(F.col("pos") <= LONGEST_OPENING).withColumnRenamed("conv", "base")
    first = convs.join(heads, "base").where("pos <= h").select("conv", "pos", "digest", "cost", "n")
    # Where lengths are too many to broadcast, a conversation of very many turns is a skewed key, which the adaptive planner splits.
    rest = rows.join(small_side(convs.select("conv", "h", "taken", "n")), "conv").where("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "cost", "n")
    return first.unionByName(rest), convs.select("conv", "n")


def _hash(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _cuts(runs: DataFrame, convs: DataFrame, n_runs: int, staged: Staged) -> DataFrame:
    """``conv``, ``j`` and ``name``: names of all prefixes that end at a multiple of ``RUN``.

    Segments of twice the size are named from two halves, going up; then cut prefixes, going down: that at an
    odd multiple of a size from the cut one size before it and the segment between.
    """
    pairs: list[DataFrame] = []
    segments = runs.where(F.size("digests") == RUN).select("conv", F.col("j").alias("i"), _hash(F.array_join(F.transform("digests", F.hex), "").cast("binary")).alias("name"))
    while 1 << len(pairs) < n_runs:
        half = F.col("i") % 2
        both = staged.put(segments.groupBy("conv", F.floor(F.col("i") / 2).alias("j")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right")), "pairs")
        pairs.append(both)
        segments = both.where("right IS NOT NULL").select("conv", F.col("j").alias("i"), _hash("left", "right").alias("name"))
    cuts = convs.select("conv", F.lit(0).cast("bigint").alias("j"), F.lit(ROOT).alias("name"))
    for both in reversed(pairs):
        below = both.join(cuts, ["conv", "j"]).select("conv", (2 * F.col("j") + 1).alias("j"), _hash("name", "left").alias("name"))
        cuts = staged.put(cuts.select("conv", (2 * F.col("j")).alias("j"), "name").unionByName(below), "cuts")
    return cuts


def _paths(rows: DataFrame, convs: DataFrame, n_runs: int, staged: Staged) -> DataFrame:
    """For each run of a conversation the ``names`` of its prefixes, that before the run first, and the ``costs`` of its turns."""
    place = F.struct("pos", "digest", "cost")
    runs = rows.groupBy("conv", F.floor((F.col("pos") - 1) / RUN).alias("j")).agg(
        F.sort_array(F.collect_list(place)).alias("turns"), F.max("n").alias("n"))
    runs = staged.put(runs.select("conv", "j", "n", F.col("turns.digest").alias("digests"), F.col("turns.cost").alias("costs")), "runs")
    cuts = _cuts(runs, convs, n_runs, staged)
    none = F.lit(None)
    around = runs.select("conv", "j", "n", "digests", "costs", none.cast("binary").alias("start"), none.cast("binary").alias("end"))
    for shift, name in ((0, "start"), (1, "end")):
        columns = {"n": none.cast("bigint"), "digests": none.cast("array<binary>"), "costs": none.cast("array<bigint>"),
                   "start": none.cast("binary"), "end": none.cast("binary")} | {name: F.col("name")}
        around = around.unionByName(cuts.where(F.col("j") >= shift).select("conv", (F.col("j") - shift).alias("j"), *[c.alias(k) for k, c in columns.items()]))
    met = around.groupBy("conv", "j").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "digests", "costs", "start", "end")])
    hexes = F.transform("digests", F.hex)
    inside = F.transform(F.sequence(F.lit(1), F.size("digests")), lambda r: F.when(
        r == RUN, F.col("end")).otherwise(_hash(F.col("start"), F.array_join(F.slice(hexes, 1, r), "").cast("binary"))))
    return staged.put(met.where("digests IS NOT NULL").select("conv", "j", "n", F.concat(F.array("start"), inside).alias("names"), "costs"), "paths")


def _nodes(paths: DataFrame, convs: DataFrame, staged: Staged) -> DataFrame:
    """One row for each distinct prefix: its smallest member, how many, what its last turn costs, its parent and its children."""
    each = F.explode(F.transform(F.sequence(F.lit(1), F.size("costs")), lambda r: F.struct(
        F.element_at("names", r + 1).alias("name"), F.element_at("names", r).alias("parent"), F.element_at("costs", r).alias("cost"),
        (F.col("j") * RUN + r).alias("depth")))).alias("e")
    found = paths.select("conv", each).select("conv", "e.*").groupBy("name").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("cost").alias("cost"),
        F.max("depth").alias("depth"), F.max("parent").alias("parent"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("name"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("cost"), F.lit(0).cast("bigint").alias("depth"),
        F.lit(None).cast("binary").alias("parent"))
    found = staged.put(found.unionByName(root), "found")
    children = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    return staged.put(found.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")


def _totals(nodes: DataFrame, paths: DataFrame, n_runs: int, staged: Staged) -> DataFrame:
    """``n_leaves`` and ``saved`` of the whole subtree of each node.

    A conversation that is a node's smallest member is that of every deeper node on its own path, so it speaks for
    these: what they hold is added to the nodes above them along its path.
    """
    leaf, saved = (F.col("n_children") == 0).cast("bigint"), (F.col("n_convs") - 1) * F.col("cost")
    own = nodes.select("name", leaf.alias("leaves"), saved.alias("saved"), "depth", F.col("conv_id").alias("conv"))
    j, r = F.floor((F.col("depth") - 1) / RUN), (F.col("depth") - 1) % RUN + 1
    spoken = own.where("depth > 0").groupBy("conv", j.alias("j")).agg(F.collect_list(F.struct(r.alias("r"), "leaves", "saved")).alias("own"))

    def below(field: str, r: Column) -> Column:
        return F.aggregate(F.filter("own", lambda o: o["r"] >= r), F.lit(0).cast("bigint"), lambda a, o: a + o[field])

    def sums(each: DataFrame) -> DataFrame:
        return each.select("j", "e.*").groupBy("name").agg(
            F.max("j").alias("j"), F.max("cut").alias("cut"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    def named(r: Column, leaves: Column, saved: Column) -> Column:
        # The first node of a run carries the name of the cut above it.
        return F.struct(F.element_at("names", r + 1).alias("name"), F.when(r == 1, F.element_at("names", 1)).alias("cut"),
                        leaves.alias("leaves"), saved.alias("saved"))

    places = F.sequence(F.lit(1), F.size("costs"))
    runs = spoken.join(paths.select("conv", "j", "names", "costs"), ["conv", "j"])
    added = staged.put(sums(runs.select("j", F.explode(F.transform(places, lambda r: named(r, below("leaves", r), below("saved", r)))).alias("e"))), "added")
    span = 1
    while span < n_runs:
        forests = (added.where((F.col("j") % (2 * span) == span) & F.col("cut").isNotNull()).groupBy("cut")
                   .agg(F.max("j").alias("at"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        grafted = (forests.join(nodes.select(F.col("name").alias("cut"), F.col("conv_id").alias("conv")), "cut")
                   .select("conv", "leaves", "saved", F.explode(F.sequence(F.col("at") - span, F.col("at") - 1)).alias("j"))
                   .join(paths.select("conv", "j", "names", "costs"), ["conv", "j"]))
        more = sums(grafted.select("j", F.explode(F.transform(places, lambda r: named(r, F.col("leaves"), F.col("saved")))).alias("e")))
        added = added.unionByName(staged.put(more, "added"))
        span *= 2
    first = added.where("j = 0 AND cut IS NOT NULL").select("leaves", "saved").unionByName(own.where("depth = 0").select("leaves", "saved"))
    root = first.agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).select(F.lit(ROOT).alias("name"), "leaves", "saved")
    return added.select("name", "leaves", "saved").unionByName(root).groupBy("name").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def ends_digests(ends: DataFrame, staged: Staged) -> DataFrame:
    """``name`` and ``ends_sha256``: the digest of its ``conv`` ids, ascending and joined by commas.

    Ids are dealt out by ranges and become pieces of text there; a hash reads the pieces in order as they come, so
    a node at which a third of all conversations end is pieces and not rows to the task that hashes them.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": pa.array([name], pa.binary()), "first": pa.array([held[0]], pa.int64()),
                                               "ids": pa.array([",".join(map(str, held))], pa.string())})

        for batch in batches:
            for of, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (of != name or len(held) == PIECE):
                    yield made()
                    held = []
                name = of
                held.append(conv)
        if held:
            yield made()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        for batch in batches:
            names, hexes = [], []
            for of, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if of == name:
                    digest.update(b"," + ids.encode())
                    continue
                if digest is not None:
                    names.append(name)
                    hexes.append(digest.hexdigest())
                name, digest = of, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hexes, pa.string())], names=["name", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([digest.hexdigest()])], names=["name", "ends_sha256"])

    dealt = staged.put(ends.select("name", "conv"), "ends").repartitionByRange("name", "conv").sortWithinPartitions("name", "conv")
    cut = dealt.mapInArrow(pieces, "name binary, first bigint, ids string")
    return cut.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digests, "name binary, ends_sha256 string")


def _with_parent_conv(nodes: DataFrame) -> DataFrame:
    """Add ``parent_conv_id``. Parents of very many children are few; they are looked up apart, so that no task gets all their children."""
    known = nodes.where("n_children > 0").select(F.col("name").alias("of"), F.col("conv_id").alias("parent_conv"), "n_children")
    hot = known.where(F.col("n_children") >= HOT_CHILDREN).select("of", F.col("parent_conv").alias("hot_conv"))
    rest = known.where(F.col("n_children") < HOT_CHILDREN).select("of", "parent_conv")
    asked = nodes.join(small_side(hot), F.col("parent") == F.col("of"), "left").drop("of")
    # What is found already gets a key of its own.
    key = F.when(F.col("hot_conv").isNull() & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.concat(F.lit(b"-"), "name"))
    return (asked.withColumn("key", key).join(rest, F.col("key") == F.col("of"), "left")
            .withColumn("parent_conv_id", F.coalesce("hot_conv", "parent_conv")).drop("key", "of", "hot_conv", "parent_conv"))


def prefix_trie(rows: DataFrame, convs: DataFrame, staged: Staged) -> DataFrame:
    """The trie of conversations given as ``turns`` with their length ``n``, and ``conv`` and ``n`` of all of them.

    One row for each distinct sequence of first turns, the empty one too: ``name`` and ``parent`` (digests), ``depth``,
    ``conv_id`` (the smallest member), ``parent_conv_id``, ``n_convs``, ``n_children``, and of its subtree ``n_leaves`` and
    ``saved`` (costs of turns less one payment each), and ``ends_sha256`` of the members that end there.
    Without conversations there is no row.
    """
    rows, convs = staged.put(rows, "rebuilt"), staged.put(convs, "all")
    longest = convs.agg(F.max("n")).first()[0] or 0
    n_runs = -(-longest // RUN) + (longest % RUN == 0)
    paths = _paths(rows, convs, n_runs, staged)
    nodes = _nodes(paths, convs, staged)
    totals = _totals(nodes, paths, n_runs, staged)
    ends = paths.where(F.col("j") * RUN + F.size("costs") == F.col("n")).select(F.element_at("names", -1).alias("name"), "conv")
    ends = ends.unionByName(convs.where("n = 0").select(F.lit(ROOT).alias("name"), "conv"))
    return (_with_parent_conv(nodes).join(totals, "name").join(ends_digests(ends, staged), "name", "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))))
