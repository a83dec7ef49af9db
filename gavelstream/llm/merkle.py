"""Merkle trees over the rows of a table: proofs by butterfly exchange of subtree roots.

Rows are leaves, numbered within their group. Aligned blocks of leaves are whole subtrees. In round
after round, blocks that differ in one digit of their number (to the base of the fanout) ask each other for
the root that the other has got so far, and each hashes the common parent itself, as often as there are
blocks below it. So after the last round every block holds the whole upper proof of its leaves and nothing is handed
back down. The same exchange joins the roots of the groups to one root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .common import Staged, ascii_lower, quoted
from .numbering import numbered

FANOUT = 8
BLOCK = FANOUT ** 3
STEPS = "array<struct<before:string,after:string>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value as text, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row: SHA-256 of its framed values in order, as lower-case hex."""
    return F.sha2(F.concat(*map(framed, values)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its ``proof`` give."""
    return F.aggregate(proof, digest, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level and left to right, as one text."""
    return F.concat_ws("", F.transform(proof, lambda step: F.concat(step["before"], step["after"])))


def butterfly(nodes: DataFrame, staged: Staged) -> DataFrame:
    """``root`` of each group and ``path``, the steps up to it, for every node.

    ``nodes`` has ``group``, ``at`` (0 to ``n`` - 1 within it), ``n`` and ``node``, a digest. A lone node
    is the root, without steps. After k rounds each holds the root of its aligned run of ``FANOUT`` ** k nodes;
    where the last run of a level is not full, its nodes take turns to answer for those that lack there.
    """
    state = staged.put(nodes.select("group", "at", "n", "node", F.lit(None).cast(STEPS).alias("path")), "state")
    most, span = state.agg(F.max("n")).first()[0] or 1, 1
    while span < most:
        over = F.floor(F.col("at") / span)
        first = over - over % FANOUT
        last = F.least(first + FANOUT - 1, F.floor((F.col("n") - 1) / span))
        asks = state.where(F.col("n") > span).select(
            "group", "at", over.alias("over"), F.explode(F.sequence(first, last)).alias("run"),
            (F.col("at") % span).alias("low"), "n", F.when(F.col("run") == F.col("over"), F.col("path")).alias("path"))
        partner = F.col("run") * span + F.col("low") % F.least(F.lit(span), F.col("n") - F.col("run") * span)
        told = asks.withColumn("partner", partner).join(
            state.select("group", F.col("at").alias("partner"), F.col("node").alias("told")), ["group", "partner"])
        # Not more than the fanout to a group.
        met = told.groupBy("group", "at").agg(
            F.max("n").alias("n"), F.max("over").alias("over"), F.max("path").alias("path"),
            F.sort_array(F.collect_list(F.struct("run", "told"))).alias("met"))
        own = F.element_at(F.filter("met", lambda m: m["run"] == F.col("over")), 1)["told"]

        def beside(test) -> Column:
            return F.concat_ws("", F.transform(F.filter("met", test), lambda m: m["told"]))

        before, after = beside(lambda m: m["run"] < F.col("over")), beside(lambda m: m["run"] > F.col("over"))
        up = met.select("group", "at", "n", F.sha2(F.concat(before, own, after), 256).alias("node"),
                        F.concat(F.coalesce("path", F.array().cast(STEPS)), F.array(F.struct(before.alias("before"), after.alias("after")))).alias("path"))
        state = staged.put(up.unionByName(state.where(F.col("n") <= span)), "state")
        staged.drop("state", keep_last=1)
        span *= FANOUT
    return state.select("group", "at", F.col("node").alias("root"), F.coalesce("path", F.array().cast(STEPS)).alias("path"))


def _parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(leaves: list[str], size: int) -> list[list[str]]:
    """The nodes of each level of a block up to its root, that of a full block of ``size`` leaves even if there are fewer."""
    found = [leaves]
    while len(found[-1]) > 1 or FANOUT ** (len(found) - 1) < size:
        below = found[-1]
        found.append([_parent(below[k:k + FANOUT]) for k in range(0, len(below), FANOUT)])
    return found


def _block_roots(blocks: DataFrame, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, at, n, members = batch.columns
            # A lone block is as high as its leaves need.
            roots = [levels(m.values.field("leaf").to_pylist(), block if many.as_py() > 1 else 1)[-1][0]
                     for m, many in zip(members, n, strict=True)]
            yield pa.RecordBatch.from_arrays([group, at, n, pa.array(roots, pa.string())], names=["group", "at", "n", "node"])

    return blocks.select("group", "at", "n", "members").mapInArrow(run, "group string, at bigint, n bigint, node string")


def _proofs(blocks: DataFrame, block: int, outputs: str, carried: Sequence[str]) -> DataFrame:
    """A row for each member of a block, its own steps inside the block before those above."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n, path, subroot, root = (batch.column(c)[row].as_py() for c in ("n", "path", "subroot", "root"))
                members = batch.column("members")[row].values
                leaves = members.field("leaf").to_pylist()
                tree, proofs = levels(leaves, block if n > 1 else 1), []
                beside = []
                for nodes in tree[:-1]:
                    steps = []
                    for at in range(len(nodes)):
                        start = at - at % FANOUT
                        steps.append({"before": "".join(nodes[start:at]), "after": "".join(nodes[at + 1:start + FANOUT])})
                    beside.append(steps)
                for at in range(len(leaves)):
                    proofs.append([steps[at // FANOUT ** k] for k, steps in enumerate(beside)] + path)
                same = [pa.array([v] * len(leaves), pa.string()) for v in (subroot, root)]
                proof = pa.array(proofs, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
                yield pa.RecordBatch.from_arrays([*[members.field(c) for c in carried], *same, proof],
                                                 names=[*carried, "subroot", "root", "proof"])

    return blocks.mapInArrow(run, outputs)


def manifest(df: DataFrame, id: str = "doc_id", group: str = "lang", fields: Sequence[str] | None = None,
             claimed: Column | None = None) -> DataFrame:
    """``id``, ``leaf``, ``subroot`` (of the leaf's group), ``root`` and ``proof`` for every row.

    A leaf is the digest of the ``fields`` (all columns if not said) in that order, null told from empty. Leaves
    of a group ascend by id (null first, ties by digest), and every ``FANOUT`` consecutive nodes, at the end fewer, have
    the digest of their digests as parent, until one is left. Group roots, ordered by group (null first, else by bytes), go on
    likewise to the root. ``proof`` has a step for each level, the digests before and after; ``fold`` gives back
    the root. Rows may repeat: each is a leaf. A text may be of any length or null. An empty table has no
    leaves and gives no rows. With ``claimed`` another digest travels with each leaf and comes back under that name.

    A group of any size is dealt out by ranges to be numbered, and to blocks of ``BLOCK`` leaves after that.
    """
    staged, block = Staged(df.sparkSession, "merkle"), BLOCK
    rows = df.select(quoted(id).alias("id"), F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit("")).alias("group"),
                     leaf(*map(quoted, df.columns if fields is None else fields)).alias("leaf"),
                     *([claimed.alias("claimed")] if claimed is not None else []))
    carried = [c for c in rows.columns if c != "group"]
    leaves = numbered(staged.put(rows, "leaves"), "group", ["id", "leaf"], staged)
    sizes = leaves.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("n"))
    gathered = leaves.groupBy("group", F.floor(F.col("rank") / block).alias("at")).agg(
        F.sort_array(F.collect_list(F.struct("rank", *carried))).alias("members"))
    blocks = staged.put(gathered.join(small_side(sizes), "group"), "blocks")
    staged.drop("numbered")

    inner = staged.put(butterfly(_block_roots(blocks, block), staged), "inner")
    tops = numbered(staged.put(inner.where("at = 0").select(F.lit("").alias("all"), "group", F.col("root").alias("subroot")), "subroots"),
                    "all", ["group"], staged)
    count = tops.count()
    upper = butterfly(tops.select(F.col("all").alias("group"), F.col("rank").alias("at"), F.lit(count).cast("bigint").alias("n"),
                                  F.col("subroot").alias("node")), staged)
    joined = tops.join(upper.drop("group").withColumnRenamed("path", "above"), F.col("rank") == F.col("at")).select("group", "subroot", "root", "above")
    paths = (inner.select("group", "at", "path").join(small_side(joined), "group")
             .select("group", "at", "subroot", "root", F.concat("path", "above").alias("path")))
    outputs = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    proved = _proofs(blocks.join(paths, ["group", "at"]).select("n", "path", "subroot", "root", "members"), block,
                     f"{outputs}, subroot string, root string, proof {STEPS}", carried)
    return proved.withColumnRenamed("id", id) if id != "id" else proved


def tampered(text: Column) -> Column:
    """The text as a forger leaves it: A-Z in lower case."""
    return ascii_lower(text)
