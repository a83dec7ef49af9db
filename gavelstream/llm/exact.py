"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole.

Only DataFrame functions. What shuffles is lengths, digests and ids, never a text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .common import Staged, ascii_lower, quoted, without

BEGINNING = 256  # characters
MARKS = 1 << 23  # places of the bit map that tells the last pass which texts to read whole: 1 MB of bits


def normalised(text: Column) -> Column:
    """What is compared: null as empty, A-Z in lower case."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def _beginning(text: Column) -> Column:
    return F.xxhash64(normalised(F.substring(text, 1, BEGINNING)))


def _place(size: str, beginning: str) -> Column:
    return F.pmod(F.xxhash64(size, beginning), F.lit(MARKS))


def suspects(df: DataFrame, text: str, staged: Staged) -> DataFrame:
    """``word`` and ``bits``: a bit map of the (length, beginning) pairs that more than one row has.

    At most ``MARKS / 64`` rows. A length that one row alone has is settled before beginnings are counted.
    """
    brief = staged.put(df.select(F.coalesce(F.octet_length(quoted(text)), F.lit(0)).alias("size"),
                                 _beginning(quoted(text)).alias("beginning")), "brief")
    lengths = brief.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size")
    shared = (brief.join(small_side(lengths), "size", "left_semi")
              .groupBy("size", "beginning").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    placed = shared.select(_place("size", "beginning").alias("place"))
    return (placed.select((F.col("place") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place % 64 AS int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))


def with_digest(df: DataFrame, text: str, staged: Staged, out: str) -> DataFrame:
    """Add ``out``: SHA-256 (binary) of the normalised text where length and beginning are shared, else null."""
    marked = df.withColumns({"\x01size": F.coalesce(F.octet_length(quoted(text)), F.lit(0)), "\x01begins": _beginning(quoted(text))})
    marked = marked.withColumn("\x01place", _place("\x01size", "\x01begins"))
    marked = marked.withColumn("\x01word", (F.col("\x01place") / 64).cast("int"))
    bits = suspects(df, text, staged).withColumnsRenamed({"word": "\x01word", "bits": "\x01bits"})
    held = F.expr("shiftrightunsigned(`\x01bits`, cast(`\x01place` % 64 AS int)) & 1") == 1
    whole = F.when(held, F.unhex(F.sha2(normalised(quoted(text)), 256)))
    return marked.join(F.broadcast(bits), "\x01word", "left").select(*map(quoted, without(df, out)), whole.alias(out))


def exact_groups(df: DataFrame, id: str = "doc_id", text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep_id``, ``group_size`` and ``kept`` of every row, beside the columns ``keep`` (all of ``df`` if not said).

    Texts are equal if they are so after A-Z became lower case; null is the empty text. Of equal texts
    the row of the largest id stays, an id before none. Rows that share id and text share the decision, so all
    of them are ``kept`` or none; in a group without any id ``keep_id`` is null and its rows are kept.
    An empty table gives an empty result. Input columns named like the outputs are replaced.

    Lengths and beginnings that are met once settle a row without reading the rest of its text; the others
    are hashed whole. Members of a group are counted where they are read, so a group of any size is
    one row per task in the shuffle; only groups of two and more go to the join.
    """
    staged = Staged(df.sparkSession, "exact")
    kept = without(df if keep is None else df.select(*map(quoted, keep)), "keep_id", "group_size", "kept")
    rows = with_digest(df, text, staged, "\x01whole").select(*map(quoted, kept), quoted(id).alias("\x01id"), "\x01whole")
    if text not in kept:
        rows = staged.put(rows, "rows")
    groups = (rows.where(F.col("\x01whole").isNotNull()).groupBy(F.col("\x01whole").alias("\x01of"))
              .agg(F.max("\x01id").alias("\x01most"), F.count(F.lit(1)).alias("\x01n")).where(F.col("\x01n") > 1))
    # Rows of no group get keys of their own, so that a shuffled join spreads them.
    alone = F.encode(F.monotonically_increasing_id().cast("string"), "utf-8")
    found = rows.withColumn("\x01key", F.coalesce("\x01whole", alone)).join(
        small_side(groups), F.col("\x01key") == F.col("\x01of"), "left")
    keep_id = F.when(F.col("\x01n").isNull(), F.col("\x01id")).otherwise(F.col("\x01most"))
    return found.select(*map(quoted, kept), keep_id.alias("keep_id"), F.coalesce("\x01n", F.lit(1)).cast("bigint").alias("group_size"),
                        F.col("\x01id").eqNullSafe(keep_id).alias("kept"))


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each distinct text: that of the largest id. Columns as in ``df``; of rows alike in id and text any one."""
    whole = df.select(F.struct(*map(quoted, df.columns)).alias("row"), quoted(id).alias("id"), quoted(text).alias("text"))
    rows = exact_groups(whole, "id", "text").where("kept")
    single = F.col("group_size") == 1
    return (rows.withColumn("digest", F.when(~single, F.sha2(normalised(F.col("text")), 256)))
            .withColumn("alone", F.when(single, F.monotonically_increasing_id()))
            .dropDuplicates(["digest", "alone"]).select("row.*"))
