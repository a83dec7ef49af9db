"""Repeated passages of lines: windows of consecutive lines that occurred before are taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, without

LINE_END = "\n"


def windows(rows: DataFrame, window: int) -> DataFrame:
    """``id``, ``digest``, ``at`` and ``words`` (an MD5) of every run of ``window`` lines."""
    lines = F.split(F.col("text"), LINE_END, -1)
    starts = F.sequence(F.lit(0), F.size("lines") - window)
    each = F.transform(starts, lambda i: F.unhex(F.md5(F.concat_ws(LINE_END, F.slice("lines", i + 1, window)))))
    return (rows.where(F.col("text").contains(LINE_END) if window > 1 else F.col("text").isNotNull())
            .select("id", "digest", lines.alias("lines")).where(F.size("lines") >= window)
            .select("id", "digest", F.posexplode(each).alias("at", "words")))


def dedup_lines(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = 3) -> DataFrame:
    """Replace ``text`` by the lines that no later occurrence of a window covers; add ``n_lines``, ``n_removed``.

    Every run of ``window`` lines counts, overlapping ones too. Its first occurrence is that of the
    smallest id (null first), text digest and position; all lines of each later one are covered, within the
    same text as well, and the union of what is covered is removed. Rows equal in id and text share
    their decisions. Texts of fewer lines stay; a text may become empty. Null texts stay null with
    no lines; other columns pass, those named like the outputs are replaced.

    Windows are counted and matched by key, so a passage that every document has is a partial count
    and a join that splits; the texts move once, to meet their covered positions.
    """
    narrow = df.select(quoted(id).alias("id"), F.xxhash64(quoted(text)).alias("digest"), quoted(text).alias("text"))
    found = windows(narrow, window)
    place = F.struct("id", "digest", "at")
    first = (found.groupBy("words").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
             .where("n > 1").drop("n"))
    later = found.join(first, "words").where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("id", "digest").agg(F.collect_set("at").alias("\x01starts"))
    covered = covered.withColumnsRenamed({"id": "\x01id", "digest": "\x01digest"})
    kept = without(df, "n_lines", "n_removed")
    rows = df.select(*map(quoted, kept)).join(
        covered, quoted(id).eqNullSafe(F.col("\x01id")) & (F.xxhash64(quoted(text)) == F.col("\x01digest")), "left")
    lines = F.split(quoted(text), LINE_END, -1)
    n = F.coalesce(F.size(lines), F.lit(0))
    n = F.when(quoted(text).isNull(), 0).otherwise(n)
    # Set operations, so that a long text costs no more than its lines.
    all_covered = F.flatten(F.transform("\x01starts", lambda s: F.sequence(s, s + window - 1)))
    left = F.array_except(F.sequence(F.lit(0), n - 1), all_covered)
    some = F.col("\x01starts").isNotNull()
    rest = F.array_join(F.transform(left, lambda i: F.get(lines, i)), LINE_END)
    out = [F.when(some, rest).otherwise(quoted(text)).alias(text) if c == text else quoted(c) for c in kept]
    return rows.select(*out, n.cast("bigint").alias("n_lines"),
                       F.when(some, n - F.size(left)).otherwise(0).cast("bigint").alias("n_removed"))
