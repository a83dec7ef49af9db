"""From documents to packed tokens: language, repeated lines, near duplicates, mixture, encoding."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstream.llm import bpe, language, lines, mixing, simhash
from gavelstream.llm.common import Staged
from gavelstream.llm.queries import RANKS, dimensions, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# A language must be more likely than all others together.
LEAST_SCORE = 0.5


ROW = "\x01row"


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns that a stage reads, and all others but the text as one, so that no output of an operator clashes with them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias(ROW), *columns)


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them as the stage left them."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("text") if c == "text" else F.col(ROW).getField(c).alias(c)
                         for c in docs.columns])


# Every stage takes null and empty texts, rows that repeat, and columns of any further name, which pass as they are;
# an empty table stays empty.

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told stay; a missing language is filled in.

    Rejected are texts without letters, null ones too, and those whose language is both ambiguous and unlikely.
    Rows that repeat are told alike; of languages that tie the first by name is taken.
    """
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    told = language.identify(packed(docs, "doc_id", "text"), model)
    rejected = (F.col("lang_pred") == language.UNKNOWN) | (F.col("ambiguous") & (F.col("score") < LEAST_SCORE))
    return unpacked(told.where(~rejected), docs, lang=F.coalesce(F.col(ROW).getField("lang"), "lang_pred"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line passages go; a document left without text goes too.

    Rows equal in id and text lose the same lines. Null texts and those that were empty stay.
    """
    rest = lines.dedup_lines(packed(docs, "doc_id", "text"))
    rest = rest.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    return unpacked(rest, docs, n_chars=F.length("text").cast("bigint"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id; of repeated rows one.

    Near duplicates share shingles of five words at a similarity of 0.8 or more. Texts without words, null ones too, are alike.
    """
    return simhash.first_of_similar(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens are shared out over sources, languages and topics as targeted.

    A null source or language is a level of its own; texts without tokens stay; rows that share an id stay or go together.
    """
    rows = mixing.mix(packed(docs, "doc_id", "text", "source", "lang"), dimensions(docs.columns))
    return unpacked(rows.where("kept"), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document, and whether decoding them gives the text again."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    encoded = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)
    return encoded.select("doc_id", "lang", "source", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
                         "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_dedup),
    ("mixing to target weights", mixture), ("byte-level BPE", encoding),
]

# The stages learn a model, link fingerprints and encode, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    staged = Staged(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged.put(stage(spark, docs, sf_dir), "docs")
        staged.drop("docs", keep_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
