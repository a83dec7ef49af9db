"""Mixing a corpus to target shares of tokens by iterative proportional fitting, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, quoted, without

TEMPER, LIFT = 0.8, 1.5
ROUNDS = 12
ROUNDS_AT_ONCE = 3
DIGITS = 12  # hex digits of a row's place in the unit interval


def n_tokens(text: Column) -> Column:
    """Words of a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("bigint")


def marks(text: Column, of: str) -> Column:
    """How often these characters of ASCII occur; taking out one after the other is a search of bytes each."""
    rest = text
    for mark in of:
        rest = F.replace(rest, F.lit(mark), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def topic(text: Column, tokens: Column) -> Column:
    """A stated stand-in where documents have no topic: the kind of text by its marks per word."""
    return (F.when(tokens == 0, "empty")
            .when(4 * marks(text, "|") > tokens, "table")
            .when(marks(text, "!#$%&*") > tokens, "marked")
            .when(marks(text, "0123456789") > tokens, "figures")
            .otherwise("prose"))


def tempered(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """Shares of the levels of a dimension, evened out: in proportion to tokens to a power below one.

    No level gets more than ``LIFT`` times its share, or a rare one would set the size of the sample.
    """
    levels = cells.groupBy(dimension).agg(F.sum("tokens").alias("_n"))
    sums = levels.agg(F.sum(F.pow(F.col("_n"), exponent)).alias("powers"), F.sum("_n").alias("all")).first()
    powers, whole = float(sums["powers"] or 1), float(sums["all"] or 1)
    bounded = F.least(F.pow(F.col("_n"), exponent) / F.lit(powers), F.lit(LIFT) * F.col("_n") / F.lit(whole))
    levels = levels.select(dimension, bounded.alias("share"))
    held = float(levels.agg(F.sum("share").alias("s")).first()["s"] or 1)
    return levels.select(dimension, (F.col("share") / F.lit(held)).alias("share"))


def given(cells: DataFrame, dimension: str, shares: Mapping[str | None, float]) -> DataFrame:
    """Stated shares; levels that are not named get none."""
    whole = float(sum(shares.values())) or 1.0
    share = F.lit(0.0)
    for level, weight in shares.items():
        share = F.when(F.col(dimension).eqNullSafe(F.lit(level)), weight / whole).otherwise(share)
    return cells.select(dimension).distinct().select(dimension, share.alias("share"))


def raked(cells: DataFrame, dimensions: Sequence[str], targets: Mapping[str, Mapping[str | None, float]] | None = None,
          rounds: int = ROUNDS, exponent: float = TEMPER, staged: Staged | None = None) -> DataFrame:
    """Add ``weight``: the tokens of each cell, scaled in turn to the shares of each dimension.

    ``cells`` has one row per combination of levels that occurs, with ``tokens`` above zero. Each
    round scales to one dimension after the other, so the last one holds exactly and the others
    as closely as the rounds got; combinations that do not occur stay at zero.
    """
    staged = staged or Staged(cells.sparkSession, "mixing")
    for d in dimensions:
        share = (given(cells, d, targets[d]) if targets and d in targets else tempered(cells, d, exponent))
        share = share.select(F.col(d).alias("_level"), F.col("share").alias(f"_to_{d}"))
        cells = cells.join(share, F.col(d).eqNullSafe(F.col("_level"))).drop("_level")
    cells = staged.put(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for done in range(rounds):
        for d in dimensions:
            held = F.sum("weight").over(Window.partitionBy(d))
            cells = cells.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"_to_{d}") / held).otherwise(0.0))
        if (done + 1) % ROUNDS_AT_ONCE == 0 or done + 1 == rounds:
            cells = staged.put(cells, "cells")
            staged.drop("cells", keep_last=1)
    return cells.drop(*[f"_to_{d}" for d in dimensions])


def place(id: Column, seed: int) -> Column:
    """Where a row falls in the unit interval, by digest of its id: the same wherever and whenever it is computed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("none"))))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16 ** DIGITS)


def mix(df: DataFrame, dimensions: Mapping[str, Column], id: str = "doc_id", text: str = "text",
        targets: Mapping[str, Mapping[str | None, float]] | None = None, rounds: int = ROUNDS,
        exponent: float = TEMPER, seed: int = 1) -> DataFrame:
    """Add each dimension, ``n_tokens``, ``probability`` and ``kept``, a sample at the target shares of tokens.

    ``dimensions`` names the columns to rake by, each with its expression. A row's probability is its
    cell's calibrated weight over its tokens, divided by the largest such ratio, so the sample has
    the target shares in expectation and as many rows as that allows. Nulls are a level like any
    other. Rows without tokens have probability one: they weigh nothing. Rows that share an id are
    kept together. An empty table gives an empty result. Input columns named like the outputs are
    replaced, a dimension by its expression.

    One aggregation of the corpus to cells, work on the cells, and a join back by cell that Spark
    broadcasts if the cells are few by their size.
    """
    names = list(dimensions)
    staged = Staged(df.sparkSession, "mixing")
    kept = without(df, *names, "n_tokens", "probability", "kept")
    rows = df.withColumn("\x01tokens", n_tokens(quoted(text))).select(
        *map(quoted, kept), *[e.alias(f"\x01{n}") for n, e in dimensions.items()], F.col("\x01tokens"))
    cells = (rows.groupBy(*[F.col(f"\x01{n}").alias(f"d{i}") for i, n in enumerate(names)])
             .agg(F.sum("\x01tokens").alias("tokens")).where("tokens > 0"))
    by_number = {f"d{i}": (targets or {}).get(n) for i, n in enumerate(names)}
    found = raked(staged.put(cells, "sums"), list(by_number), {k: v for k, v in by_number.items() if v}, rounds, exponent, staged)
    ratios = found.withColumn("ratio", F.col("weight") / F.col("tokens"))
    most = ratios.agg(F.max("ratio").alias("m")).first()["m"] or 1.0
    ratios = ratios.select(*by_number, F.round(F.col("ratio") / F.lit(float(most)), 9).alias("ratio"))
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & F.col(f"\x01{n}").eqNullSafe(F.col(f"d{i}"))
    chance = F.when(F.col("\x01tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("ratio", F.lit(0.0)))
    return rows.join(ratios, same, "left").select(
        *map(quoted, kept), *[F.col(f"\x01{n}").alias(n) for n in names], F.col("\x01tokens").alias("n_tokens"),
        chance.alias("probability"), (place(quoted(id), seed) < chance).alias("kept"))
