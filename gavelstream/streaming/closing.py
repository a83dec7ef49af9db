"""q4 as a stream: bids joined with open auctions in Spark's state store, averages kept current by upserts.

The join has a watermark on both sides and a bound on how long an auction can be open, which lets Spark
forget auctions that no bid can meet any more and bids that no auction can reach. Nothing is late as long as the
watermark stays ``LIFE`` behind the newest event: bids behind others, auctions behind their bids and any order of
arrival in between give the same result. A micro-batch of matched bids moves:

- ``closing``: the highest price per auction and category, an upsert table;
- ``sums`` and ``average``: per category, moved on by what the micro-batch changed;
- ``changes`` and ``records``: the change rows, and the same as JSON text.

These are written under the micro-batch number, so a repeated micro-batch writes the same folders again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.changes import changelog, changelog_records, upsert_latest
from ..operators.joins import listed
from ..plans import auctions as plan
from ..session import new_path, remove
from ..sources.tables import zone_free
from .carried import Folded
from .keyed import EVENT_TIME
from .run import batch_path, read_batches, start_batches, to_files

LIFE = "7 days"  # the longest that an auction is open, and the lateness its streams should have
SLOT = "1 day"  # auctions that opened in the same one may merge
HELD_INTERVALS = 100_000
HELD_LISTS, HELD_CELLS = 256, 1 << 18

CLOSINGS = "auction bigint, category bigint, final bigint, max_bid_time timestamp"
AVERAGES = "category bigint, avg_price double, max_date_time timestamp"
SUMS = "category bigint, total bigint, n bigint, max_date_time timestamp"
CHANGES = f"before struct<{AVERAGES.replace(' ', ':').replace(',:', ',')}>, " \
          f"after struct<{AVERAGES.replace(' ', ':').replace(',:', ',')}>, op string"
TABLES = {"sums": SUMS, "average": AVERAGES, "changes": CHANGES, "records": "value string"}


def _opened(auctions: DataFrame, life: str) -> DataFrame:
    """When auctions were open. One that is open longer than ``life`` stops the query: its bids could be missed."""
    too_long = F.col("expires") > F.col("date_time") + F.expr(f"INTERVAL {life}")
    checked = F.when(too_long, F.raise_error(F.lit(f"an auction is open longer than {life}")).cast("timestamp")).otherwise(F.col("expires"))
    return auctions.select("id", "category", F.col("date_time").alias("_opened"), checked.alias("_until"))


def _counts(met: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Per row of an auction id, a list of bids of one ``SLOT`` in order of time and a list of auctions by category: how many
    auctions of a category were open at each bid, where there was one.

    Counts are sums of +1 at the first bid of an auction and -1 behind its last, so bids and auctions are not compared one by
    one. At most ``HELD_CELLS`` sums of bids and categories are held, or those of one list of bids and one category.
    """
    ids, bids, auctions = met.columns
    (time, price), (category, opened, closed) = bids.flatten().flatten(), auctions.flatten().flatten()
    at, low, high = (c.cast(pa.int64()).to_numpy() for c in (time, opened, closed))
    bid_counts, auction_counts = (pc.list_value_length(c).to_numpy().astype(np.int64) for c in (bids, auctions))
    begin = np.cumsum(bid_counts) - bid_counts
    of_bid, of_auction = (np.repeat(np.arange(met.num_rows), n) for n in (bid_counts, auction_counts))
    # Times since the first bid of the list, each list in a range of its own: bids of all lists are in order.
    since, low, high = at - at[begin][of_bid], low - at[begin][of_auction], high - at[begin][of_auction]
    reach = since.max(initial=0)
    keys, start = of_bid * (reach + 3) + since + 1, of_auction * (reach + 3) + 1
    first = np.searchsorted(keys, start + np.clip(low, 0, reach + 1), "left") - begin[of_auction]
    behind = np.searchsorted(keys, start + np.clip(high, -1, reach), "right") - begin[of_auction]
    same = category.dictionary_encode(null_encoding="encode").indices.to_numpy()
    new = np.ones(len(same), dtype=bool)
    new[1:] = (same[1:] != same[:-1]) | (of_auction[1:] != of_auction[:-1])
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    row, ends = of_auction[head], np.append(head[1:], len(same))
    width = bid_counts[row] + 1
    until = np.cumsum(width)
    cells = until - width
    first, behind = cells[group] + first, cells[group] + behind
    done = 0
    while done < len(head):
        to = max(done + 1, int(np.searchsorted(until, cells[done] + HELD_CELLS, "right")))
        some = slice(head[done], ends[to - 1])
        up, down = (np.bincount(x[some] - cells[done], minlength=until[to - 1] - cells[done]) for x in (first, behind))
        total = np.cumsum(up - down)
        cell = np.flatnonzero(total)
        g = np.repeat(np.arange(done, to), width[done:to])[cell]
        bid = begin[row[g]] + cell + cells[done] - cells[g]
        order = np.argsort(bid, kind="stable")  # bid by bid and sorted by category
        g, bid = g[order], pa.array(bid[order])
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row[g])), price.take(bid), time.take(bid), category.take(pa.array(head[g])),
             pa.array(total[cell[order]], type=pa.int32())], names=["auction", "price", "date_time", "category", "pairs"])
        done = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, HELD_LISTS):
            yield from _counts(batch.slice(at, HELD_LISTS))


def matched_bids(auctions: DataFrame, bids: DataFrame, life: str = LIFE) -> DataFrame:
    """Every bid with every auction of its id that was open at its time, as a join of two streams; both need watermarks.

    A bid and a category come with the number of such auctions (``pairs``); ``each_pair`` makes one row of each. Pairs grow
    with the square of the input where ids are reused, and those of a bid and category are alike.

    The state store is not asked for each pair: tasks put a micro-batch's auctions of an id that opened in the same ``SLOT``
    into lists, and its bids likewise; lists meet in the join and are counted behind it, so a bid and category may come once
    for each list of auctions. The watermark judges a list by its newest time, so rows are kept up to a ``SLOT`` longer.
    """
    opened = _opened(auctions, life).where(F.col("_opened") <= F.col("_until"))
    opened = opened.withColumn("_slot", F.window("_opened", SLOT)["start"]).repartition("id", "_slot")
    made = bids.select("auction", "price", "date_time", F.window("date_time", SLOT)["start"].alias("_slot"))
    left, right = (listed(rows, [key, "_slot"], fields, newest).select(key, F.col("_newest").alias(name, metadata=EVENT_TIME), F.col("_listed").alias(held))
                   for rows, key, fields, newest, name, held in (
                       (opened, "id", ["category", "_opened", "_until"], "_opened", "_newest_opened", "_auctions"),
                       (made, "auction", ["date_time", "price"], "date_time", "_newest_bid", "_bids")))
    first, last = F.col("_newest_opened") - F.expr(f"INTERVAL {SLOT}"), F.col("_newest_opened") + F.expr(f"INTERVAL {life}") + F.expr(f"INTERVAL {SLOT}")
    # Every pair of the query lies in lists that meet here; the bounds are what lets Spark forget lists.
    met = left.join(right, (F.col("id") == F.col("auction")) & F.col("_newest_bid").between(first, last))
    kinds = StructType([*(made.schema[c] for c in ("auction", "price", "date_time")), opened.schema["category"], StructField("pairs", IntegerType())])
    return met.select("auction", "_bids", "_auctions").mapInArrow(_counted, kinds)


def each_pair(counted: DataFrame) -> DataFrame:
    """A row for each of the pairs that ``matched_bids`` counted; what was appended one by one, without a number, stays so."""
    pairs = F.array_repeat("category", F.coalesce("pairs", F.lit(1)))
    return counted.select("auction", "price", "date_time", F.explode(pairs).alias("category"))


def _covers(rows: pd.DataFrame) -> pd.DataFrame:
    """Disjoint intervals that cover exactly those of an id, category and slot, with the newest opening in each."""
    by = ["id", "category", "_slot"]
    rows = rows.sort_values([*by, "_from", "_to"], kind="stable", ignore_index=True)
    group = rows.groupby(by, sort=False, dropna=False).ngroup()
    reach = rows["_to"].groupby(group).cummax().groupby(group).shift()
    cover = (reach.isna() | (rows["_from"] > reach)).cumsum()
    return rows.groupby(cover, sort=False).agg(**{c: (c, "first") for c in (*by, "_from")}, _to=("_to", "max"), _newest=("_newest", "max"))


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The covers of a task's intervals; it holds a bounded number of intervals."""
    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count > HELD_INTERVALS:
            held = [_covers(pd.concat(held, ignore_index=True))]
            count = len(held[0])
            if count > HELD_INTERVALS // 2:
                yield held.pop()
                count = 0
    if count:
        yield _covers(pd.concat(held, ignore_index=True))


def open_intervals(auctions: DataFrame, life: str = LIFE) -> DataFrame:
    """The times when some auction of an id and category was open, as few intervals.

    Ids are reused, so a bid may meet very many open auctions of an id and category; for the closing price it counts that
    there is one. Auctions that a micro-batch brings and that opened in the same ``SLOT`` merge where they overlap. The
    watermark judges an interval by the newest opening it covers (``_newest``); its start is less than a ``SLOT`` before that.
    """
    opened = _opened(auctions, life).where(F.col("_opened") <= F.col("_until"))
    slot = F.window("_opened", SLOT)["start"]
    plain = opened.select("id", "category", F.unix_micros(slot).alias("_slot"), F.unix_micros("_opened").alias("_from"),
                          F.unix_micros("_until").alias("_to"), F.unix_micros("_opened").alias("_newest"))
    whole = plain.mapInPandas(_covered, plain.schema).repartition("id").mapInPandas(_covered, plain.schema)
    return whole.select("id", "category", F.timestamp_micros("_from").alias("_from"), F.timestamp_micros("_to").alias("_to"),
                        F.timestamp_micros("_newest").alias("_newest", metadata=EVENT_TIME))


def bids_while_open(auctions: DataFrame, bids: DataFrame, life: str = LIFE) -> DataFrame:
    """Bids of an id and category made while one of its auctions was open, as a join of two streams.

    A bid comes once for each of ``open_intervals`` that holds it: often enough for a maximum, too often to count.
    """
    at, newest = F.col("date_time"), F.col("_newest")
    # The last two follow from the first; they are what lets Spark forget bids and intervals.
    held = (at.between(F.col("_from"), F.col("_to")) & (at >= newest - F.expr(f"INTERVAL {SLOT}"))
            & (at <= newest + F.expr(f"INTERVAL {life}")))
    return open_intervals(auctions, life).join(
        bids.select("auction", "price", "date_time"), (F.col("id") == F.col("auction")) & held).select("auction", "price", "date_time", "category")


class ClosingPrices:
    """The results below ``root`` and one step per micro-batch of matched bids."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        for table in ("average", "changes", "records"):
            self._empty(table).write.mode("ignore").parquet(self._path(table, -1))
        self.closing = Folded(spark, f"{root}/closing", CLOSINGS, ["auction", "category"], _highest)

    def _empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[table])

    def _path(self, table: str, batch_id: int) -> str:
        return batch_path(f"{self.root}/{table}", batch_id)

    def _read(self, table: str, batch_id: int) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(self._path(table, batch_id)) if batch_id >= 0 else self._empty(table)

    def _write(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(self._path(table, batch_id))

    def _moved_sums(self, matched: DataFrame, batch_id: int) -> DataFrame:
        """Sums per category after this micro-batch, from those before and the closing prices it changed."""
        before = self.closing.read(batch_id - 1, only=(own := self.closing.add(plan.closing_price(matched), batch_id)))
        now = _highest(own.unionByName(before))

        def parts(closings: DataFrame, sign: int) -> DataFrame:
            return closings.select("category", (sign * F.col("final")).alias("total"), F.lit(sign).cast("bigint").alias("n"),
                                   F.col("max_bid_time").alias("max_date_time"))

        moved = self._read("sums", batch_id - 1).unionByName(parts(now, 1)).unionByName(parts(before, -1))
        return moved.groupBy("category").agg(*[F.sum(c).alias(c) for c in ("total", "n")], F.max("max_date_time").alias("max_date_time"))

    def step(self, matched: DataFrame, batch_id: int) -> None:
        self._write(self._moved_sums(matched, batch_id), "sums", batch_id)
        averages = self._read("sums", batch_id).select("category", (F.col("total") / F.col("n")).alias("avg_price"), "max_date_time")
        self._write(averages, "average", batch_id)
        changes = changelog(self._read("average", batch_id - 1), self._read("average", batch_id), ["category"])
        self._write(changes, "changes", batch_id)
        self._write(changelog_records(self._read("changes", batch_id)), "records", batch_id)
        # Micro-batch b reads what b - 1 carried, and starts only after b - 1 is committed.
        for table in ("sums", "average"):
            if batch_id >= 2:
                remove(self.spark, self._path(table, batch_id - 2))

    def all_batches(self, table: str) -> DataFrame:
        return read_batches(self.spark, f"{self.root}/{table}", self._empty(table).schema)

    def last_batch(self) -> int:
        """The newest micro-batch with an average, -1 before any."""
        return self.all_batches("average").agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]


def _highest(closings: DataFrame) -> DataFrame:
    return closings.groupBy("auction", "category").agg(
        F.max("final").alias("final"), F.max("max_bid_time").alias("max_bid_time"))


def run(auctions: DataFrame, bids: DataFrame, root: str | None = None) -> ClosingPrices:
    """Run over all input there is; a second run on the same ``root`` goes on from there."""
    spark = auctions.sparkSession
    root = root or new_path(spark, "q4")
    prices = ClosingPrices(spark, root)
    # A step reads its micro-batch once, so that nothing of it needs to be held.
    start_batches(bids_while_open(auctions, bids), prices.step, f"{root}/checkpoint", hold=False).awaitTermination()
    return prices


def bid_in_auction(auctions: DataFrame, bids: DataFrame, root: str | None = None) -> DataFrame:
    """Every bid with every auction open at its time, appended as soon as both are there: pairs that are alike once, with their number."""
    return each_pair(to_files(matched_bids(auctions, bids), "bid-in-auction", root))


def closing_price(auctions: DataFrame, bids: DataFrame, root: str | None = None) -> DataFrame:
    prices = run(auctions, bids, root)
    return zone_free(prices.closing.read(prices.closing.last()))


def current_average(prices: ClosingPrices) -> DataFrame:
    """The current average per category, read off the change rows."""
    latest = upsert_latest(
        prices.all_batches("changes").select(
            F.coalesce("after.category", "before.category").alias("category"), "batch_id", "after"),
        ["category"], ["batch_id"])
    return zone_free(latest.where(F.col("after").isNotNull()).select("after.*"))


def replayed_average(prices: ClosingPrices) -> DataFrame:
    """The current average per category, read off the JSON change records alone."""
    change = F.from_json("value", CHANGES).alias("c")
    rows = prices.all_batches("records").select("batch_id", change).select("batch_id", "c.*")
    latest = upsert_latest(rows.select(F.coalesce("after.category", "before.category").alias("category"), "batch_id", "after"),
                           ["category"], ["batch_id"])
    return zone_free(latest.where(F.col("after").isNotNull()).select("after.*"))


def category_average(auctions: DataFrame, bids: DataFrame, root: str | None = None) -> DataFrame:
    return current_average(run(auctions, bids, root))


def category_changelog(auctions: DataFrame, bids: DataFrame, root: str | None = None) -> DataFrame:
    return replayed_average(run(auctions, bids, root))
