"""Larger and skewed runs: python bench_scale.py [EVENTS] [plain|hot] [query ...]

Derives persons, auctions and bids to Parquet in a new scratch folder, then times the
queries over those files, in a second run. ``hot`` puts two thirds of the bids on one auction
and bidder, makes half of those alike in all but the hour, and gives one seller a third of the
auctions.
"""

from __future__ import annotations

import json
import sys
import tempfile
import time

from pyspark.sql import functions as F

from bench import READS, cpu_seconds
from gavelstream.operators.windows import hop, hop_count, tumble, window_count
from gavelstream.plans import auctions as plan
from gavelstream.session import build_session
from gavelstream.sinks import discard
from gavelstream.sources import derive
from gavelstream.sources.tables import parquet_files

QUERIES = {
    "q1": lambda p, a, b: plan.currency_conversion(b),
    "q2": lambda p, a, b: plan.selection(b),
    "q3": lambda p, a, b: plan.local_item_suggestion(p, a),
    "q4": lambda p, a, b: plan.average_price_by_category(a, b),
    "q5": lambda p, a, b: plan.hot_items(b),
    "q6": lambda p, a, b: plan.last_bids_average(b),
    "q7": lambda p, a, b: plan.highest_bid(b),
    "q7_single": lambda p, a, b: plan.single_highest_bid(b),
    "q8": lambda p, a, b: plan.new_sellers(p, a),
    "interval_join": lambda p, a, b: plan.auctions_after_registration(p, a),
    "tumble_count": lambda p, a, b: window_count(b, ["auction"], tumble("date_time", plan.SIZE), "n"),
    "hop_direct": lambda p, a, b: window_count(b, ["auction"], hop("date_time", plan.SLIDE, plan.SIZE), "n"),
    "hop_panes": lambda p, a, b: hop_count(b, ["auction"], "date_time", plan.SLIDE, plan.SIZE, "n"),
    "hop_direct_sparse": lambda p, a, b: window_count(b, ["price"], hop("date_time", plan.SLIDE, plan.SIZE), "n"),
    "hop_panes_sparse": lambda p, a, b: hop_count(b, ["price"], "date_time", plan.SLIDE, plan.SIZE, "n"),
}


def skewed(bids):
    share = F.pmod(F.xxhash64("date_time", "price"), F.lit(3))
    one = {"auction": F.lit(1007), "bidder": F.lit(1001)}
    copies = {"price": F.lit(20_000), "date_time": F.date_trunc("hour", "date_time").cast("timestamp_ntz"),
              "channel": F.lit("Google"), "url": F.lit("https://google.com"), "extra": F.lit("x")}
    hot = {c: F.when(share < 2, v).otherwise(F.col(c)) for c, v in one.items()}
    same = {c: F.when(share == 1, v).otherwise(F.col(c)) for c, v in copies.items()}
    return bids.withColumns(same | hot).select(*bids.columns)


def main(count: int, kind: str, names: list[str]) -> None:
    spark = build_session("scale", "local[8]", spark__sql__shuffle__partitions="32", spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    tables = []
    for name, make in derive.DERIVATIONS.items():
        df = make(derive.numbers(spark, count, partitions=32), rate=10_000)
        if kind == "hot" and name == "bid":
            df = skewed(df)
        if kind == "hot" and name == "auction":
            df = df.withColumn("seller", F.when(F.col("id") % 3 == 0, 1001).otherwise(F.col("seller")))
        df.write.parquet(f"{root}/{name}")
        tables.append(parquet_files(spark, name, f"{root}/{name}"))
    for name in names or QUERIES:
        discard(QUERIES[name](*tables))
        used, began = cpu_seconds(spark), time.perf_counter()
        discard(QUERIES[name](*tables))
        took, cores = time.perf_counter() - began, cpu_seconds(spark) - used
        read = count * READS.get(name.split("_")[0], 1)
        print(json.dumps({"query": name, "kind": kind, "events": count, "sec": round(took, 2),
                          "events_per_sec": round(read / took), "core_seconds": round(cores, 1),
                          "events_per_core_sec": round(read / cores)}), flush=True)


if __name__ == "__main__":
    main(int(float(sys.argv[1])) if len(sys.argv) > 1 else 1_000_000,
         sys.argv[2] if len(sys.argv) > 2 else "plain", sys.argv[3:])
