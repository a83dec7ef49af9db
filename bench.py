"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query runs once to warm up and is then timed over full evaluation of its result.
Streams run from the first file to the last closed window, start-up included.
Core-seconds are the processor time the JVM used, driver, planning and compilers included.
"""

from __future__ import annotations

import json
import os
import time

from gavelstream.registry import ALL
from gavelstream.session import build_session, staging
from gavelstream.sinks import discard

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

BATCH = ["q1_currency_conversion", "q2_selection", "q3_local_item_suggestion", "q4_category_avg",
         "q5_hot_items", "q6_last10_avg", "q7_highest_bid", "q7_single_highest", "q8_new_sellers",
         "q8_one_name", "interval_join", "hot_parts_hop", "orders_interval_lineitem",
         "customer_last10_orders", "customer_order_window_join", "json_decode", "window_udaf",
         "bench_summary"]
STREAM = ["stream_q1_currency_conversion", "stream_q2_selection", "stream_q5_hot_items",
          "stream_q3_local_item_suggestion", "stream_q6_last10_avg",
          "stream_q7_highest_bid", "stream_q8_new_sellers", "stream_q4_category_avg"]

# Events a query reads, per 50 events of the workload's mix; other tables count as they are.
PERSON, AUCTION, BID = 1 / 50, 3 / 50, 46 / 50
READS = {"q1": BID, "q2": BID, "q3": PERSON + AUCTION, "q4": AUCTION + BID, "q5": BID, "q6": BID,
         "q7": BID, "q8": PERSON + AUCTION}


def cpu_seconds(spark) -> float:
    """Processor time that Spark's JVM has used so far."""
    with open(f"/proc/{spark.sparkContext._gateway.proc.pid}/stat") as stat:
        fields = stat.read().rsplit(")", 1)[1].split()
    return (int(fields[11]) + int(fields[12])) / os.sysconf("SC_CLK_TCK")


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=str(CPUS),
                          spark__ui__enabled="false", spark__driver__memory="16g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    seconds: dict[str, float] = {}
    core_seconds: dict[str, float] = {}
    for name in BATCH + STREAM:
        runs = []
        for _ in range(1 + (REPEATS if name in BATCH else 1)):
            used, began = cpu_seconds(spark), time.perf_counter()
            with staging(spark):
                discard(ALL[name](spark, SF_DIR))
            runs.append((time.perf_counter() - began, cpu_seconds(spark) - used))
        took, cores = min(runs[1:])
        seconds[name], core_seconds[name] = round(took, 3), round(cores, 3)
    rates = {}
    for name, took in seconds.items():
        share = READS.get(name.removeprefix("stream_").split("_")[0])
        if share:
            rates[name] = {"events_per_sec": round(events * share / took),
                           "core_seconds": core_seconds[name],
                           "events_per_core_sec": round(events * share / core_seconds[name])}
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
                      "cpus": CPUS, "rates": rates}))


if __name__ == "__main__":
    main()
