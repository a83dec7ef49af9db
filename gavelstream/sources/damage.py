"""JSON records with damage of known kinds, for queries that must cope with bad data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CASES = 20  # a record's case is a number of its own modulo this

# The number that decides, and by case what is replaced in the record, and by what. In case 0
# the record is no JSON; in a case that is not named it is whole.
DECIDES = {"bid": "price", "auction": "initial_bid", "person": "id", "epoch auction": "initial_bid"}
DAMAGE: dict[str, dict[int, tuple[str, str]]] = {
    "bid": {
        1: ('"auction":([0-9]+)', '"auction":$1.0'),
        2: ('"auction":([0-9]+)', '"auction":$1.5'),
        3: ('"date_time":"[^"]*"', '"date_time":null'),
        4: ("^[{]", '{"unknown":1,'),
        5: ('"channel":"[^"]*",', ""),
    },
    "auction": {
        1: ('"id":([0-9]+)', '"id":$1.0'),
        2: ('"seller":([0-9]+)', '"seller":$1.5'),
        3: ('"date_time":"[^"]*"', '"date_time":null'),
        4: ("^[{]", '{"unknown":[1],'),
        5: ('"item_name":"[^"]*",', ""),
        6: ('"expires":"[^"]*"', '"expires":"junk"'),
        7: ('"reserve":[0-9]+', '"reserve":"many"'),
        8: ('"expires":"[^"]*",', ""),
    },
    "person": {
        1: ('"id":([0-9]+)', '"id":$1.0'),
        2: ('"id":([0-9]+)', '"id":$1.5'),
        3: ('"date_time":"[^"]*"', '"date_time":null'),
        4: ("^[{]", '{"unknown":{},'),
        5: ('"city":"[^"]*",', ""),
        6: ('"date_time":"[^"]*"', '"date_time":"soon"'),
        7: ('"date_time":"[^"]*"', '"date_time":2024'),
    },
    "epoch auction": {
        1: ('"id":([0-9]+)', '"id":$1.0'),
        2: ('"seller":([0-9]+)', '"seller":$1.5'),
        3: ('"date_time":[0-9]+', '"date_time":null'),
        4: ("^[{]", '{"unknown":1,'),
        5: ('"item_name":"[^"]*",', ""),
        6: ('"expires":[0-9]+', '"expires":"junk"'),
        7: ('"date_time":([0-9]+)', '"date_time":$1.5'),
    },
}


def damaged(records: DataFrame, kind: str, case: str = "_case") -> DataFrame:
    """``value`` of records as their ``case`` (0 to ``CASES`` - 1) calls for."""
    changed = F.when(F.col(case) == 0, F.lit("junk"))
    for number, (pattern, by) in DAMAGE[kind].items():
        changed = changed.when(F.col(case) == number, F.regexp_replace("value", pattern, by))
    return records.select(changed.otherwise(F.col("value")).alias("value"))
