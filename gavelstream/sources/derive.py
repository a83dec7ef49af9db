"""Persons, auctions and bids derived from event numbers, each row from its number alone.

Every function is a projection over a DataFrame that carries the number in ``n``:
no shuffle, no state, and Catalyst drops the digests of columns nobody reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digest_long, hash_id, letters, pick
from ..session import spread

# Fixed values of the workload.
FIRST_NAMES = ["Peter", "Paul", "Luke", "John", "Saul", "Vicky", "Kate", "Julie", "Sarah",
               "Deiter", "Johann"]
LAST_NAMES = ["Shultz", "Abrams", "Spencer", "White", "Bartels", "Walton", "Smith", "Jones",
              "Noris"]
MAIL_HOSTS = ["gmail.com", "yahoo.com", "hotmail.com"]
US_CITIES = ["Phoenix", "Los Angeles", "San Francisco", "Boise", "Portland", "Bend", "Redmond",
             "Seattle", "Kent", "Spokane"]
US_STATES = ["az", "ca", "ca", "id", "or", "or", "wa", "wa", "wa", "wa"]
AU_CITIES = ["Sydney", "Melbourne", "Brisbane", "Perth", "Adelaide"]
AU_STATES = ["nsw", "vic", "qld", "wa", "sa"]
HOT_CHANNELS = ["Google", "Facebook", "Baidu", "Apple"]
CYCLE, PERSONS, AUCTIONS = 50, 1, 3  # of 50 events: 1 person, 3 auctions, 46 bids
FIRST_ID, ID_RANGE = 1000, 1000
FIRST_CATEGORY, CATEGORIES = 10, 5
IN_FLIGHT = 100
HOT_EVERY = 100

START = "2024-01-01 00:00:00"
EVENTS_PER_SECOND = 100

PLACE = f"n % {CYCLE}"
IS_PERSON = f"{PLACE} < {PERSONS}"
IS_BID = f"{PLACE} >= {PERSONS + AUCTIONS}"
IS_AUCTION = f"NOT ({IS_PERSON}) AND NOT ({IS_BID})"
LAST_PERSON = f"{hash_id(f'n - {PLACE}')} % {ID_RANGE}"
LAST_AUCTION = f"{hash_id(f'n - {PLACE} + {PERSONS + AUCTIONS - 1}')} % {ID_RANGE}"


def numbers(spark: SparkSession, count: int, first: int = 0, partitions: int | None = None) -> DataFrame:
    """A bounded run of event numbers, split over ``partitions`` tasks."""
    return spark.range(first, first + count, 1, partitions).withColumnRenamed("id", "n")


def from_events(events: DataFrame) -> DataFrame:
    """The dense ``event_id`` of the events table as event number.

    Digests cost more than reading, so few splits are spread over all cores.
    """
    return spread(events.select(F.col("event_id").alias("n")))


def event_time(start: str = START, rate: int = EVENTS_PER_SECOND, shift_ms: int = 0) -> str:
    """Time of event ``n`` at ``rate`` events per second, to the millisecond."""
    return f"timestampadd(MILLISECOND, n * 1000 div {rate} + {shift_ms}, timestamp_ntz'{start}')"


def _below(salt: str, bound: int | str) -> str:
    return f"{digest_long(salt)} % {bound}"


def _usually(salt: str) -> str:
    """True for all but one in ``HOT_EVERY`` events."""
    return f"{_below(salt, HOT_EVERY)} > 0"


def _columns(df: DataFrame, shared: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """Project ``columns``; values that several of them use are named first, and so computed once."""
    named = df.selectExpr("n", *[f"{sql} AS {name}" for name, sql in shared.items()])
    return named.selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def person(numbered: DataFrame, **clock) -> DataFrame:
    card = ", ".join(f"1000 + {_below(f'cc{i}', 9000)}" for i in range(4))
    shared = {
        "first": pick(FIRST_NAMES, _below("fn", len(FIRST_NAMES))),
        "last": pick(LAST_NAMES, _below("ln", len(LAST_NAMES))),
        "american": f"{_below('au', 10)} < 9",
        "spot": digest_long("st"),
    }

    def local(american: list[str], australian: list[str]) -> str:
        return (f"CASE WHEN american THEN {pick(american, f'spot % {len(american)}')} "
                f"ELSE {pick(australian, f'spot % {len(australian)}')} END")

    return _columns(numbered.where(IS_PERSON), shared, {
        "id": f"{FIRST_ID} + {hash_id()} % {ID_RANGE}",
        "name": "concat(first, ' ', last)",
        "email_address": f"concat(lower(first), lower(last), '@', {pick(MAIL_HOSTS, _below('em', len(MAIL_HOSTS)))})",
        "credit_card": f"concat({card})",
        "city": local(US_CITIES, AU_CITIES),
        "state": local(US_STATES, AU_STATES),
        "date_time": event_time(**clock),
        "extra": letters("ex", 25),
    })


def auction(numbered: DataFrame, **clock) -> DataFrame:
    shared = {
        "item": f"concat('item-', {_below('it', 1001)})",
        "opening": f"100 + {_below('ib', 9901)}",
        "opened": event_time(**clock),
        "newest": LAST_PERSON,
    }
    return _columns(numbered.where(IS_AUCTION), shared, {
        "id": f"{FIRST_ID} + {hash_id()} % {ID_RANGE}",
        "item_name": "item",
        "description": f"concat('Description for ', item, ': ', {letters('de', 50)})",
        "initial_bid": "opening",
        "reserve": f"opening + 100 + {_below('re', 9901)}",
        "date_time": "opened",
        "expires": f"timestampadd(DAY, 1 + {_below('x', 7)}, opened)",
        "seller": f"{FIRST_ID} + CASE WHEN {_usually('hs')} THEN {_below('se', ID_RANGE)} "
                  f"ELSE newest - newest % {HOT_EVERY} END",
        "category": f"{FIRST_CATEGORY} + {_below('c', CATEGORIES)}",
        "extra": letters("ex", 25),
    })


def bid(numbered: DataFrame, **clock) -> DataFrame:
    shared = {
        "newest": LAST_AUCTION,
        "hot": f"{_below('ch', 2)} = 1",
        "famous": pick(HOT_CHANNELS, _below("hc", len(HOT_CHANNELS))),
        "number": f"1000 + {_below('ci', 9001)}",
    }
    oldest = f"greatest(0, newest - {IN_FLIGHT})"
    active = _below("a", f"(newest - {oldest} + 1)")
    last_person = LAST_PERSON
    return _columns(numbered.where(IS_BID), shared, {
        "auction": f"{FIRST_ID} + CASE WHEN {_usually('ha')} THEN {oldest} + {active} "
                   f"ELSE newest - newest % {HOT_EVERY} END",
        "bidder": f"{FIRST_ID} + CASE WHEN {_usually('hb')} THEN {_below('b', ID_RANGE)} "
                  f"ELSE 1 + ({last_person}) div {HOT_EVERY} * {HOT_EVERY} END",
        "price": f"floor(100 * (1 - 10 * ln((1 + {_below('p', 1000000)}) / 1000000.0D)))",
        "channel": "CASE WHEN hot THEN famous ELSE concat('channel-', number) END",
        "url": "CASE WHEN hot THEN concat('https://', lower(famous), '.com') "
               "ELSE concat('https://channel', number, '.com') END",
        "date_time": event_time(**clock),
        "extra": letters("ex", 25),
    })


DERIVATIONS = {"person": person, "auction": auction, "bid": bid}


def split_counts(numbered: DataFrame) -> DataFrame:
    """How many events of each kind the numbers hold."""
    kind = f"CASE WHEN {IS_PERSON} THEN 'person' WHEN {IS_BID} THEN 'bid' ELSE 'auction' END"
    return numbered.groupBy(F.expr(kind).alias("kind")).agg(F.count("*").alias("events"))
