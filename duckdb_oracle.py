"""The registered queries once more, as SQL for DuckDB, written from the query definitions.

The derivation, the window arithmetic and the joins are spelled out the plain way here
(cross with the window copies, every pair, rank over everything), which is what makes the
comparison worth something.
"""

from __future__ import annotations

from gavelstream.sources.damage import CASES, DAMAGE, DECIDES
from gavelstream.sources.derive import (
    AU_CITIES,
    AU_STATES,
    FIRST_NAMES,
    HOT_CHANNELS,
    LAST_NAMES,
    MAIL_HOSTS,
    US_CITIES,
    US_STATES,
)


def _h(salt: str = "", n: str = "n") -> str:
    text = f"({n})::varchar" + (f" || '{salt}'" if salt else "")
    return f"('0x' || substr(md5({text}), 1, 8))::bigint"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: list[str], index: str) -> str:
    return f"({_list(values)})[1 + ({index})]"


def _text(salt: str, low: int, pieces: int) -> str:
    hexes = " || ".join(f"md5(n::varchar || '{salt}{i}')" for i in range(pieces))
    return (f"substr(translate({hexes}, '0123456789', 'ghijklmnop'), 1, "
            f"({low} + {_h(salt)} % {low + 1})::int)")


FIRST_P, LAST_P = _pick(FIRST_NAMES, _h("fn") + " % 11"), _pick(LAST_NAMES, _h("ln") + " % 9")
TIME = "TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(n * 10)"
LAST_AUCTION = f"({_h('', 'n - n % 50 + 3')} % 1000)"
LAST_PERSON = f"({_h('', 'n - n % 50')} % 1000)"

PERSON = f"""person AS (
  SELECT 1000 + {_h()} % 1000 AS id,
         {FIRST_P} || ' ' || {LAST_P} AS name,
         lower({FIRST_P}) || lower({LAST_P}) || '@' || {_pick(MAIL_HOSTS, _h('em') + ' % 3')} AS email_address,
         {" || ".join(f"(1000 + {_h(f'cc{i}')} % 9000)::varchar" for i in range(4))} AS credit_card,
         CASE WHEN {_h('au')} % 10 < 9 THEN {_pick(US_CITIES, _h('st') + ' % 10')} ELSE {_pick(AU_CITIES, _h('st') + ' % 5')} END AS city,
         CASE WHEN {_h('au')} % 10 < 9 THEN {_pick(US_STATES, _h('st') + ' % 10')} ELSE {_pick(AU_STATES, _h('st') + ' % 5')} END AS state,
         {TIME} AS date_time,
         {_text('ex', 25, 2)} AS extra
  FROM (SELECT event_id AS n FROM events) WHERE n % 50 = 0)"""

AUCTION = f"""auction AS (
  SELECT 1000 + {_h()} % 1000 AS id,
         'item-' || ({_h('it')} % 1001)::varchar AS item_name,
         'Description for item-' || ({_h('it')} % 1001)::varchar || ': ' || {_text('de', 50, 4)} AS description,
         100 + {_h('ib')} % 9901 AS initial_bid,
         100 + {_h('ib')} % 9901 + 100 + {_h('re')} % 9901 AS reserve,
         {TIME} AS date_time,
         {TIME} + to_days((1 + {_h('x')} % 7)::int) AS expires,
         CASE WHEN {_h('hs')} % 100 > 0 THEN 1000 + {_h('se')} % 1000
              ELSE 1000 + ({LAST_PERSON} // 100) * 100 END AS seller,
         10 + {_h('c')} % 5 AS category,
         {_text('ex', 25, 2)} AS extra
  FROM (SELECT event_id AS n FROM events) WHERE n % 50 BETWEEN 1 AND 3)"""

BID = f"""bid AS (
  SELECT CASE WHEN {_h('ha')} % 100 > 0
              THEN 1000 + greatest(0, {LAST_AUCTION} - 100)
                   + {_h('a')} % ({LAST_AUCTION} - greatest(0, {LAST_AUCTION} - 100) + 1)
              ELSE 1000 + ({LAST_AUCTION} // 100) * 100 END AS auction,
         CASE WHEN {_h('hb')} % 100 > 0 THEN 1000 + {_h('b')} % 1000
              ELSE 1001 + ({LAST_PERSON} // 100) * 100 END AS bidder,
         floor(100 * (1 - 10 * ln((1 + {_h('p')} % 1000000) / 1000000.0::double)))::bigint AS price,
         CASE WHEN {_h('ch')} % 2 = 1 THEN {_pick(HOT_CHANNELS, _h('hc') + ' % 4')}
              ELSE 'channel-' || (1000 + {_h('ci')} % 9001)::varchar END AS channel,
         CASE WHEN {_h('ch')} % 2 = 1 THEN 'https://' || lower({_pick(HOT_CHANNELS, _h('hc') + ' % 4')}) || '.com'
              ELSE 'https://channel' || (1000 + {_h('ci')} % 9001)::varchar || '.com' END AS url,
         {TIME} AS date_time,
         {_text('ex', 25, 2)} AS extra
  FROM (SELECT event_id AS n FROM events) WHERE n % 50 >= 4)"""

ORIGIN = "TIMESTAMP '1970-01-01'"
ISO = "%Y-%m-%dT%H:%M:%S.%g"


def _with(*tables: str) -> str:
    return "WITH " + ",\n".join(tables) + "\n"


def _tumble(time: str, size: str) -> str:
    return f"time_bucket(INTERVAL {size}, {time}, {ORIGIN})"


def _hopped(source: str, keys: str, time: str, slide: str, size: str, copies: int, name: str) -> str:
    start = f"{_tumble(time, slide)} - k * INTERVAL {slide}"
    return (f"(SELECT {keys}, {start} AS window_start, {start} + INTERVAL {size} AS window_end, "
            f"count(*) AS {name} FROM {source}, range({copies}) t(k) GROUP BY ALL)")


def _json(fields: str, epoch: bool = False) -> str:
    """json_object text of 'a b c' columns; date_time and expires as ISO text or epoch milliseconds."""
    parts = []
    for name in fields.split():
        if name in ("date_time", "expires"):
            parts.append(f"'{name}', epoch_ms({name})" if epoch else f"'{name}', strftime({name}, '{ISO}')")
        else:
            parts.append(f"'{name}', {name}")
    return f"json_object({', '.join(parts)})::varchar"


PERSON_F = "id name email_address credit_card city state date_time extra"
AUCTION_F = "id item_name description initial_bid reserve date_time expires seller category extra"
BID_F = "auction bidder price channel url date_time extra"

IN_AUCTION = """inside AS (
  SELECT b.auction, b.price, b.date_time, c.category
  FROM bid b JOIN (SELECT DISTINCT id, category FROM auction) c ON b.auction = c.id
  WHERE EXISTS (SELECT 1 FROM auction a WHERE a.id = c.id AND a.category = c.category
                AND b.date_time BETWEEN a.date_time AND a.expires))"""


BID_AUCTION_PAIRS = """SELECT b.auction, b.price, b.date_time, a.category FROM bid b JOIN auction a ON a.id = b.auction
  WHERE b.date_time BETWEEN a.date_time AND a.expires"""


def _paired(name: str, where: str = "true", auction: str = "auction", bid: str = "bid") -> str:
    """Closing prices the plain way: every bid with every open auction of its id."""
    return f"""{name} AS (
  SELECT a.id AS auction, a.category, max(b.price) AS final, max(b.date_time) AS max_bid_time
  FROM {auction} a JOIN {bid} b ON a.id = b.auction
  WHERE b.date_time BETWEEN a.date_time AND a.expires AND {where}
  GROUP BY a.id, a.category)"""


def _average(closing: str) -> str:
    return (f"SELECT category, avg(final) AS avg_price, max(max_bid_time) AS max_date_time "
            f"FROM {closing} GROUP BY category")


CLOSING = _paired("closing")
HALFWAY = "TIMESTAMP '2024-01-01 00:00:06'"
BID_COUNTS = _hopped("bid", "auction", "date_time", "2 SECOND", "10 SECOND", 5, "bid_count")
HOT = (f"SELECT auction, bid_count, window_start, window_end FROM {BID_COUNTS} "
       "QUALIFY rank() OVER (PARTITION BY window_start ORDER BY bid_count DESC) = 1")
WINDOWED_BID = (f"SELECT auction, bidder, price, date_time, {_tumble('date_time', '10 SECOND')} AS window_start, "
                f"{_tumble('date_time', '10 SECOND')} + INTERVAL 10 SECOND AS window_end FROM bid")
HIGHEST = (f"SELECT auction, bidder, price, window_start, window_end FROM "
           f"(SELECT DISTINCT auction, bidder, price, window_start, window_end FROM ({WINDOWED_BID})) "
           "QUALIFY rank() OVER (PARTITION BY window_start ORDER BY price DESC) = 1")
SINGLE = (f"SELECT auction, bidder, price, window_start, window_end FROM ({WINDOWED_BID}) "
          "QUALIFY row_number() OVER (PARTITION BY window_start "
          "ORDER BY price DESC, date_time, auction, bidder) = 1")
NEW_SELLERS = f"""SELECT p.id AS person_id, p.name AS person_name, a.seller AS seller_id,
       p.w AS window_start, p.w + INTERVAL 10 SECOND AS window_end
FROM (SELECT DISTINCT id, name, {_tumble('date_time', '10 SECOND')} AS w FROM person) p
JOIN (SELECT DISTINCT seller, {_tumble('date_time', '10 SECOND')} AS w FROM auction) a
  ON p.id = a.seller AND p.w = a.w"""
ONE_NAME = f"""SELECT p.id AS person_id, p.name, a.seller AS seller_id, p.w + INTERVAL 10 SECOND AS window_end
FROM (SELECT id, name, {_tumble('date_time', '10 SECOND')} AS w FROM person
      QUALIFY row_number() OVER (PARTITION BY id, {_tumble('date_time', '10 SECOND')} ORDER BY date_time, name) = 1) p
JOIN (SELECT DISTINCT seller, {_tumble('date_time', '10 SECOND')} AS w FROM auction) a
  ON p.id = a.seller AND p.w = a.w"""
Q3 = """SELECT p.name, p.city, p.state, a.id, a.date_time
FROM auction a JOIN person p ON a.seller = p.id
WHERE a.category = 10 AND p.state IN ('or', 'id', 'ca')"""
Q6 = """SELECT bidder, avg(price) AS avg_price FROM (
  SELECT bidder, price FROM bid
  QUALIFY row_number() OVER (PARTITION BY bidder ORDER BY date_time DESC, auction, price) <= 10)
GROUP BY bidder"""
Q1 = "SELECT auction, bidder, (0.89 * price)::double AS price_euros, date_time FROM bid"
Q2 = ("SELECT auction, price, date_time FROM bid "
      "WHERE auction = 1007 OR auction = 1020 OR auction = 2001 OR auction = 2019 OR auction = 2087")
AFTER = """SELECT p.id AS person_id, p.name, a.id AS auction, p.date_time AS registered, a.date_time AS opened
FROM person p JOIN auction a ON p.id = a.seller
WHERE a.date_time BETWEEN p.date_time AND p.date_time + INTERVAL 10 SECOND"""
TUMBLED = (f"SELECT auction, {_tumble('date_time', '10 SECOND')} AS window_start, "
           f"{_tumble('date_time', '10 SECOND')} + INTERVAL 10 SECOND AS window_end, count(*) AS bid_count "
           "FROM bid GROUP BY ALL")
DISTINCT = (f"SELECT DISTINCT auction, bidder, {_tumble('date_time', '10 SECOND')} AS window_start, "
            f"{_tumble('date_time', '10 SECOND')} + INTERVAL 10 SECOND AS window_end FROM bid")
LEVELS = (f"SELECT auction, bid_count, window_start, window_end, level FROM {BID_COUNTS} c "
          "JOIN (VALUES ('busy', 5), ('very busy', 10)) l(level, least_count) ON bid_count >= least_count")
EPOCH_BID = ("SELECT auction, bidder, price, channel, url, date_trunc('second', date_time)::timestamp AS date_time, "
             "extra FROM bid")
PAIRS = """SELECT o_orderkey, o_orderpriority, o_orderdate, l_shipdate, l_quantity::bigint AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAY"""

SPREAD = f"""SELECT auction, {_tumble('date_time', '10 SECOND')} + INTERVAL 10 SECOND AS window_end,
    max(price) - min(price) AS spread, count(*) AS bids FROM bid GROUP BY ALL"""
TEN_HOURS = f"{_tumble('ts', '10 HOUR')} AS window_start, {_tumble('ts', '10 HOUR')} + INTERVAL 10 HOUR AS window_end"

# Queries over the given events and orders.
EVENTS = {
    "events_hop_hot_users": f"""SELECT user_id, event_count, window_start, window_end
        FROM {_hopped('events', 'user_id', 'ts', '2 HOUR', '10 HOUR', 5, 'event_count')}
        QUALIFY rank() OVER (PARTITION BY window_start ORDER BY event_count DESC) = 1""",
    "events_highest_value": f"""SELECT DISTINCT user_id, event_type, value, {TEN_HOURS}
        FROM events QUALIFY rank() OVER (PARTITION BY {_tumble('ts', '10 HOUR')} ORDER BY value DESC) = 1""",
    "events_purchases": """SELECT event_id, user_id, value * 0.89::DOUBLE AS value_euros, ts
        FROM events WHERE event_type = 'purchase'""",
    "segment_urgent_orders": """SELECT o_orderkey, o_orderdate, c_custkey, c_name, c_nationkey
        FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING'""",
    "events_single_highest": f"""SELECT event_id, user_id, event_type, value, {TEN_HOURS} FROM events
        QUALIFY row_number() OVER (PARTITION BY {_tumble('ts', '10 HOUR')} ORDER BY value DESC, event_id) = 1""",
    "events_last10_value": """SELECT user_id, avg(value) AS avg_value FROM (
        SELECT user_id, floor(value)::BIGINT AS value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10) GROUP BY user_id""",
    "events_tumble_count": f"SELECT event_type, {TEN_HOURS}, count(*) AS event_count FROM events GROUP BY ALL",
    "events_top_values": """SELECT user_id, event_id, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3""",
    "events_upsert_latest": """SELECT user_id, ts, event_id, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "events_first_type": """SELECT user_id, event_type FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) = 1""",
    "events_json_changelog": """
        SELECT json_object('before', CASE WHEN x.events IS NULL THEN NULL ELSE
                 json_object('event_type', event_type, 'events', x.events, 'total', x.total) END,
               'after', json_object('event_type', event_type, 'events', y.events, 'total', y.total),
               'op', CASE WHEN x.events IS NULL THEN 'c' ELSE 'u' END)::varchar AS value
        FROM (SELECT event_type, count(*) AS events, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL) y
        LEFT JOIN (SELECT event_type, count(*) AS events, sum(floor(value)::BIGINT)::BIGINT AS total FROM events
                   WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL) x USING (event_type)
        WHERE x.events IS DISTINCT FROM y.events OR x.total IS DISTINCT FROM y.total""",
    "events_json_records": f"""SELECT json_object('user_id', user_id, 'event_id', event_id,
        'value', floor(value)::BIGINT, 'ts', strftime(ts, '{ISO}'))::varchar AS value FROM events""",
    "events_errors_in_reach": """SELECT p.event_id AS purchase_id, p.user_id, p.ts, e.event_id AS error_id, e.ts AS error_ts
        FROM events p JOIN events e ON p.user_id = e.user_id
        WHERE p.event_type = 'purchase' AND e.event_type = 'error'
          AND e.ts BETWEEN p.ts AND p.ts + to_hours(floor(p.value)::BIGINT)""",
    "orders_followed_up": """SELECT u.o_custkey, u.o_orderkey AS urgent_order, u.o_orderdate AS urgent_date,
        o.o_orderkey, o.o_orderdate FROM orders u JOIN orders o ON u.o_custkey = o.o_custkey
        WHERE u.o_orderpriority = '1-URGENT' AND o.o_orderpriority <> '1-URGENT'
          AND o.o_orderdate BETWEEN u.o_orderdate AND u.o_orderdate + INTERVAL 10 DAY""",
    "lineitem_selection": """SELECT l_partkey, l_orderkey, l_linenumber, l_shipdate FROM lineitem
        WHERE l_partkey = 7 OR l_partkey = 20 OR l_partkey = 101 OR l_partkey = 119 OR l_partkey = 187""",
    "events_active_users": f"SELECT DISTINCT user_id, event_type, {TEN_HOURS} FROM events",
    "events_value_spread": f"""SELECT user_id, {_tumble('ts', '10 HOUR')} + INTERVAL 10 HOUR AS window_end,
        max(floor(value)::BIGINT) - min(floor(value)::BIGINT) AS spread, count(*) AS bids FROM events GROUP BY ALL""",
}

FIELDS = {"person": PERSON_F, "auction": AUCTION_F, "bid": BID_F}
LENIENT = {"person": {"id"}, "auction": {"id", "seller"}, "bid": {"auction", "bidder"}}
STRICT = {"initial_bid", "reserve", "category", "price"}


def _judged(kind: str) -> str:
    """Records damaged as their case calls for, read field by field, each with the reason to reject it."""
    entity = kind.removeprefix("epoch ")
    names, epoch = FIELDS[entity].split(), entity != kind
    cases = " ".join(f"WHEN {n} THEN regexp_replace(v, '{pattern}', '{by.replace('$', chr(92))}')"
                     for n, (pattern, by) in DAMAGE[kind].items())

    def value(name: str) -> str:
        whole = f"CASE WHEN try_cast(t_{name} AS DOUBLE) = floor(try_cast(t_{name} AS DOUBLE)) THEN try_cast(t_{name} AS DOUBLE)::BIGINT END"
        if name in ("date_time", "expires"):
            return whole if epoch else f"CASE WHEN t_{name} LIKE '%T%' THEN try_cast(t_{name} AS TIMESTAMP) END"
        if name in LENIENT[entity]:
            return whole
        return f"try_cast(t_{name} AS BIGINT)" if name in STRICT else f"t_{name}"

    numbers = [n for n in names if n in LENIENT[entity] | STRICT]
    broken = " OR ".join(f"(t_{n} IS NOT NULL AND {n} IS NULL)" for n in numbers)
    unreadable = "WHEN t_expires IS NOT NULL AND expires IS NULL THEN 'unreadable time'" if "expires" in names else ""
    return f"""damaged AS (
  SELECT CASE {DECIDES[kind]} % {CASES} WHEN 0 THEN 'junk' {cases} ELSE v END AS value
  FROM (SELECT {DECIDES[kind]}, {_json(FIELDS[entity], epoch)} AS v FROM {entity})),
read AS (
  SELECT value, json_valid(value) AS ok,
         CASE WHEN json_valid(value) THEN value ELSE '{{}}' END AS j FROM damaged),
texts AS (SELECT value, ok, {", ".join(f"json_extract_string(j, '$.{n}') AS t_{n}" for n in names)} FROM read),
fields AS (SELECT *, {", ".join(f"{value(n)} AS {n}" for n in names)} FROM texts),
judged AS (
  SELECT *, CASE WHEN NOT ok THEN 'not an object' WHEN date_time IS NULL THEN 'no event time' {unreadable}
                 WHEN {broken} THEN 'not a whole number' END AS reject_reason
  FROM fields)"""


def _accepted(entity: str) -> str:
    return f"SELECT {', '.join(FIELDS[entity].split())} FROM judged WHERE reject_reason IS NULL"


REJECTED = "SELECT value, reject_reason FROM judged WHERE reject_reason IS NOT NULL"

# Progress samples, computed by counting all events up to each sample time.
SAMPLES = """ticks AS (
  SELECT DISTINCT event_type AS topic, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS ts
  FROM events),
places AS (SELECT topic, ts, w AS worker FROM ticks, range(9) r(w)),
counts AS (
  SELECT event_type AS topic, user_id % 9 AS worker,
         time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR AS ts,
         count(*) AS events, max(floor(value)::bigint) AS cpu_pct
  FROM events GROUP BY ALL),
samples AS (
  SELECT p.topic, p.worker, p.ts,
         sum(coalesce(c.events, 0)) OVER (PARTITION BY p.topic, p.worker ORDER BY p.ts) AS "offset",
         coalesce(c.cpu_pct, 0) AS cpu_pct
  FROM places p LEFT JOIN counts c USING (topic, worker, ts)),
offsets AS (SELECT topic, ts, sum("offset")::bigint AS total_offset FROM samples GROUP BY topic, ts),
rates AS (
  SELECT topic, ts, events, seconds, events / seconds AS events_per_sec FROM (
    SELECT topic, ts, total_offset - lag(total_offset) OVER w AS events,
           date_diff('second', lag(ts) OVER w, ts) AS seconds
    FROM offsets WINDOW w AS (PARTITION BY topic ORDER BY ts)) WHERE seconds IS NOT NULL),
reads(query, topic) AS (VALUES ('q1', 'click'), ('q2', 'view'), ('q3', 'click'), ('q3', 'signup'),
                               ('q4', 'signup'), ('q4', 'view')),
writes(query, topic) AS (VALUES ('q1', 'purchase'), ('q2', 'error'), ('q3', 'purchase'), ('q4', 'error')),
inputs AS (
  SELECT query, ts, sum(events)::bigint AS events, max(seconds) AS seconds,
         sum(events) / max(seconds) AS events_per_sec FROM rates JOIN reads USING (topic) GROUP BY query, ts),
outputs AS (
  SELECT query, ts, sum(events)::bigint AS events, max(seconds) AS seconds
  FROM rates JOIN writes USING (topic) GROUP BY query, ts),
cores AS (
  SELECT query, count(*) AS samples, date_diff('second', min(ts), max(ts)) AS elapsed_sec,
         round(sum(cpu)::double * date_diff('second', min(ts), max(ts)) / (count(*) * 100))::bigint AS core_seconds
  FROM (SELECT query, ts, sum(cpu_pct) AS cpu FROM samples JOIN reads USING (topic) GROUP BY query, ts)
  GROUP BY query)"""


def _closed(sql: str, newest: str = "(SELECT max(date_time) FROM bid)") -> str:
    return f"SELECT * FROM ({sql}) WHERE window_end <= {newest} - INTERVAL 5 SECOND"


BOTH = "least((SELECT max(date_time) FROM person), (SELECT max(date_time) FROM auction))"


def _routed() -> str:
    return f"""SELECT 'person' AS topic, id::varchar AS key, {_json(PERSON_F)} AS value FROM person UNION ALL
            SELECT 'auction', id::varchar, {_json(AUCTION_F)} FROM auction UNION ALL
            SELECT 'bid', auction::varchar, {_json(BID_F)} FROM bid"""


def oracle() -> dict[str, str]:
    p, a, b = PERSON, AUCTION, BID
    counts = f"SELECT auction, bid_count, window_start, window_end FROM {BID_COUNTS}"
    before = _paired("before_closing", f"a.date_time < {HALFWAY} AND b.date_time < {HALFWAY}")
    early = _paired("before_closing", f"b.date_time < {HALFWAY}")
    queries = {
        "nx_split_counts": """SELECT CASE WHEN event_id % 50 = 0 THEN 'person'
            WHEN event_id % 50 <= 3 THEN 'auction' ELSE 'bid' END AS kind, count(*) AS events
            FROM events GROUP BY kind""",
        "hash_id": f"SELECT event_id AS n, {_h('', 'event_id')} AS hash_id FROM events",
        "nx_person": _with(p) + "SELECT * FROM person",
        "nx_auction": _with(a) + "SELECT * FROM auction",
        "nx_bid": _with(b) + "SELECT * FROM bid",
        "route_events": _with(p, a, b) + _routed(),
        "source_epoch_ms": _with(a) + """SELECT id, item_name, description, initial_bid, reserve,
            epoch_ms(date_time) AS date_time, epoch_ms(expires) AS expires, seller, category, extra,
            date_trunc('second', date_time)::timestamp AS event_time,
            date_trunc('second', expires)::timestamp AS expires_time FROM auction""",
        "source_epoch_ms_grain": _with(b) + EPOCH_BID,
        "source_from_timestamp": _with(b) + "SELECT * FROM bid WHERE date_time >= TIMESTAMP '2024-01-01 00:00:05'",
        "json_decode": _with(b, _judged("bid")) + _accepted("bid"),
        "json_decode_fail_mode": _with(a) + "SELECT * FROM auction",
        "json_rejects": _with(b, _judged("bid")) + REJECTED,
        "json_decode_auction": _with(a, _judged("auction")) + _accepted("auction"),
        "json_rejects_auction": _with(a, _judged("auction")) + REJECTED,
        "json_decode_person": _with(p, _judged("person")) + _accepted("person"),
        "json_rejects_person": _with(p, _judged("person")) + REJECTED,
        "source_epoch_ms_damaged": _with(a, _judged("epoch auction"), f"good AS ({_accepted('auction')})") + """
            SELECT *, date_trunc('second', make_timestamp(date_time * 1000))::timestamp AS event_time,
                   date_trunc('second', make_timestamp(expires * 1000))::timestamp AS expires_time FROM good""",
        "json_rejects_epoch_ms": _with(a, _judged("epoch auction")) + REJECTED,
        "q1_currency_conversion": _with(b) + Q1,
        "q2_selection": _with(b) + Q2,
        "q3_local_item_suggestion": _with(p, a) + Q3,
        "q4_bid_in_auction": _with(a, b) + BID_AUCTION_PAIRS,
        "q4_bid_in_open_category": _with(a, b, IN_AUCTION) + "SELECT * FROM inside",
        "q4_closing_price": _with(a, b, CLOSING) + "SELECT * FROM closing",
        "q4_category_avg": _with(a, b, CLOSING) + _average("closing"),
        "q4_category_avg_second_grain": _with(
            a, b,
            "a2 AS (SELECT id, category, date_trunc('second', date_time)::timestamp AS date_time, "
            "date_trunc('second', expires)::timestamp AS expires FROM auction)",
            "b2 AS (SELECT auction, price, date_trunc('second', date_time)::timestamp AS date_time FROM bid)",
            _paired("closing", auction="a2", bid="b2")) + _average("closing"),
        "q4_changelog": _with(a, b, CLOSING, before, f"x AS ({_average('before_closing')})",
                              f"y AS ({_average('closing')})") + """
            SELECT category, CASE WHEN x.avg_price IS NULL THEN 'c' WHEN y.avg_price IS NULL THEN 'd' ELSE 'u' END AS op,
                   x.avg_price AS before_avg, y.avg_price AS after_avg,
                   x.max_date_time AS before_time, y.max_date_time AS after_time
            FROM x FULL JOIN y USING (category)
            WHERE x.avg_price IS DISTINCT FROM y.avg_price OR x.max_date_time IS DISTINCT FROM y.max_date_time""",
        "q5_bid_counts": _with(b) + counts,
        "q5_hot_items": _with(b) + HOT,
        "q6_last10_avg": _with(b) + Q6,
        "q7_highest_bid": _with(b) + HIGHEST,
        "q7_single_highest": _with(b) + SINGLE,
        "q8_new_sellers": _with(p, a) + NEW_SELLERS,
        "q8_one_name": _with(p, a) + ONE_NAME,
        "interval_join": _with(p, a) + AFTER,
        "distinct_per_window": _with(b) + DISTINCT,
        "tumble_count": _with(b) + TUMBLED,
        "top_k_per_group": _with(b) + """SELECT auction, bidder, price, date_time FROM bid
            QUALIFY row_number() OVER (PARTITION BY auction ORDER BY price DESC, date_time, bidder) <= 3""",
        "upsert_latest": _with(b) + """SELECT auction, date_time, bidder, price FROM bid
            QUALIFY row_number() OVER (PARTITION BY auction ORDER BY date_time DESC, bidder DESC, price DESC) = 1""",
        "window_udaf": _with(b) + SPREAD,
        "udf_window_process": _with(b) + LEVELS,
        "json_encode": _with(b) + f"""SELECT json_object('auction', auction, 'bid_count', bid_count,
            'window_start', strftime(window_start, '{ISO}'), 'window_end', strftime(window_end, '{ISO}'))::varchar AS value
            FROM ({HOT})""",
        "json_hot_items_text_times": _with(b) + f"""SELECT json_object('auction', auction, 'bid_count', bid_count,
            'window_start', strftime(window_start, '%Y-%m-%dT%H:%M:%S'),
            'window_end', strftime(window_end, '%Y-%m-%dT%H:%M:%S'))::varchar AS value FROM ({HOT})""",
        "json_single_highest": _with(b) + f"""SELECT json_object('auction', auction, 'bidder', bidder,
            'price', price, 'window_end', epoch_ms(window_end))::varchar AS value FROM ({SINGLE})""",
        "json_one_name": _with(p, a) + f"""SELECT json_object('person_id', person_id, 'name', name,
            'seller_id', seller_id, 'window_end', epoch_ms(window_end))::varchar AS value FROM ({ONE_NAME})""",
        "json_upsert_records": _with(a, b, CLOSING) + f"""SELECT
            json_object('auction', auction, 'category', category)::varchar AS key,
            json_object('auction', auction, 'category', category, 'final', final,
                        'max_bid_time', strftime(max_bid_time, '{ISO}'))::varchar AS value FROM closing""",
        "json_changelog": _with(a, b, CLOSING, early) + f"""
            SELECT json_object('before', CASE WHEN x.final IS NULL THEN NULL ELSE
                     json_object('auction', auction, 'category', category, 'final', x.final,
                                 'max_bid_time', strftime(x.max_bid_time, '{ISO}')) END,
                   'after', json_object('auction', auction, 'category', category, 'final', y.final,
                                 'max_bid_time', strftime(y.max_bid_time, '{ISO}')),
                   'op', CASE WHEN x.final IS NULL THEN 'c' ELSE 'u' END)::varchar AS value
            FROM closing y LEFT JOIN before_closing x USING (auction, category)
            WHERE x.final IS DISTINCT FROM y.final OR x.max_bid_time IS DISTINCT FROM y.max_bid_time""",
        "orders_interval_lineitem": f"""SELECT o_orderpriority, avg(largest) AS avg_largest, max(latest) AS max_shipdate
            FROM (SELECT o_orderkey, o_orderpriority, max(quantity) AS largest, max(l_shipdate) AS latest
                  FROM ({PAIRS}) GROUP BY ALL) GROUP BY o_orderpriority""",
        "orders_lineitem_pairs": PAIRS,
        "customer_last10_orders": """SELECT o_custkey, count(*) AS orders, sum(floor(o_totalprice)::bigint)::bigint AS total,
            min(o_orderdate) AS since FROM (SELECT * FROM orders
            QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 10)
            GROUP BY o_custkey""",
        "hot_parts_hop": f"""SELECT l_partkey, line_count, window_start, window_end
            FROM {_hopped('lineitem', 'l_partkey', 'l_shipdate', '2 DAY', '10 DAY', 5, 'line_count')}
            QUALIFY rank() OVER (PARTITION BY window_start ORDER BY line_count DESC) = 1""",
        "customer_order_window_join": f"""SELECT u.o_custkey AS custkey, u.w AS window_start, u.w + INTERVAL 10 DAY AS window_end
            FROM (SELECT DISTINCT o_custkey, {_tumble('o_orderdate', '10 DAY')} AS w FROM orders
                  WHERE o_orderpriority = '1-URGENT') u
            JOIN (SELECT DISTINCT o_custkey, {_tumble('o_orderdate', '10 DAY')} AS w FROM orders
                  WHERE o_orderpriority <> '1-URGENT') r USING (o_custkey, w)""",
        **{name: sql for name, sql in EVENTS.items()},
        "topic_offsets": _with(SAMPLES) + "SELECT * FROM offsets",
        "topic_throughput": _with(SAMPLES) + "SELECT * FROM rates",
        "query_throughput": _with(SAMPLES) + "SELECT * FROM inputs",
        "sample_stats": _with(SAMPLES) + """SELECT topic, count(*) AS samples, avg(events) AS average,
            min(events) AS minimum, max(events) AS maximum,
            sqrt((sum(events * events) * count(*) - sum(events) * sum(events))::double) / count(*) AS deviation
            FROM rates WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-13' GROUP BY topic""",
        "core_seconds": _with(SAMPLES) + "SELECT * FROM cores",
        "bench_summary": _with(SAMPLES) + """SELECT query, i.r AS input_events_per_sec, i.e AS input_events,
            o.r AS output_events_per_sec, o.e AS output_events, samples, elapsed_sec, core_seconds,
            json_object('query', query, 'input_events', i.e, 'output_events', o.e, 'elapsed_sec', elapsed_sec,
                        'core_seconds', core_seconds)::varchar AS record
            FROM (SELECT query, sum(events) / sum(seconds) AS r, sum(events)::bigint AS e FROM inputs GROUP BY query) i
            JOIN (SELECT query, sum(events) / sum(seconds) AS r, sum(events)::bigint AS e FROM outputs GROUP BY query) o
              USING (query) JOIN cores USING (query)""",
        # Streams: the batch result, of windows that the last watermark has closed.
        "stream_route_events": _with(p, a, b) + _routed(),
        "stream_q8_of_topics": _with(p, a) + _closed(NEW_SELLERS, BOTH),
        "stream_json_decode_with_rejects": _with(a, _judged("auction")) + f"""
            SELECT 'good' AS sink, {", ".join(FIELDS["auction"].split())}, NULL::varchar AS value, NULL::varchar AS reject_reason
            FROM judged WHERE reject_reason IS NULL UNION ALL
            SELECT 'reject', {", ".join("NULL" for _ in FIELDS["auction"].split())}, value, reject_reason FROM judged WHERE reject_reason IS NOT NULL""",
        "stream_restart_after_failure": _with(a, b, CLOSING) + f"""
            SELECT 'file' AS sink, auction AS key, bid_count::double AS a, NULL::double AS b, window_start AS at FROM ({_closed(counts)}) UNION ALL
            SELECT 'upsert', auction, count(*)::double, max(price)::double, NULL FROM bid GROUP BY auction UNION ALL
            SELECT 'changelog', category, avg_price, NULL, max_date_time FROM ({_average("closing")})""",
        "stream_redelivered_events": f"""SELECT * FROM ({EVENTS["events_tumble_count"]})
            WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
        "stream_measured_offsets": """SELECT 'events' AS topic, count(*) AS total_offset, 0::bigint AS samples_back FROM events UNION ALL
            SELECT 'orders', count(*), 0 FROM orders UNION ALL SELECT 'lineitem', count(*), 0 FROM lineitem""",
        "stream_state_audit": "SELECT unnest([1, 2])::bigint AS operator, 0::bigint AS behind",
        "stream_source_epoch_ms": _with(b) + EPOCH_BID,
        "stream_json_persons_per_state": _with(p, _judged("person"), f"good AS ({_accepted('person')})") + _closed(
            f"""SELECT state, {_tumble('date_time', '10 SECOND')} AS window_start,
                {_tumble('date_time', '10 SECOND')} + INTERVAL 10 SECOND AS window_end, count(*) AS persons
                FROM good GROUP BY ALL""", "(SELECT max(date_time) FROM good)"),
        "stream_json_rejects_auction": _with(a, _judged("auction")) + REJECTED,
        "stream_q1_currency_conversion": _with(b) + Q1,
        "stream_q2_selection": _with(b) + Q2,
        "stream_q3_local_item_suggestion": _with(p, a) + Q3,
        "stream_q4_bid_in_auction": _with(a, b) + BID_AUCTION_PAIRS,
        "stream_q4_closing_price": _with(a, b, CLOSING) + "SELECT * FROM closing",
        "stream_q4_category_avg": _with(a, b, CLOSING) + _average("closing"),
        "stream_q4_late_bids": _with(a, b, CLOSING) + _average("closing"),
        "stream_q4_lagging_auctions": _with(a, b, CLOSING) + _average("closing"),
        "stream_q4_changelog": _with(a, b, CLOSING) + _average("closing"),
        "stream_window_udaf": _with(b) + _closed(SPREAD),
        **{f"stream_{name}": EVENTS[name] for name in (
            "events_purchases", "segment_urgent_orders", "events_last10_value", "events_active_users")},
        **{f"stream_{name}": _closed(EVENTS[name], "(SELECT max(ts) FROM events)") for name in (
            "events_hop_hot_users", "events_highest_value", "events_single_highest", "events_value_spread",
            "events_tumble_count")},
        "stream_q5_bid_counts": _with(b) + _closed(counts),
        "stream_q5_hot_items": _with(b) + _closed(HOT),
        "stream_q6_last10_avg": _with(b) + Q6,
        "stream_q7_highest_bid": _with(b) + _closed(HIGHEST),
        "stream_q7_single_highest": _with(b) + _closed(SINGLE),
        "stream_q8_new_sellers": _with(p, a) + _closed(NEW_SELLERS, BOTH),
        "stream_q8_one_name": _with(p, a) + _closed(ONE_NAME, BOTH),
        "stream_interval_join": _with(p, a) + AFTER,
        "stream_orders_lineitem_pairs": PAIRS,
        "stream_distinct_per_window": _with(b) + DISTINCT,
        "stream_tumble_count": _with(b) + _closed(TUMBLED),
        "stream_udf_window_process": _with(b) + _closed(LEVELS),
        "stream_upsert_latest": _with(b) + """SELECT auction, count(*) AS bids, max(price) AS highest
            FROM bid GROUP BY auction""",
    }
    events_per_window = (f"SELECT {_tumble('date_time', '10 SECOND')} AS window_start, "
                         f"{_tumble('date_time', '10 SECOND')} + INTERVAL 10 SECOND AS window_end, "
                         "count(*) AS events FROM {} GROUP BY ALL")
    on_time = f"""on_time AS (SELECT {TIME} AS date_time FROM (SELECT event_id AS n FROM events)
        WHERE n % 50 >= 4 AND NOT (n % 10 = 7 AND n < (SELECT (max(event_id) + 1) // 4 FROM events)))"""
    queries["stream_late_data"] = _with(b, on_time) + _closed(events_per_window.format("on_time"))
    queries["stream_restart"] = _with(b) + _closed(events_per_window.format("bid"))
    return queries
