"""JSON records to typed rows: lenient ids, two time encodings, three bad-record policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from ..functions import from_epoch_millis, from_epoch_seconds
from ..schemas import ENTITIES, ID_COLUMNS

REASON = "reject_reason"
RAW = "value"


def _text_schema(schema: StructType) -> StructType:
    """All fields as text, so that a number with a zero fraction is not lost in parsing."""
    fields = [StructField(f.name, StringType()) for f in schema.fields]
    return StructType([*fields, StructField("_corrupt", StringType())])


def _whole(text: Column) -> Column:
    """A bigint from integral number text: ``1345`` and ``1345.0``, but not ``12.5``."""
    exact = text.try_cast("decimal(38,9)")
    # Plain digits, the usual case, need no decimal arithmetic.
    return F.coalesce(text.try_cast("bigint"), F.when(exact == F.floor(exact), exact.try_cast("bigint")))


def parsed(df: DataFrame, entity: str, *, time_encoding: str = "iso", grain: str = "ms",
           time_shift_ms: int = 0, lenient_ids: bool = True) -> DataFrame:
    """``value`` text to the entity's columns, with ``reject_reason`` set on bad rows.

    Fields that the schema does not name are ignored. A record is bad if it is no
    JSON object, lacks a readable event time, holds another time that cannot be read, or a
    number that is not whole. ``time_encoding='number'`` keeps epoch times as whole numbers.
    """
    schema = ENTITIES[entity]
    record = F.from_json(F.col(RAW), _text_schema(schema),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # As a generated column the record is parsed once: a filter on it stays above the parse.
    rows = df.select(F.col(RAW), F.explode_outer(F.array(record)).alias("_r"))
    loose = set(ID_COLUMNS[entity]) if lenient_ids else set()
    columns, broken, no_other_time = [], F.lit(False), F.lit(False)
    for field in schema.fields:
        text = F.col(f"_r.{field.name}")
        if isinstance(field.dataType, LongType):
            value = _whole(text) if field.name in loose else text.try_cast("bigint")
            broken = broken | (text.isNotNull() & value.isNull())
        elif isinstance(field.dataType, TimestampNTZType):
            value = _time(text, time_encoding, grain, time_shift_ms)
            if field.name != "date_time":
                no_other_time = no_other_time | (text.isNotNull() & value.isNull())
        else:
            value = text
        columns.append(value.alias(field.name))
    no_time = _time(F.col("_r.date_time"), time_encoding, grain, time_shift_ms).isNull()
    reason = (F.when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
                     | (F.trim(F.col(RAW)) == ""), "not an object")
              .when(no_time, "no event time")
              .when(no_other_time, "unreadable time")
              .when(broken, "not a whole number"))
    return rows.select(F.col(RAW), *columns, reason.alias(REASON))


def _time(text: Column, encoding: str, grain: str, shift_ms: int) -> Column:
    if encoding == "number":
        return _whole(text)
    if encoding == "epoch_ms":
        millis = text.try_cast("bigint") + shift_ms
        return from_epoch_seconds(millis) if grain == "second" else from_epoch_millis(millis)
    if encoding != "iso":
        raise ValueError(f"time_encoding must be iso, epoch_ms or number, not {encoding!r}")
    # ISO text only: a bare number would be read as a year.
    iso = F.when(text.contains("T"), text.try_cast("timestamp_ntz"))
    if shift_ms:
        iso = F.timestamp_add("MILLISECOND", F.lit(shift_ms), iso)
    return F.date_trunc("second", iso).cast("timestamp_ntz") if grain == "second" else iso


def decode(df: DataFrame, entity: str, *, bad_data: str = "fail", **options) -> DataFrame:
    """Typed rows. ``bad_data='fail'`` stops the job at a bad record, ``'drop'`` leaves it out."""
    rows = parsed(df, entity, **options)
    if bad_data == "drop":
        kept = rows.where(F.col(REASON).isNull())
    elif bad_data == "fail":
        stop = F.raise_error(F.concat(F.lit(f"bad {entity} record ("), F.col(REASON), F.lit("): "),
                                      F.coalesce(F.col(RAW), F.lit("null"))))
        kept = rows.where(F.when(F.col(REASON).isNull(), F.lit(True)).otherwise(stop.cast("boolean")))
    else:
        raise ValueError(f"bad_data must be fail or drop, not {bad_data!r}")
    return kept.drop(RAW, REASON)


def rejects(df: DataFrame, entity: str, **options) -> DataFrame:
    """The records that ``decode`` would drop, each with its reason."""
    return parsed(df, entity, **options).where(F.col(REASON).isNotNull()).select(RAW, REASON)


def decode_and_reject(df: DataFrame, entity: str, **options) -> DataFrame:
    """Good rows and rejects of one pass: ``sink`` is ``good`` or ``reject``, with the entity's columns or the text and its reason."""
    rows = parsed(df, entity, **options)
    bad = F.col(REASON).isNotNull()
    fields = [F.when(~bad, F.col(f.name)).alias(f.name) for f in ENTITIES[entity].fields]
    return rows.select(F.when(bad, "reject").otherwise("good").alias("sink"), *fields, F.when(bad, F.col(RAW)).alias(RAW), REASON)


def with_epoch_times(df: DataFrame, times: dict[str, str]) -> DataFrame:
    """Keep epoch-millisecond columns and add computed second-grain times beside them."""
    return df.withColumns({new: from_epoch_seconds(F.col(old)) for old, new in times.items()})


def epoch_table(df: DataFrame, entity: str, *, bad_data: str = "fail") -> DataFrame:
    """JSON with epoch-ms times to a table that keeps the numbers and adds computed times.

    Ids may have a zero fraction, and bad records stop the job or are left out, as in ``decode``;
    ``rejects(..., time_encoding='number')`` returns them.
    """
    rows = decode(df, entity, time_encoding="number", bad_data=bad_data)
    times = {"date_time": "event_time"}
    if "expires" in rows.columns:
        times["expires"] = "expires_time"
    return with_epoch_times(rows, times)
