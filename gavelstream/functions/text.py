"""Time and JSON text as it travels on the wire; none of it depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def iso_millis(ts: Column) -> Column:
    """ISO text with three fraction digits and no zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a zone-free time."""
    return F.timestamp_diff("MILLISECOND", F.expr(EPOCH), ts)


def from_epoch_millis(millis: Column) -> Column:
    return F.timestamp_add("MILLISECOND", millis, F.expr(EPOCH))


def from_epoch_seconds(millis: Column) -> Column:
    """Zone-free time of epoch milliseconds, cut to whole seconds."""
    return F.timestamp_add("SECOND", F.floor(millis / 1000), F.expr(EPOCH))


def json_row(columns: dict[str, Column] | list[str]) -> Column:
    """One JSON object; times are written without a zone, strings are escaped."""
    if isinstance(columns, dict):
        fields = [value.alias(name) for name, value in columns.items()]
    else:
        fields = [F.col(name) for name in columns]
    return F.to_json(F.struct(*fields), {
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
        "ignoreNullFields": "false",
    })
