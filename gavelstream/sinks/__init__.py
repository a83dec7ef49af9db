from .writers import (
    console,
    discard,
    json_records,
    keyed_records,
    kafka_writer,
    save_json,
    stream_json,
)

__all__ = ["console", "discard", "json_records", "keyed_records", "kafka_writer", "save_json", "stream_json"]
