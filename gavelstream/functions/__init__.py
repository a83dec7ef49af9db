from .hashing import digest_long, hash_id, letters, pick
from .text import (
    epoch_millis,
    from_epoch_millis,
    from_epoch_seconds,
    iso_millis,
    iso_seconds,
    json_row,
)

__all__ = ["digest_long", "hash_id", "letters", "pick", "epoch_millis", "from_epoch_millis",
           "from_epoch_seconds", "iso_millis", "iso_seconds", "json_row"]
