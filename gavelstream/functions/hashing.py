"""Reproducible pseudo-random values from a row number.

The functions return SQL expression text over a number column: a derivation has dozens
of them, and as text each column is a single expression for the planner to read.
"""

from __future__ import annotations

from collections.abc import Sequence


def digest_long(salt: str = "", n: str = "n") -> str:
    """First eight hex digits of the md5 of ``n`` followed by ``salt``, as a bigint."""
    text = f"cast({n} AS string)"
    salted = f"concat({text}, '{salt}')" if salt else text
    return f"cast(conv(substr(md5({salted}), 1, 8), 16, 10) AS bigint)"


def hash_id(n: str = "n") -> str:
    """The unsalted digest, which numbers persons and auctions."""
    return digest_long("", n)


def pick(values: Sequence[str], index: str) -> str:
    """The value at a zero-based index."""
    quoted = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({quoted}), cast(1 + {index} AS int))"


def letters(salt: str, shortest: int, n: str = "n") -> str:
    """``shortest`` to twice as many letters a..p, the hex digits of salted digests."""
    pieces = -(-2 * shortest // 32)
    hexes = ", ".join(f"md5(concat(cast({n} AS string), '{salt}{i}'))" for i in range(pieces))
    length = f"cast({shortest} + {digest_long(salt, n)} % {shortest + 1} AS int)"
    return f"substr(translate(concat({hexes}), '0123456789', 'ghijklmnop'), 1, {length})"
