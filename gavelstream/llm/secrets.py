"""Secrets in texts: three strong patterns, and weak parts that count only beside a complementary one.

Each text is searched in its task. Weak parts, which alone would be noise (a login name, an
opaque string, an address of a service), are then joined by interval with the parts near them in
the same text: one is reported if a part of another role stands within the scope and one of the
two is a secret.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, add_columns, quoted

KINDS = ["assign", "access", "hex", "identifier", "opaque", "endpoint"]  # also the order at one place
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier",
         "opaque": "secret", "endpoint": "endpoint"}
SCOPE = 200  # code points between two parts of one credential
SLOT = 1024

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Of a run of hex digits, whichever its length, a match is the whole run.
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""(?:user(?:name)?|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
                         re.I | re.A)
_IDENTIFIER_WORDS = ("user", "login", "client", "account", "access")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s"'<>]+""")

Span = tuple[int, int, int]  # start, place in KINDS, end


def strong(text: str, lower: str) -> list[Span]:
    """Matches of the base patterns, each leftmost and not overlapping within its kind."""
    found: list[Span] = []
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _mixed(word: str) -> bool:
    return any(map(str.isupper, word)) and any(map(str.islower, word)) and any(map(str.isdigit, word))


def weak(text: str, lower: str, taken: list[Span]) -> list[Span]:
    """Parts that need company, those that overlap a strong match left out."""
    found: list[Span] = []
    if any(w in lower for w in _IDENTIFIER_WORDS):
        found += [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)]
    if "://" in text:
        found += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in _OPAQUE.finditer(text) if _mixed(m[0])]
    if not found or not taken:
        return sorted(found)
    kept, at = [], 0
    for span in sorted(found):
        while at < len(taken) and taken[at][2] <= span[0]:
            at += 1
        # The first strong match that has not ended overlaps, or begins behind the span as all later ones do.
        if at == len(taken) or taken[at][0] >= span[2]:
            kept.append(span)
    return kept


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _arrow(rows: list[list[Span]]) -> pa.Array:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    return pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in r] for r in rows], kind)


def find(df: DataFrame, id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``df``: its id, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans``.

    ``base`` are the strong matches, ``spans`` those and the linked weak parts, each an array of
    (start, kind, end) in code points, end exclusive, ordered by start and kind. A null or empty
    text has none. Rows may share an id: equal texts share their links, others have their own.
    Other columns are not read, so none can clash. Whole texts are searched, whatever their length.
    """
    def search(texts: pa.Array) -> list[pa.Array]:
        bases, parts = [], []
        for t in texts.to_pylist():
            t = t or ""
            lower = t.lower()
            base = strong(t, lower)
            bases.append(base)
            parts.append(weak(t, lower, base))
        return [_arrow(bases), _arrow(parts)]

    staged = Staged(df.sparkSession, "secrets")
    narrow = df.select(quoted(id).alias("id"), F.xxhash64(quoted(text)).alias("digest"), quoted(text).alias("text"))
    found = staged.put(add_columns(narrow, ["text"], f"base {_SPAN}, weak {_SPAN}", search, keep=["id", "digest"]), "found")

    # Rows with weak parts; equal rows are one.
    some = found.where(F.size("weak") > 0).dropDuplicates(["id", "digest"])
    role = F.element_at(F.array(*[F.lit(ROLES[k]) for k in KINDS]), F.col("part.kind") + 1).alias("role")
    parts = some.select("id", "digest", F.explode(F.array_union("base", "weak")).alias("part")).select("id", "digest", "part", role)

    def slots(first, last):
        return F.explode(F.sequence(F.floor(first / SLOT), F.floor(last / SLOT))).alias("slot")

    needy = parts.where(F.col("part.kind") >= 3).select(
        "id", "digest", "part", "role", slots(F.greatest(F.col("part.start") - scope, F.lit(0)), F.col("part.end") + scope))
    near = parts.select(F.col("id").alias("id2"), F.col("digest").alias("digest2"), F.col("part").alias("part2"),
                        F.col("role").alias("role2"), slots(F.col("part.start"), F.col("part.end"))).withColumnRenamed("slot", "slot2")
    linked = needy.join(near, (F.col("digest") == F.col("digest2")) & (F.col("slot") == F.col("slot2"))
                        & F.col("id").eqNullSafe(F.col("id2")) & (F.col("role") != F.col("role2"))
                        & ((F.col("role") == "secret") | (F.col("role2") == "secret"))
                        & (F.col("part2.start") <= F.col("part.end") + scope)
                        & (F.col("part2.end") >= F.col("part.start") - scope), "left_semi")
    linked = (linked.groupBy("id", "digest").agg(F.collect_set("part").alias("linked"))
              .withColumnsRenamed({"id": "id2", "digest": "digest2"}))
    rows = found.join(linked, (F.col("digest") == F.col("digest2")) & F.col("id").eqNullSafe(F.col("id2")), "left")
    spans = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "linked")))

    def n(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return rows.select(F.col("id").alias(id), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                       "base", spans.alias("spans"))


def as_text(spans):
    """``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
