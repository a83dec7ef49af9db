"""The queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embedding_dedup, exact, language, licenses, lines, merkle, mixing, quality, secrets, simhash, trie
from .common import Staged

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(documents, ids_only=True).select("doc_id", "fingerprint", "component_id")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    model = language.fit(documents.where(~out))
    return (language.identify(documents.select("doc_id", "text", out.alias("held_out")), model)
            .select("doc_id", "held_out", "lang_pred", "score", "ambiguous"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(documents).select("doc_id", "n_lines", "n_removed", "text")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_and_decode(documents, ranks, pattern).select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def dimensions(columns: list[str]) -> dict:
    """Source, language and the stand-in for a topic of the documents."""
    text = F.col("text")
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic(text, mixing.n_tokens(text))}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(documents, dimensions(documents.columns)).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"),
                        secrets.as_text(F.col("spans")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the held-out quarter are not learned from, so that the scores there can be judged."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.classify(documents, table(spark, sf_dir, "labels"), lambda id: ~language.held_out(id))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = Staged(spark, "trie")
    said = staged.put(trie.turns(table(spark, sf_dir, "conversations"), staged), "said")
    return trie.prefix_trie(*trie.with_openings(said, staged), staged).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = documents.withColumn("text_sha256", F.sha2(exact.normalised(F.col("text")), 256))
    return exact.exact_groups(hashed, keep=["doc_id", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(*LEAF)
    forged = merkle.leaf(*[merkle.tampered(F.col(c)) if c == "text" else F.col(c) for c in LEAF])
    meddled = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 0
    found = merkle.manifest(documents, fields=LEAF, claimed=F.when(meddled, forged))
    folded = merkle.fold(F.coalesce("claimed", "leaf"), F.col("proof"))
    return (found.withColumn("folded_root", folded)
            .select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash, "op2_nn_descent": op2_nn_descent, "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup, "op5_embedding_dedup": op5_embedding_dedup, "op6_licenses": op6_licenses, "op7_bpe": op7_bpe, "op8_mixing": op8_mixing, "op9_secrets": op9_secrets,
    "op10_quality": op10_quality, "op11_prefix_trie": op11_prefix_trie, "op12_exact_dedup": op12_exact_dedup, "op13_merkle": op13_merkle,
}

LINE_DEDUP_SQL = """
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
found AS (SELECT doc_id, text, ls, i AS pos, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS words
          FROM split, LATERAL (SELECT unnest(range(0, len(ls) - 2)) AS i)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, pos) AS n FROM found),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM numbered, (SELECT unnest(range(0, 3)) AS k) WHERE n > 1),
each AS (SELECT doc_id, i AS pos, ls[i + 1] AS line FROM split, LATERAL (SELECT unnest(range(0, len(ls))) AS i)),
rest AS (SELECT e.doc_id, string_agg(line, chr(10) ORDER BY e.pos) AS text, count(*) AS n
         FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.pos = c.pos WHERE c.pos IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(len(s.ls), 0)::BIGINT AS n_lines, (coalesce(len(s.ls), 0) - coalesce(r.n, 0))::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(r.text, '') END AS text
FROM documents d LEFT JOIN split s ON d.doc_id = s.doc_id LEFT JOIN rest r ON d.doc_id = r.doc_id
"""


def _mixing_sql() -> str:
    """The same fitting, its rounds written out one after the other."""
    names = ["source", "lang", "topic"]

    def marks(of: str) -> str:
        return f"(length(text) - length(translate(text, '{of}', '')))"

    parts = [
        "counted AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::BIGINT AS n_tokens FROM documents)",
        f"""kinds AS (SELECT *, CASE WHEN n_tokens = 0 THEN 'empty' WHEN 4 * {marks('|')} > n_tokens THEN 'table'
            WHEN {marks('!#$%&*')} > n_tokens THEN 'marked' WHEN {marks('0123456789')} > n_tokens THEN 'figures'
            ELSE 'prose' END AS topic FROM counted)""",
        "sums AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM kinds GROUP BY ALL HAVING sum(n_tokens) > 0)"]
    for n in names:
        parts.append(f"power_{n} AS (SELECT {n}, sum(tokens) AS n, pow(sum(tokens), {mixing.TEMPER}) AS p FROM sums GROUP BY {n})")
        parts.append(f"level_{n} AS (SELECT {n}, least(p / (SELECT sum(p) FROM power_{n}), {mixing.LIFT} * n / "
                     f"(SELECT sum(n) FROM power_{n})) AS p FROM power_{n})")
        parts.append(f"to_{n} AS (SELECT {n}, p / (SELECT sum(p) FROM level_{n}) AS share FROM level_{n})")
    joins = " ".join(f"JOIN to_{n} ON s.{n} IS NOT DISTINCT FROM to_{n}.{n}" for n in names)
    shares = ", ".join(f"to_{n}.share AS share_{n}" for n in names)
    parts.append(f"w0 AS MATERIALIZED (SELECT s.*, {shares}, tokens AS weight FROM sums s {joins})")
    for k in range(mixing.ROUNDS * len(names)):
        n = names[k % len(names)]
        parts.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (weight * share_{n} / sum(weight) OVER (PARTITION BY {n}) "
                     f"AS weight) FROM w{k})")
    last = f"w{mixing.ROUNDS * len(names)}"
    parts.append(f"ratios AS (SELECT source, lang, topic, round(weight / tokens / (SELECT max(weight / tokens) FROM {last}), 9) "
                 f"AS ratio FROM {last})")
    same = " AND ".join(f"k.{n} IS NOT DISTINCT FROM r.{n}" for n in names)
    parts.append(f"rows_ AS (SELECT k.*, CASE WHEN n_tokens = 0 THEN 1.0 ELSE coalesce(ratio, 0.0) END::DOUBLE AS probability "
                 f"FROM kinds k LEFT JOIN ratios r ON {same})")
    place = f"('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, 'none')), 1, {mixing.DIGITS}))::BIGINT / {float(16 ** mixing.DIGITS)}"
    return ("WITH " + ",\n".join(parts) + f"\nSELECT doc_id, source, lang, topic, n_tokens, probability, "
            f"{place} < probability AS kept FROM rows_")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

EXACT_SQL = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents) WINDOW same AS (PARTITION BY t)
"""


def _crc32_sql(digits: str) -> str:
    """Unsigned CRC-32 of a text of ASCII, bit by bit."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    codes = f"list_transform(range(1, length({digits}) + 1), lambda i: ascii(substr({digits}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


def _framed_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _tree_sql(name: str, deep: int) -> list[str]:
    """Levels over ``{name}0`` (g, pos, node, n) and what stands beside each node; a level of one node is passed on."""
    parts = []
    for k in range(deep):
        run = "PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
        parts.append(f"""{name}_beside{k} AS MATERIALIZED (SELECT g, pos, n,
            coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS low,
            coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS high FROM {name}{k})""")
        parts.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT g, pos // 8 AS pos, (max(n) + 7) // 8 AS n,
            CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE max(node) END AS node FROM {name}{k} GROUP BY g, pos // 8)""")
    return parts


def _fold_sql(rows: str, name: str, deep: int, at: str) -> list[str]:
    """Rows with ``g``, ``at``, ``folded`` and ``proof`` carried up the levels of a tree."""
    parts = []
    for k in range(deep):
        parts.append(f"""{rows}{k + 1} AS MATERIALIZED (SELECT r.* REPLACE (
            CASE WHEN b.n > 1 THEN sha256(low || folded || high) ELSE folded END AS folded, proof || low || high AS proof)
            FROM {rows}{k} r JOIN {name}_beside{k} b ON r.{at}g = b.g AND r.{at}pos // {8 ** k} = b.pos)""")
    return parts


def _merkle_sql(deep: int = 8, deep_top: int = 4) -> str:
    """Trees of up to 8 ** ``deep`` leaves a language and 8 ** ``deep_top`` languages."""
    fields = " || ".join(map(_framed_sql, LEAF))
    lower = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    forged = fields.replace(_framed_sql("text"), _framed_sql(lower))
    parts = [
        f"""leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({fields}) AS leaf,
            CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN sha256({forged}) ELSE sha256({fields}) END AS claimed FROM documents)""",
        """placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY g) AS n FROM leaves)""",
        "t0 AS MATERIALIZED (SELECT g, pos, n, leaf AS node FROM placed)", *_tree_sql("t", deep),
        f"""u0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, node, g AS lang FROM t{deep})""",
        *_tree_sql("u", deep_top),
        f"""rows0 AS MATERIALIZED (SELECT doc_id, leaf, p.g, p.pos, '' AS top_g, u.pos AS top_pos, u.node AS subroot, r.node AS root,
            claimed AS folded, '' AS proof FROM placed p JOIN u0 u ON p.g = u.lang CROSS JOIN u{deep_top} r)""",
        *_fold_sql("rows", "t", deep, ""), f"tops0 AS (SELECT * FROM rows{deep})", *_fold_sql("tops", "u", deep_top, "top_")]
    return ("WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, "
            f"folded = root AS verified FROM tops{deep_top}")


TRIE_SQL = f"""
WITH said AS (SELECT conv_id AS c, strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS said,
                     strlen(coalesce(text, '')) AS cost, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, sha256(said) AS digest, cost, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(said)) AS pos FROM said),
lengths AS (SELECT c, max(pos) AS own, c - c % 5 AS base, {_crc32_sql("c::VARCHAR")} % 9 AS h FROM own GROUP BY c),
convs AS MATERIALIZED (SELECT l.*, least(l.h, coalesce(b.own, 0)) AS taken FROM lengths l LEFT JOIN lengths b ON l.base = b.c),
rebuilt AS MATERIALIZED (
    SELECT v.c, o.pos, digest, cost FROM convs v JOIN own o ON o.c = v.base AND o.pos <= v.h
    UNION ALL SELECT v.c, o.pos - v.h + v.taken, digest, cost FROM convs v JOIN own o ON o.c = v.c AND o.pos > v.h),
paths AS MATERIALIZED (
    SELECT c, pos AS depth, cost, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY pos)) AS name FROM rebuilt
    UNION ALL SELECT c, 0, 0, '' FROM convs),
steps AS (SELECT *, lag(name) OVER (PARTITION BY c ORDER BY depth) AS parent, max(depth) OVER (PARTITION BY c) AS n FROM paths),
nodes AS MATERIALIZED (
    SELECT name, depth, min(c) AS conv_id, count(*) AS n_convs, max(cost) AS cost, max(parent) AS parent,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = n), '')) AS ends_sha256 FROM steps GROUP BY name, depth),
children AS (SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
owned AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM nodes v LEFT JOIN children k ON v.name = k.parent),
spoken AS (SELECT p.c, p.name, sum(CASE WHEN v.conv_id = p.c AND n_children = 0 THEN 1 ELSE 0 END) OVER below AS leaves,
                  sum(CASE WHEN v.conv_id = p.c THEN (n_convs - 1) * v.cost ELSE 0 END) OVER below AS saved
           FROM paths p JOIN owned v ON p.name = v.name WINDOW below AS (PARTITION BY p.c ORDER BY p.depth DESC)),
totals AS (SELECT name, sum(leaves)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM spoken GROUP BY name)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM owned v JOIN totals t ON v.name = t.name LEFT JOIN nodes u ON v.parent = u.name
"""

ORACLE: dict[str, str] = {
    "op4_line_dedup": LINE_DEDUP_SQL, "op8_mixing": _mixing_sql(), "op11_prefix_trie": TRIE_SQL, "op12_exact_dedup": EXACT_SQL,
    "op13_merkle": _merkle_sql()}
