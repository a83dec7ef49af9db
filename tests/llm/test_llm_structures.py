"""Prefix trie, exact duplicates and Merkle manifest against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from conftest import SF_DIR

from gavelstream.llm import exact, merkle, numbering, queries, trie
from gavelstream.llm.common import Staged


def given(spark, name="documents"):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- numbering ---

def test_numbers_within_groups_of_any_size(spark):
    random.seed(3)
    rows = [("hot", random.randrange(50)) for _ in range(4000)] + [(f"g{i % 700}", i) for i in range(3000)] + [("same", 1)] * 3000
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    found = numbering.numbered(Staged(spark, "t").put(df, "in"), "g", ["v"], Staged(spark, "t")).collect()
    by = defaultdict(list)
    for r in found:
        by[r["g"]].append((r["rank"], r["v"]))
    assert len(found) == len(rows) and all([r for r, _ in sorted(v)] == list(range(len(v))) for v in by.values())
    assert all([x for _, x in sorted(v)] == sorted(x for _, x in v) for v in by.values())


# --- exact duplicates ---

def slow_exact(rows):
    groups = defaultdict(list)
    for id, text in rows:
        groups[lower(text)].append(id)
    out = []
    for id, text in rows:
        ids = groups[lower(text)]
        most = max((i for i in ids if i is not None), default=None)
        out.append((id, most, len(ids), id == most, sha(lower(text))))
    return sorted(out, key=repr)


def exact_rows(df):
    hashed = df.withColumn("text_sha256", exact.F.sha2(exact.normalised(exact.F.col("text")), 256))
    rows = exact.exact_groups(hashed, keep=["doc_id", "text_sha256"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted(map(tuple, rows.collect()), key=repr)


TEXTS = [(1, None), (2, ""), (3, "Same Start " * 40 + "a"), (4, "same start " * 40 + "b"), (5, "SAME START " * 40 + "A"), (6, "Ä É"), (7, "ä é"),
         (8, "Äa É"), (9, "ÄA É"), (9, "ÄA É"), (None, "ÄA É"), (None, "alone"), (None, "ALONE"), (10, "x" * 300_000), (11, "X" * 300_000),
         (12, "x" * 299_999 + "y"), (13, "İ"), (14, "i̇"), (15, " one"), (16, "one "), (17, "unique")]


def test_exact_equals_brute_force_on_odd_rows(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    assert exact_rows(df) == slow_exact(TEXTS)


def test_exact_equals_brute_force_on_the_table(spark):
    rows = [tuple(r) for r in given(spark).select("doc_id", "text").collect()]
    assert exact_rows(given(spark).select("doc_id", "text")) == slow_exact(rows)


def test_exact_keeps_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in TEXTS], "doc_id bigint, text string, whole string, size int, kept string, id string")
    full = exact.exact_groups(df).collect()
    assert len(full) == len(TEXTS) and {r["whole"] for r in full} == {"x"} and all(isinstance(r["kept"], bool) for r in full)
    one = exact.one_of_each(df)
    assert one.columns == df.columns and sorted(lower(r["text"]) for r in one.collect()) == sorted({lower(t) for _, t in TEXTS})
    assert exact.exact_groups(df.where("false")).collect() == []


def test_exact_with_more_suspects_than_broadcast_allows(spark, monkeypatch):
    monkeypatch.setattr(exact, "small_side", lambda df: df)
    monkeypatch.setattr(exact, "MARKS", 128)
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    assert exact_rows(df) == slow_exact(TEXTS)


def test_exact_plan_has_no_python(spark, capsys):
    queries.op12_exact_dedup(spark, SF_DIR).explain("formatted")
    assert "Arrow" not in capsys.readouterr().out


# --- Merkle manifest ---

def framed(value):
    if value is None:
        return "-"
    return f"{len(str(value).encode())}:{value}"


def up(nodes):
    """Levels from the leaves to the root."""
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][k:k + 8])) for k in range(0, len(found[-1]), 8)])
    return found


def steps(tree, at):
    out = []
    for nodes in tree[:-1]:
        start = at - at % 8
        out.append(("".join(nodes[start:at]), "".join(nodes[at + 1:start + 8])))
        at //= 8
    return out


def slow_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, sha("".join(map(framed, r))), r))
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: up([n for *_, n, _ in sorted(by[g], key=lambda x: x[:3])]) for g in names}
    top = up([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for at, (*_, node, row) in enumerate(sorted(by[g], key=lambda x: x[:3])):
            proof = steps(trees[g], at) + steps(top, i)
            folded = node
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                folded = sha("".join(map(framed, (*row[:4], None if row[4] is None else lower(row[4])))))
            for before, after in proof:
                folded = sha(before + folded + after)
            root = top[-1][0]
            out.append((row[0], node, trees[g][-1][0], root, sha("".join(b + a for b, a in proof)), folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(spark, df, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return sorted(map(tuple, queries.op13_merkle(spark, "").collect()), key=repr)


FIELDS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


@pytest.mark.parametrize("sizes", [[1], [7], [8], [9, 1, 8], [64, 65, 513, 2], [512, 511, 1, 1, 1, 1, 1, 1, 9], [1100, 4100]])
def test_manifest_equals_brute_force(spark, monkeypatch, sizes):
    rows = [(i * 7 + g, None if i % 5 == 0 else f"s{i % 3}", None if g == 1 else f"é{g}", None if i % 4 == 0 else i, None if i % 11 == 0 else f"Text {i} Ä" * (i % 3))
            for g, n in enumerate(sizes) for i in range(n)]
    random.seed(1)
    random.shuffle(rows)
    assert manifest_rows(spark, spark.createDataFrame(rows, FIELDS), monkeypatch) == slow_manifest(rows)


def test_manifest_over_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, "s", "en" if i % 9 else "de", i, f"T{i}") for i in range(5200)] + [(None, None, None, None, None)] * 3 + [(5, "s", "en", 5, "again")] * 2
    assert manifest_rows(spark, spark.createDataFrame(rows, FIELDS), monkeypatch) == slow_manifest(rows)


def test_manifest_over_many_groups(spark, monkeypatch):
    rows = [(i, None, f"l{i % 150}", None, "A" * (i % 4)) for i in range(400)]
    assert manifest_rows(spark, spark.createDataFrame(rows, FIELDS), monkeypatch) == slow_manifest(rows)


def test_manifest_of_the_table(spark, monkeypatch):
    documents = given(spark).select(*queries.LEAF)
    assert manifest_rows(spark, documents, monkeypatch) == slow_manifest([tuple(r) for r in documents.collect()])


def test_manifest_of_clashing_names_and_of_nothing(spark):
    df = spark.createDataFrame([(1, "a", "x", "y", 3), (2, "b", None, "y", 4)], "doc_id bigint, rank string, lang string, root string, n int")
    found = merkle.manifest(df, fields=["rank", "n"])
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof"]
    rows = found.withColumn("back", merkle.fold(merkle.F.col("leaf"), merkle.F.col("proof"))).collect()
    assert len(rows) == 2 and all(r["back"] == r["root"] for r in rows)
    assert merkle.manifest(df.where("false")).collect() == []


# --- prefix trie ---

def rebuilt(rows):
    """rows: (conv_id, turn, role, text); the rebuilt turns of each conversation."""
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), (role or "", text or "")))
    own = {c: [t for *_, t in sorted(v)] for c, v in said.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def slow_trie(rows):
    convs = rebuilt(rows)
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        own = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += node not in children
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]) if node in children else 0,
                    leaves[node], saved[node], sha(ends)))
    return sorted(out, key=repr)


def trie_rows(spark, df, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: df)
    return sorted(map(tuple, queries.op11_prefix_trie(spark, "").collect()), key=repr)


TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("run", [1, 2, 16])
def test_trie_equals_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(trie, "RUN", run)
    monkeypatch.setattr(trie, "PIECE", 2)
    monkeypatch.setattr(trie, "HOT_CHILDREN", 3)
    random.seed(run)
    rows = []
    for c in random.sample(range(-20, 60), 45):
        for t in range(random.choice([1, 2, 3, 5, 9, 16, 17, 32, 40])):
            rows.append((c, t, "user" if t % 2 else None, random.choice(["hi", "hi", "", None, "É é"]) if t < 30 else "tail"))
    rows += [(100, None, "a", "b"), (100, None, "a", "b"), (100, 3, "a", "b"), (None, 1, "a", "b"), (103, 1, "", "ab"), (104, 1, "a", "b")]
    assert trie_rows(spark, spark.createDataFrame(rows, TURNS), monkeypatch) == slow_trie(rows)


def test_trie_of_many_copies_and_one_long_conversation(spark, monkeypatch):
    rows = [(5 * c, t, "user", f"t{t}") for c in range(300) for t in range(3)] + [(10_001, t, "x", str(t)) for t in range(700)]
    assert trie_rows(spark, spark.createDataFrame(rows, TURNS), monkeypatch) == slow_trie(rows)


def test_trie_of_the_table(spark, monkeypatch):
    rows = [tuple(r) for r in given(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(spark, given(spark, "conversations"), monkeypatch) == slow_trie(rows)


def test_trie_of_clashing_names_and_of_nothing(spark, monkeypatch):
    rows = [(c, t, "u", "a" * t) for c in range(12) for t in range(c % 4 + 1)]
    extra = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS + ", conv string, pos int, n string")
    assert trie_rows(spark, extra, monkeypatch) == slow_trie(rows)
    assert trie_rows(spark, extra.where("false"), monkeypatch) == []
