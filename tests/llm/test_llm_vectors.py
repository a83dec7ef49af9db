"""Operators on vectors against brute force, odd rows included."""

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from gavelstream.llm import ann, embedding_dedup, queries
from gavelstream.llm.common import Staged
from gavelstream.llm.components import components

SCHEMA = "vec_id bigint, embedding array<float>, label int, q int, id string, component_id int"


@pytest.fixture
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x", 3)
                                      for i, v in rows], SCHEMA)

    return make


def odd(dim):
    return [(9001, None), (9002, []), (9003, [0.0] * dim), (9004, [1.0, None] + [0.5] * (dim - 2)),
            (9005, [float("nan")] * dim), (9006, [float("inf")] + [1.0] * (dim - 1)), (9007, [1.0, 2.0]), (None, [1.0] * dim)]


def clustered(seed, n=700, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 2 * rng.normal(size=(6, dim))[rng.integers(0, 6, n)]
    x[200:320] = x[200] + 0.05 * rng.normal(size=(120, dim))  # a group of near copies
    x[400:460] = x[400]  # equal vectors
    return x.astype(np.float32).astype(np.float64)


def test_nearest_recall_and_order(vectors):
    x = clustered(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd(24)
    found = ann.nearest(vectors(rows), F.col("id") % 20 == 0).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, len(x), 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in mine) and [m[2] for m in mine] == sorted(m[2] for m in mine)
        hit += (np.array([m[2] for m in mine]) <= np.sort(d)[9] + 1e-9).sum()
    assert set(got) == set(range(0, len(x), 20)) and hit >= 0.95 * 10 * len(got)
    assert [v for _, v, _ in sorted(got[440])] == list(range(400, 410))


def test_nearest_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in queries.op2_nn_descent(spark, SF_DIR).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = []
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        share.append(len(got[ids[q]] & set(ids[np.lexsort((ids, d))[:10]])) / 10)
    assert np.mean(share) >= 0.9


def test_nearest_few_rows(vectors):
    some = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])]
    found = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.nearest(vectors(some), F.col("id") == 0).collect())
    assert found == [(0, 1, 1, 0.0), (0, 2, 2, 2.236068)]
    assert ann.nearest(vectors([(0, [1.0])]), F.col("id") == 0).count() == 0
    assert ann.nearest(vectors([]), F.col("id") == 0).count() == 0


def slow_dedup(x, threshold):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= threshold
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            return near.sum(axis=1) - 1, label
        label = new


@pytest.mark.parametrize("tile", [1024, 40])
def test_embedding_dedup(vectors, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    x = clustered(2)
    n, label = slow_dedup(x, 0.95)
    rows = embedding_dedup.near_duplicates(vectors([(i, v.tolist()) for i, v in enumerate(x)] + odd(24))).collect()
    found = {r.vec_id: r for r in rows}
    assert len(rows) == len(x) + 8 and n.max() >= 100
    assert [found[i].n_links for i in range(len(x))] == n.tolist()
    assert [found[i].component_id for i in range(len(x))] == label.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for i, r in found.items() if i is not None)
    assert all(found[i].n_links == 0 and found[i].component_id == i for i in range(9001, 9008))


def test_embedding_dedup_few_rows(vectors):
    assert embedding_dedup.near_duplicates(vectors([])).count() == 0
    assert [tuple(r) for r in embedding_dedup.near_duplicates(vectors([(5, [1.0, 1.0])])).collect()] == [(5, 0, 5, True)]
    assert {tuple(r) for r in embedding_dedup.near_duplicates(vectors([(5, [1.0, 1.0]), (6, [2.0, 2.0])])).collect()} == {
        (5, 1, 5, True), (6, 1, 5, False)}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 200), (7, 201), (201, 9), (5, 5)] + [(300, i) for i in range(301, 400)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), Staged(spark, "t")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {7: 7, 200: 7, 201: 7, 9: 7} | {i: 300 for i in range(300, 400)}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Staged(spark, "t")).count() == 0


def test_embedding_dedup_links_dense_groups(vectors):
    # Two groups of 200, cosine above 0.998 inside and about 0.96 between: no list reaches the other group.
    rng = np.random.default_rng(7)
    one, other = np.linalg.qr(rng.normal(size=(48, 2)))[0].T
    x = np.repeat([one, 0.962 * one + np.sqrt(1 - 0.962 ** 2) * other], 200, axis=0) + 0.0045 * rng.normal(size=(400, 48))
    x = x.astype(np.float32).astype(np.float64)
    n, label = slow_dedup(x, 0.95)
    assert n.min() > 300 and set(label) == {0}
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors([(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert [found[i].n_links for i in range(400)] == n.tolist()
    assert [found[i].component_id for i in range(400)] == label.tolist() and sum(r.kept for r in found.values()) == 1


def test_embedding_dedup_without_a_graph(vectors, monkeypatch):
    # Where the graph finds nothing, the cells alone have to.
    monkeypatch.setattr(embedding_dedup, "_near_places", lambda lists, threshold: embedding_dedup.edges(lists).where("false"))
    x = clustered(3)
    n, label = slow_dedup(x, 0.95)
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors([(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    assert [found[i].n_links for i in range(len(x))] == n.tolist() and [found[i].component_id for i in range(len(x))] == label.tolist()


@pytest.mark.parametrize("off", ["places", "lists", None])
def test_embedding_dedup_of_rare_links(vectors, monkeypatch, off):
    # One vector in 200 has a link. Where the graph, or what is read from it, is switched off, the audit has to see it.
    rng = np.random.default_rng(11)
    x = rng.normal(size=(4000, 32))
    x[2000:2010] = x[:10] + 0.1 * rng.normal(size=(10, 32))
    x = x.astype(np.float32).astype(np.float64)
    n, label = slow_dedup(x, 0.95)
    assert 18 <= (n > 0).sum() <= 22
    if off == "places":
        monkeypatch.setattr(embedding_dedup, "_near_places", lambda lists, threshold: embedding_dedup.edges(lists).where("false"))
    elif off == "lists":
        none = [F.lit([]).cast(t).alias(c) for c, t in (("nbrs", "array<bigint>"), ("dists", "array<float>"), ("fresh", "array<boolean>"))]
        monkeypatch.setattr(embedding_dedup, "build", lambda codes, *_, **__: codes.select("id", *none))
    audits = []
    found = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors([(i, v.tolist()) for i, v in enumerate(x)]), audits=audits).collect()}
    assert [found[i].n_links for i in range(len(x))] == n.tolist() and [found[i].component_id for i in range(len(x))] == label.tolist()
    print(audits)
    assert audits[-1].passed == (off is None) and (off == "lists" or audits[0].linked >= 18)


def test_embedding_dedup_cosine_is_one_function():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(20):
        at = float(embedding_dedup._cosines(x[i:i + 1], x[i + 20:i + 21])[0])
        assert embedding_dedup._reaches(x, x, at)[i, i + 20] and not embedding_dedup._reaches(x, x, np.nextafter(at, 2))[i, i + 20]


@pytest.mark.parametrize("noise", [2.5e-2, 1e-2, 4e-3])
def test_nearest_recall_among_very_near_copies(vectors, noise):
    # 3000 copies at cosine about 0.9994, 0.9999 and 0.99998, a third of the rows with 6000 others.
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 64))
    x[:3000] = x[0] + noise * rng.normal(size=(3000, 64))
    x = x.astype(np.float32).astype(np.float64)
    got = {}
    for r in ann.nearest(vectors([(i, v.tolist()) for i, v in enumerate(x)]), (F.col("id") % 50 == 0) & (F.col("id") < 3000)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = []
    for q in range(0, 3000, 50):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        share.append(len(got[q] & set(np.argsort(d)[:10].tolist())) / 10)
    print("recall", noise, np.mean(share))
    assert np.mean(share) >= 0.9
