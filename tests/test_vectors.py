"""Nearest vectors by blocks against all pairs, and how many blocks are left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookspark.operators import vectors


def clustered(n, clusters, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=5, size=(clusters, dims))
    return (centres[rng.integers(0, clusters, n)] + rng.normal(scale=0.2, size=(n, dims))).astype(np.float32)


def brute(w, ids, queries, k, unit):
    out = {}
    for q in queries:
        with np.errstate(invalid="ignore", divide="ignore"):
            x = -(w @ w[q]) / np.sqrt((w**2).sum(1) * (w[q] @ w[q])) if unit else ((w - w[q]) ** 2).sum(1)
        x = np.round(x, 9)
        order = [i for i in np.lexsort((ids, x)) if not np.isnan(x[i])][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_nearest_against_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vectors, "BLOCK", 60)
        monkeypatch.setattr(vectors, "CELL", 100)
        monkeypatch.setattr(vectors, "GROUP", 60)
        monkeypatch.setattr(vectors, "PIVOTS", 6)
    rng = np.random.default_rng(2)
    v = np.round(np.concatenate([rng.normal(size=(150, 6)), clustered(150, 4, 6, 3)]), 1).astype(np.float32)
    v[7], v[8] = v[9], 0
    v[20:40] = v[9]  # a very common vector
    rows = [(k, [float(x) for x in row]) for k, row in enumerate(v)]
    df = spark.createDataFrame([*rows, (300, None), (301, [None] * 6), (302, [1.0, 2.0]), (320, [1.0, 2.5]), (340, [])], "vec_id long, embedding array<float>").repartition(3)
    q = df.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query_vector")
    w, ids = v.astype(float), np.arange(300)
    for unit, found in ((False, vectors.knn_l2(q, df, 5)), (True, vectors.cosine_scores(q, df, 5))):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        other = {i: got.pop(i, None) for i in (320, 340)}
        assert got == {i: own for i, own in brute(w, ids, range(0, 300, 20), 5, unit).items() if own}
        assert sorted(other[320]) == [302, 320] and other[340] == (None if unit else [340])


def test_most_blocks_of_clustered_vectors_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 400)
    v = clustered(3000, 12, 8, 5)
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "vec_id long, embedding array<float>")
    data = [(np.frombuffer(r["centre"]), r["radius"], r["n"]) for r in vectors.blocks(df).collect()]
    assert sum(n for _, _, n in data) == 3000 and len(data) >= 60
    pairs = compared = 0
    for x in v[::20].astype(float):
        d = np.array([np.linalg.norm(x - c) for c, _, _ in data])
        radius, n = np.array([r for _, r, _ in data]), np.array([n for _, _, n in data])
        limit = vectors.reach(d + radius, n, 5)
        open_ = [bool(vectors.still_open(d[k : k + 1], radius[k], np.array([limit]))[0]) for k in range(len(data))]
        pairs, compared = pairs + len(data), compared + sum(open_)
        near = np.argsort(((v - x) ** 2).sum(1))[:5]
        assert np.sqrt(((v[near] - x) ** 2).sum(1)).max() <= limit + 1e-6
    assert compared <= pairs / 3, (compared, pairs)


def test_ids_may_be_texts(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.1])], "vec_id string, embedding array<double>")
    q = df.where("vec_id = 'a'").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert [tuple(r)[:3] for r in vectors.cosine_scores(q, df, 2).orderBy("rank").collect()] == [("a", 1, "a"), ("a", 2, "c")]
    assert vectors.knn_l2(q.limit(0), df, 2).count() == 0 and vectors.knn_l2(q, df.limit(0), 2).count() == 0
