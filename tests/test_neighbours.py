"""Neighbour search by pivots and by projections, equal rows as one point."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.operators import knn as K
from flowsentry.operators import lof, lsh


def frame(spark, X, parts=5):
    return spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(X)], "key long, vec array<double>").repartition(parts)


def clustered(rng, n, d, centres, same=0.0):
    C = rng.normal(size=(centres, d)) * 6
    X = np.round(C[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * 0.5, 2)
    X[:int(n * same)] = X[0]
    rng.shuffle(X)
    return X


def brute(X, k, metric, exclude):
    D = K.pair_distances(X, X, metric)
    if exclude:
        np.fill_diagonal(D, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(X)), D.shape), D), axis=1)[:, :k]
    return {i: [(D[i, j], j) for j in order[i]] for i in range(len(X))}


def lists(df):
    return {q: list(zip(g.sort_values("rank").dist, g.sort_values("rank").r)) for q, g in df.toPandas().groupby("q")}


@pytest.mark.parametrize("metric,exclude", [("euclidean", True), ("manhattan", False)])
def test_pivots_equal_brute_force_with_half_the_rows_equal(spark, monkeypatch, metric, exclude):
    monkeypatch.setattr(K, "PLAIN_ROWS", 50)
    monkeypatch.setattr(K, "RING_ROWS", 20)
    X = clustered(np.random.default_rng(1), 500, 3, 9, same=0.5)
    df = frame(spark, X)
    assert lists(K.knn(df, df, 4, metric, exclude_self=exclude, block_rows=60)) == brute(X, 4, metric, exclude)


def test_rings_are_skipped_and_counted(spark, monkeypatch):
    monkeypatch.setattr(K, "RING_ROWS", 10)
    X = clustered(np.random.default_rng(2), 900, 4, 12)
    pts = K.points(frame(spark, X), 5)
    search = K.PivotSearch(pts, pts, len(X), 5, "euclidean", 100, 42)
    assert search.pruned and search.visits < 0.5 * search.pairs
    got = lists(search.entries)
    assert got == brute(X, 5, "euclidean", False)  # all vectors differ, so points are rows
    flat = K.points(frame(spark, np.random.default_rng(3).normal(size=(300, 40))), 5)
    assert not K.PivotSearch(flat, flat, 300, 5, "euclidean", 100, 42).pruned  # no structure: every block is met


def test_rows_that_cannot_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [nan, 0.0]), (6, [inf, 0.0]), (None, [0.0, 0.0]), (7, [-0.0, 0.0])]
    v = K.as_vector(spark.createDataFrame(rows, "key long, v array<double>"), "key", "v")
    got = lists(K.knn(v, v, 5, exclude_self=True))
    assert got == {1: [(0.0, 7), (1.0, 2)], 2: [(1.0, 1), (1.0, 7)], 7: [(0.0, 1), (1.0, 2)]}
    assert K.knn(v.limit(0), v.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        K.as_vector(spark.createDataFrame([("a", [1.0])], "key string, v array<double>"), "key", "v")


def test_approximate_recall_and_buckets(spark):
    X = clustered(np.random.default_rng(4), 6000, 12, 80)
    df = frame(spark, X).cache()
    got, want = lists(K.knn(df, df, 5, exclude_self=True, mode="approx")), brute(X, 5, "euclidean", True)
    hits = sum(len(set(r for _, r in got.get(i, [])) & set(r for _, r in want[i])) for i in want)
    assert hits / (5 * len(X)) >= 0.9
    assert all(d == pytest.approx(np.sqrt(((X[i] - X[r]) ** 2).sum())) for i in (0, 77) for d, r in got[i])
    pts = K.points(df, 6)
    search = lsh.ProjectionSearch(pts, pts, len(X), 6, "euclidean")
    assert search.setting is not None and search.share < 0.5


def test_large_buckets_are_sliced(spark, monkeypatch):
    """One dense cluster holds half of all points: its buckets are cut, and recall holds."""
    monkeypatch.setattr(lsh, "TABLES", (1, 2))
    rng = np.random.default_rng(5)
    X = np.concatenate([rng.normal(size=(2000, 6)) * 0.05, rng.normal(size=(2000, 6)) * 20])
    df = frame(spark, X)
    pts = K.points(df, 4).cache()
    search = lsh.ProjectionSearch(pts, pts, len(X), 4, "euclidean", block_rows=300)
    assert search.setting is not None and any(c for _, _, c in search.sliced)
    got, want = lists(search.entries), brute(X, 4, "euclidean", False)
    assert sum(len({r for _, r in got[i]} & {r for _, r in want[i]}) for i in want) / (4 * len(X)) >= 0.9


def test_approx_on_embeddings(spark):
    from flowsentry.plans.catalog import QUERIES
    sf = "/root/testdata/sf0.1"
    got = QUERIES["m4_knn_approx"](spark, sf).toPandas()
    want = QUERIES["m4_knn_exact"](spark, sf).toPandas()
    assert len(got.merge(want, on=["q", "r"])) / len(want) >= 0.9


def test_lof_with_half_the_rows_equal(spark):
    X = clustered(np.random.default_rng(6), 240, 3, 5, same=0.5)
    df = frame(spark, X).select("key", F.col("vec").alias("v"))
    model = lof.fit_lof(df, "v", ["key"], n_neighbors=8)
    near = brute(X, 8, "euclidean", True)
    kdist = {i: near[i][-1][0] for i in near}
    lrd = {i: 1 / (np.mean([max(d, kdist[r]) for d, r in near[i]]) + lof.EPS) for i in near}
    want = {i: -np.mean([lrd[r] for _, r in near[i]]) / lrd[i] for i in near}
    got = {r["key"]: r["score"] for r in model.train_scores().collect()}
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)
    new = model.score(df.filter("key < 20")).collect()
    assert len(new) == 20 and all(r["score"] is not None for r in new)
