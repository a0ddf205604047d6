"""A search sends each vector a bounded number of times and expands copies of a point in bounded memory."""

import glob
import math
import tracemalloc

import numpy as np
import pytest

from flowsentry.operators import knn as K
from flowsentry.operators import lsh

from test_neighbours import brute, clustered, frame, lists


def test_rows_of_points_are_expanded_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(K, "CELLS", 1 << 16)
    k, n = 101, 300
    pid, ends = np.arange(k) * 1000, np.arange(k + 1) * k
    flat = (pid[:, None] + np.arange(k)).ravel()
    q, at = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    tied, apart = np.zeros(n * k), np.tile(np.arange(k, dtype=float), n)
    for dist in (tied, apart):
        tracemalloc.start()
        got = K._of_points(q, at, dist, pid, ends, flat, k)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 32 << 20, peak  # 3 million rows at once take more than 100 MB
        assert got[2].reshape(n, k).tolist() == [list(range(k))] * n  # the rows of the nearest point, or the smallest keys
        assert (got[1] == 0).all() and (got[3] == 0).all()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_a_query_is_sent_once_per_group(spark, monkeypatch, metric):
    monkeypatch.setattr(K, "RING_ROWS", 10)
    X = clustered(np.random.default_rng(12), 900, 4, 12, same=0.3)
    pts = K.points(frame(spark, X), 30)
    search = K.PivotSearch(pts, pts, len(X), 30, metric, 150, 42)
    assert 1 < len(search.parts) < len(search.rings) / 3
    assert search.copies < search.visits / 2 and search.copies <= pts.count() * len(search.parts)
    want, rows = brute(X, 30, metric, False), {tuple(x): i for i, x in reversed(list(enumerate(X)))}
    assert lists(search.entries) == {i: want[i] for i in rows.values()}


def test_repeated_keys_stay_neighbours_each(spark):
    v = spark.createDataFrame([(1, [0.0]), (1, [0.0]), (2, [1.0]), (3, [5.0])], "key long, vec array<double>")
    near = K.knn(v.filter("key = 3"), v, 4).orderBy("rank").collect()
    assert [(r["r"], r["dist"]) for r in near] == [(3, 0.0), (2, 4.0), (1, 5.0), (1, 5.0)]


def test_projections_do_not_buy_distances_with_copies(spark, monkeypatch):
    monkeypatch.setattr(lsh, "COPIES", 4)
    X = np.random.default_rng(8).normal(size=(3000, 6))
    pts = K.points(frame(spark, X), 5).cache()
    search = lsh.ProjectionSearch(pts, pts, len(X), 5, "euclidean")
    tables, bits, probes = search.setting
    assert search._copies(len(X), tables, bits, probes) <= max(4, 2 * math.ceil(len(X) / search.wide))
    got, want = lists(search.entries), brute(X, 5, "euclidean", False)
    assert sum(len({r for _, r in got[i]} & {r for _, r in want[i]}) for i in want) / (5 * len(X)) >= 0.9


def test_balanced_rows_are_cleaned_once(spark):
    from flowsentry.plans.jobs import balance_report
    from flowsentry.session import scratch_path, shared_dir
    from flowsentry.sources.arff import read_arff
    df = spark.createDataFrame([(i, float(i % 17), float(i % 5), int(i % 4 == 0)) for i in range(80)] + [(80, None, 1.0, 0)],
                               "id long, a double, b double, Label int")
    pattern = shared_dir(spark).replace("file:", "") + "/flowsentry-cleaned-*"
    before, path = set(glob.glob(pattern)), scratch_path(spark, "arff")
    balance_report(df, smote_key="id", arff_path=path)
    new = set(glob.glob(pattern)) - before
    assert len(new) == 1 and spark.read.parquet(new.pop()).count() == 80
    assert {r["Label"]: r["count"] for r in read_arff(spark, path).groupBy("Label").count().collect()} == {0: 60, 1: 60}
