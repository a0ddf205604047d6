"""Local searches hold a bounded number of distances."""

import numpy as np


def test_local_search_holds_few_distances_and_is_exact():
    import tracemalloc

    from flowsentry.operators.knn import local_topk, pair_distances
    rng = np.random.default_rng(2)
    R, Q = rng.integers(0, 6, (20000, 4)).astype(float), rng.integers(0, 6, (700, 4)).astype(float)   # many ties
    rk, qk = rng.permutation(20000), np.arange(700) + 20000
    for metric in ("euclidean", "manhattan"):
        tracemalloc.start()
        got = local_topk(qk, Q, rk, R, 9, metric, False)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64 << 20, (metric, peak)
        for j in (0, 350, 699):
            D = pair_distances(Q[j:j + 1], R, metric)[0]
            assert got[got.q == qk[j]].r.tolist() == rk[np.lexsort((rk, D))[:9]].tolist()


def test_manhattan_leaves_out_dimensions_and_queries_are_placed_once_a_round(spark, monkeypatch):
    from flowsentry.operators import knn as K
    rng = np.random.default_rng(9)
    scale = np.array([1.0, 100, 1, 50, 1, 1, 1, 30, 1, 1, 1, 1, 20, 1, 1, 10, 1, 1, 1, 1])
    Q, R = (rng.normal(size=(n, 20)) * scale for n in (300, 900))
    D = np.abs(Q[:, None] - R[None]).sum(axis=2)
    most = np.sort(D, axis=1)[:, 4]
    seen, real = [], K._add_dimensions
    monkeypatch.setattr(K, "_add_dimensions", lambda d, q, r, dims, m: (seen.append(d.size * len(dims)), real(d, q, r, dims, m))[1])
    got = K.local_topk(np.arange(300), Q, np.arange(900), R, 5, "manhattan", False, most=most * (1 + 1e-12))
    assert sum(seen) < 0.75 * D.size * 20
    assert (got["r"].to_numpy().reshape(300, 5) == np.argsort(D, axis=1, kind="stable")[:, :5]).all()
    monkeypatch.setattr(K, "_add_dimensions", real)
    placed, asked = [], K.PivotSearch._asked
    monkeypatch.setattr(K.PivotSearch, "_asked", lambda self, *a: (placed.append(1), asked(self, *a))[1])
    monkeypatch.setattr(K, "RING_ROWS", 16)
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(R)], "key long, vec array<double>")
    pts = K.points(rows, 6)
    near = K.PivotSearch(pts, pts, 900, 6, "manhattan", 100, 42).near.orderBy("q").collect()
    own = np.abs(R[:, None] - R[None]).sum(axis=2)
    assert len(placed) == 2 and [list(r.r) for r in near] == np.argsort(own, axis=1, kind="stable")[:, :6].tolist()
