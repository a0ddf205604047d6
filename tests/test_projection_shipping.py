"""Executors may lack the package: tasks of the approximate search import nothing of it."""

import numpy as np


def test_projections_reach_workers_without_the_package(spark, monkeypatch):
    from flowsentry.operators import knn, lsh
    from test_neighbours import clustered, frame
    sent = []
    plain = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda sc, value: (sent.append(value), plain(sc, value))[1])
    pts = knn.points(frame(spark, clustered(np.random.default_rng(4), 2000, 8, 40)), 4)
    search = lsh.ProjectionSearch(pts, pts, 2000, 4, "euclidean")
    assert search.setting is not None and search.entries.count() >= 4 * 2000
    assert not any(type(x).__module__.startswith("flowsentry") for x in sent)
