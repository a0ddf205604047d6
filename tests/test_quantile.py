import hashlib

import numpy as np
from pyspark.sql import functions as F

from flowsentry.operators import metrics, quantile, stats
from flowsentry.operators.detect import fit_detector
from flowsentry.operators.iforest import fit_isolation_forest, grow_tree


def test_percentiles_equal_numpy_by_every_path(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 4001
    x = {"norm": rng.normal(size=n), "tail": rng.pareto(0.3, n) * rng.choice([-1, 1], n),
         "hot": np.where(rng.random(n) < 0.9, 0.0, rng.normal(size=n)),
         "near": 1.0 + rng.integers(0, 50, n) * 2.0 ** -52, "one": np.full(n, -7.5)}
    df = spark.createDataFrame([tuple(float(x[k][i]) for k in x) for i in range(n)], list(x)).repartition(5)
    fractions = [0.0, 0.013, 0.25, 0.5, 0.75, 0.999, 1.0]
    for listed in (20_000, 3, 1):
        monkeypatch.setattr(quantile, "LIST_ROWS", listed)
        got = quantile.percentiles(df, {k: F.col(k) for k in x}, fractions)
        for k in x:
            assert np.allclose(got[k], np.quantile(x[k], fractions), rtol=1e-9, atol=0), (listed, k)


def test_percentiles_of_odd_values(spark):
    df = spark.createDataFrame([(None, None), (-0.0, None), (0.0, None), (float("inf"), None), (float("-inf"), None), (float("nan"), None)],
                               "a double, b double")
    got = quantile.percentiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got["b"] is None and got["a"][:4] == [float("-inf"), 0.0, 0.0, float("inf")] and np.isnan(got["a"][4])
    assert stats.quartiles(df, ["a", "b"]) == {"a": (0.0, 0.0, 0.0), "b": (None, None, None)}


def test_threshold_keeps_its_definition_at_every_size(spark, monkeypatch):
    """The threshold interpolates also where the row count was once above a limit."""
    monkeypatch.setattr(metrics, "EXACT_PERCENTILE_MAX_ROWS", 10, raising=False)
    df = spark.range(1000).select("id", (F.sin("id") * F.col("id")).alias("a"), F.cos("id").alias("b"))
    det = fit_detector("isolation_forest", {"contamination": 0.0503, "n_estimators": 60}, df, ["a", "b"], ["id"], n_rows=1000)
    scores = [r.score for r in det.score(df, keep=["id"]).collect()]
    assert abs(det.offset - np.percentile(scores, 5.03)) < 1e-12


def test_trees_draw_from_all_rows(spark):
    """More rows than the former pool of 200,000: samples by brute-force hash ranks of all."""
    n, trees, psi, seed = 230_000, 3, 32, 42
    model = fit_isolation_forest(spark.range(n).select("id", F.col("id").cast("double").alias("x")), ["x"], ["id"],
                                 n_estimators=trees, max_samples=psi, seed=seed)
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}|iforest|{i}".encode()).hexdigest(), i))
    rng = np.random.default_rng(seed)
    picks = [rng.choice(n, size=psi, replace=False) for _ in range(trees)]
    seeds = [int(s) for s in rng.integers(0, 2 ** 31 - 1, size=trees)]
    for t in range(trees):
        X = np.array([[float(order[p])] for p in picks[t]])
        want = grow_tree(X, [0], 5, np.random.default_rng(seeds[t]), t)
        assert np.array_equal(model.thr[t, :len(want)], want.thr)
