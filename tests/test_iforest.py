import numpy as np

from flowsentry.operators.iforest import avg_path_length, fit_isolation_forest, grow_tree


def test_avg_path_length_values():
    assert avg_path_length([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    n = 256.0
    assert abs(avg_path_length([n])[0] - (2 * (np.log(n - 1) + 0.5772156649015329)
                                          - 2 * (n - 1) / n)) < 1e-12


def test_tree_structure_and_depth():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(256, 4))
    t = grow_tree(X, [0, 1, 2, 3], 8, rng)
    leaves = t[t.feat < 0]
    inner = t[t.feat >= 0]
    assert len(t) == 2 * len(inner) + 1          # a proper binary tree
    assert len(t) <= 2 * 256 - 1
    assert (leaves.path >= 0).all()


def _walk(model, x):
    total = 0.0
    for t in range(model.n_trees):
        i = 0
        while model.feat[t, i] >= 0:
            i = model.left[t, i] if x[model.feat[t, i]] < model.thr[t, i] else model.right[t, i]
        total += model.path[t, i]
    return -2.0 ** (-total / (model.n_trees * avg_path_length([model.psi])[0]))


def test_scores_bounded_planted_outliers_first_and_equal_walk(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(2000, 3))
    X[:10] += 12.0                                   # planted outliers
    rows = [(int(i), *map(float, X[i])) for i in range(len(X))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double")
    m = fit_isolation_forest(df, ["a", "b", "c"], ["k"], n_estimators=50, seed=3)
    assert m.n_trees == 50 and m.psi == 256
    s = m.score(df, keep=["k"]).toPandas().sort_values("k").reset_index(drop=True)
    assert ((s.score > -1) & (s.score < 0)).all()
    worst = set(s.sort_values("score").k.head(10))
    assert worst == set(range(10))
    for i in (0, 5, 500, 1999):
        assert abs(s.score[i] - _walk(m, X[i])) < 1e-12
    # deterministic for a fixed seed
    m2 = fit_isolation_forest(df, ["a", "b", "c"], ["k"], n_estimators=50, seed=3)
    assert np.array_equal(m.thr, m2.thr)


def test_rows_at_ranks_equal_a_full_order_and_shuffle_little(spark, monkeypatch):
    import hashlib
    from pyspark.sql import functions as F
    from flowsentry.operators import rank
    n = 30_000
    df = spark.range(n).select(F.col("id"), (F.col("id") * 2).alias("x"))
    order = sorted(range(n), key=lambda i: hashlib.md5(f"7|p|{i}".encode()).hexdigest())
    for limit, ranks in ((1 << 20, np.array([0, 1, 77, 12_345, n - 1])), (64, np.arange(0, n, 997))):
        monkeypatch.setattr(rank, "PREFIX_ROWS", limit)  # a small limit descends digit by digit
        got = {r._rank: (r.id, r.x) for r in rank.rows_at(df, ["id"], ranks, 1 if limit == 64 else n, 7, "p").collect()}
        assert got == {int(r): (order[r], 2 * order[r]) for r in ranks}
    digits, prefix, _ = rank._open_prefixes(
        df.select(F.conv(F.substring(rank.hash_key(["id"], 7, "p"), 1, 15), 16, 10).cast("long").alias("_code")), ranks, n)
    held = df.select(rank._prefix(F.conv(F.substring(rank.hash_key(["id"], 7, "p"), 1, 15), 16, 10).cast("long"), digits).alias("p"))
    assert held.filter(F.col("p").isin(prefix.tolist())).count() <= 2 * len(ranks)


def test_forests_of_a_grid_equal_forests_fitted_alone(spark):
    from flowsentry.operators.iforest import fit_forests
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in range(900)], "k long, a double, b double, c double").repartition(4)
    specs = [{"n_estimators": 6, "max_samples": 32}, {"n_estimators": 9, "max_samples": 64, "max_features": 0.67},
             {"n_estimators": 4, "max_samples": 0.1, "bootstrap": True}]
    for spec, got in zip(specs, fit_forests(df, ["a", "b", "c"], ["k"], specs, seed=3)):
        alone = fit_isolation_forest(df, ["a", "b", "c"], ["k"], seed=3, **spec)
        assert got.n_trees == spec["n_estimators"] and got.psi == alone.psi
        assert all(np.array_equal(getattr(got, x), getattr(alone, x)) for x in ("feat", "thr", "left", "right", "path"))


def test_a_share_of_many_rows_is_drawn_by_hash(spark, monkeypatch):
    import pytest
    from flowsentry.operators import iforest
    monkeypatch.setattr(iforest, "MAX_DRAWS", 100)
    df = spark.range(4000).selectExpr("id", "double(id) as x", "double(hash(id) % 97) as y")
    m = fit_isolation_forest(df, ["x", "y"], ["id"], n_estimators=8, max_samples=0.05, seed=1)
    assert m.psi == 200 and m.n_trees == 8 and (m.feat[:, 0] >= 0).all()
    assert len({m.thr[t, 0] for t in range(8)}) == 8
    monkeypatch.setattr(iforest, "MAX_TREE_ROWS", 100)
    with pytest.raises(ValueError):
        fit_isolation_forest(df, ["x", "y"], ["id"], max_samples=0.05)


def test_unlucky_samples_end_in_a_distributed_sort(spark, monkeypatch):
    from pyspark.sql import functions as F
    from flowsentry.operators import rank
    monkeypatch.setattr(rank, "SLICE_ROWS", 5)
    monkeypatch.setattr(rank, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(rank, "MAX_DEPTH", 0)
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), (F.col("id") % 7).alias("day"))
    rows = sorted((r.day, r.k) for r in df.collect())
    assert rank.order_cuts(df, ["day", "k"], [3, 1500, 2999], 3000) == [rows[2], rows[1499], rows[2998]]
