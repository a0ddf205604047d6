"""Leakage, determinism, PCA, SMOTE, SVM and plan-shape properties."""

import numpy as np
from pyspark.sql import functions as F

from paths import SF_SMALL
from flowsentry.operators import splits
from flowsentry.operators.pca import explained_variance_curve, fit_pca, project
from flowsentry.operators.prep import PrepModel
from flowsentry.sources import fixtures


def test_fitted_values_ignore_val_and_test_rows(spark):
    f = fixtures.flows(spark, SF_SMALL)
    s = splits.novelty_split(f, ["flow_id"])
    m1 = PrepModel.fit(s.filter(F.col("split") == "train"), fixtures.FLOW_FEATURES, ["flow_id"])
    # change every val/test value: the training fit must not move
    s2 = s.select(*[(F.col(f"`{n}`") * 1000 + 7).alias(n)
                    if n in fixtures.FLOW_FEATURES else F.col(f"`{n}`")
                    for n in s.columns]).filter(F.col("split") != "train") \
        .unionByName(s.filter(F.col("split") == "train"))
    m2 = PrepModel.fit(s2.filter(F.col("split") == "train"), fixtures.FLOW_FEATURES, ["flow_id"])
    assert m1.means == m2.means and m1.output_columns == m2.output_columns


def test_split_independent_of_partitioning(spark):
    f = fixtures.flows(spark, SF_SMALL)
    a = splits.stratified_split(f.repartition(1), ["flow_id"]).select("flow_id", "split")
    b = splits.stratified_split(f.repartition(200), ["flow_id"]).select("flow_id", "split")
    assert sorted(a.collect()) == sorted(b.collect())
    p1 = splits.positional_split(f.repartition(1), fixtures.ORDER_COLS).select("flow_id", "split")
    p2 = splits.positional_split(f.repartition(50), fixtures.ORDER_COLS).select("flow_id", "split")
    assert sorted(p1.collect()) == sorted(p2.collect())


def test_pca_projection_properties(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(500, 4)) @ np.array([[3, 0, 0, 0], [1, 1, 0, 0], [0, 0, .5, 0],
                                              [0, 0, 0, .1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double, "
                                                                  "c double, d double")
    comps, mean, ratio = fit_pca(df, ["a", "b", "c", "d"], 3)
    P = df.select(*project(["a", "b", "c", "d"], comps, mean)).toPandas().to_numpy()
    assert np.allclose(P.mean(axis=0), 0, atol=1e-9)
    C = np.cov(P.T)
    assert np.allclose(C - np.diag(np.diag(C)), 0, atol=1e-8)
    ev = np.sort(np.linalg.eigvalsh(np.cov(X.T)))[::-1]
    assert np.allclose(np.diag(C), ev[:3], rtol=1e-8)
    assert np.allclose(ratio, ev[:3] / ev.sum())
    curve = explained_variance_curve(df, ["a", "b", "c", "d"]).toPandas()
    assert abs(curve.pct.sum() - 100) < 1e-9
    assert (np.diff(curve.pct) <= 1e-12).all()


def test_smote_balances_and_stays_on_segments(spark):
    from flowsentry.operators.knn import pair_distances
    from flowsentry.operators.smote import smote
    rng = np.random.default_rng(2)
    X = rng.normal(size=(60, 3))
    lab = [1 if i < 12 else 0 for i in range(60)]
    df = spark.createDataFrame([(i, X[i].tolist(), lab[i]) for i in range(60)],
                               "k long, v array<double>, Label int")
    syn = smote(df, "k", "v", k_neighbors=5).toPandas()
    assert len(syn) == 48 - 12
    M = X[:12]
    D = pair_distances(M, M, "euclidean")
    np.fill_diagonal(D, np.inf)
    for _, r in syn.iterrows():
        x = X[int(r.origin)]
        nbs = np.argsort(D[int(r.origin)], kind="stable")[:5]
        nb = M[nbs[int(r.nb_rank) - 1]]
        assert 0 <= r.u < 1
        assert np.allclose(np.array(r.vec), x + r.u * (nb - x))


def test_ocsvm_rejects_about_nu_of_train(spark):
    from flowsentry.operators.ocsvm import fit_ocsvm
    rng = np.random.default_rng(4)
    X = rng.normal(size=(1500, 3))
    df = spark.createDataFrame([(i, *map(float, X[i])) for i in range(1500)],
                               "k long, a double, b double, c double")
    m = fit_ocsvm(df, ["a", "b", "c"], ["k"], nu=0.1, n_iter=15, n_components=64)
    s = m.score(df, keep=["k"]).toPandas()
    assert abs((s.score < 0).mean() - 0.1) < 0.03
    far = spark.createDataFrame([(99999, 9.0, 9.0, 9.0)], "k long, a double, b double, c double")
    assert m.score(far).collect()[0].score < 0


def _unpartitioned_windows(plan: str) -> list[str]:
    """Physical ``Window`` nodes print ``[exprs], [partition], [order]``; a window
    over the whole input prints only two lists."""
    out = []
    for line in plan.splitlines():
        s = line.strip().lstrip("+-: ").lstrip("*(0123456789) ")
        if s.startswith("Window [") and s.count("], [") < 2:
            out.append(s)
    return out


def test_no_global_windows_or_cross_joins_in_core_plans(spark):
    from flowsentry.plans.catalog import QUERIES
    for name in ["x1_novelty_split", "x2_stratified_split", "x5_sample_n", "p12_viz_prepare",
                 "a1_class_distribution", "a14_report", "h2_contamination_sweep",
                 "m4_knn_exact", "m9_smote"]:
        qe = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution()
        plan = qe.executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert not _unpartitioned_windows(plan), (name, _unpartitioned_windows(plan))


def test_scan_prunes_columns(spark):
    from flowsentry.plans.catalog import QUERIES
    plan = QUERIES["p8_class_filter"](spark, SF_SMALL)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint" in plan
    assert "l_extendedprice" not in plan and "l_comment" not in plan


def test_contamination_touches_train_only(spark):
    from flowsentry.config import ExperimentConfig
    from flowsentry.plans import jobs
    f = fixtures.flows(spark, SF_SMALL)
    cfg = ExperimentConfig(novelty=False, algorithm="isolation_forest", contamination=0.02)
    with_c = jobs.split_table(f, cfg)
    plain = splits.stratified_split(f, ["flow_id"])
    for part in ("val", "test"):
        a = sorted(r.flow_id for r in with_c.filter(F.col("split") == part).collect())
        b = sorted(r.flow_id for r in plain.filter(F.col("split") == part).collect())
        assert a == b
    tr = with_c.filter(F.col("split") == "train")
    n0 = tr.filter(F.col("Label") == 0).count()
    n1 = tr.filter(F.col("Label") == 1).count()
    assert n1 == min(int(0.02 * n0 / 0.98), plain.filter((F.col("split") == "train") &
                                                         (F.col("Label") == 1)).count())


def test_standalone_filters_agree_with_fit_filters(spark):
    from flowsentry.operators.filters import duplicate_columns, fit_filters, low_variance
    rows = [(i, float(i % 7), 3.0, float(i % 7), float((i * i) % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, c double, a2 double, z double")
    cols = ["a", "c", "a2", "z"]
    fm = fit_filters(df, cols, ["k"])
    assert low_variance(df, cols) == fm.dropped_low_variance == ["c"]
    assert duplicate_columns(df, ["a", "a2", "z"], ["k"]) == {"a2": "a"} == fm.duplicate_of
