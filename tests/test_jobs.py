"""Job-level checks: streaming equals batch, searches pick the first maximum."""

import json

from pyspark.sql import functions as F

from paths import SF_SMALL
from flowsentry.config import ExperimentConfig
from flowsentry.plans import jobs
from flowsentry.plans.search import classifier_search, iforest_search, parameter_grid
from flowsentry.session import scratch_path
from flowsentry.sources import fixtures
from flowsentry.streaming.score import file_stream, run_available_now, score_stream

FEATS = ("Eng_Flow_Rates",)


def test_stream_scoring_equals_batch(spark):
    flows = fixtures.flows(spark, SF_SMALL)
    cfg = ExperimentConfig(domain_features=FEATS)
    res = jobs.run_detection(flows.filter(F.col("domain") == "train"), cfg)
    target = flows.filter(F.col("domain") == "gen")
    src = scratch_path(spark, "t-stream-in")
    target.repartition(3).write.parquet(src)
    scored = score_stream(file_stream(spark, src, target.schema), res.prepared.prep,
                          res.prepared.scaler, res.detector, FEATS, keep=["flow_id", "Label"])
    out = scratch_path(spark, "t-stream-out")
    run_available_now(scored, out, scratch_path(spark, "t-stream-ckpt"))
    streamed = {r.flow_id: (r.score, r.y_pred) for r in spark.read.parquet(out).collect()}
    batch = {r.flow_id: (r.score, r.y_pred) for r in
             score_stream(target, res.prepared.prep, res.prepared.scaler, res.detector, FEATS,
                          keep=["flow_id", "Label"]).collect()}
    assert streamed == batch and len(batch) == target.count()


def test_iforest_search_small_grid(spark):
    cfg = ExperimentConfig(domain_features=FEATS)
    prepared = jobs.prepare(fixtures.flows(spark, SF_SMALL), cfg)
    grid = {"contamination": [0.05, 0.2], "max_features": [1.0], "max_samples": [64],
            "n_estimators": [10, 20], "bootstrap": [False]}
    out = iforest_search(prepared, cfg, grid)
    rows = out["table"].orderBy("grid_idx").collect()
    assert len(rows) == 4
    best = max(rows, key=lambda r: (r.macro_f1, -r.grid_idx))
    assert out["grid_idx"] == best.grid_idx
    assert out["params"] == json.loads(best.params)


def test_classifier_search_small_grid(spark):
    cfg = ExperimentConfig(novelty=False, domain_features=FEATS)
    prepared = jobs.classifier_prepare(fixtures.flows(spark, SF_SMALL), cfg)
    grid = {"n_estimators": [3, 6], "max_depth": [2], "learning_rate": [0.3],
            "subsample": [1.0], "colsample_bytree": [1.0]}
    out = classifier_search(prepared, cfg, grid)
    rows = out["table"].collect()
    assert len(rows) == 2
    assert out["macro_f1"] == max(r.macro_f1 for r in rows)


def test_lof_search_prefix_k_matches_direct_fit(spark):
    """A smaller k read as a prefix of the k_max neighbour table must give the
    same validation F1 as fitting LOF with that k directly."""
    from flowsentry.operators import metrics
    from flowsentry.operators.detect import fit_detector
    from flowsentry.plans.search import lof_search
    cfg = ExperimentConfig(algorithm="lof", domain_features=FEATS)
    prepared = jobs.prepare(fixtures.flows(spark, SF_SMALL), cfg)
    grid = {"n_neighbors": [5, 12], "metric": ["euclidean"], "contamination": [0.1]}
    out = lof_search(prepared, cfg, grid)
    got = {json.loads(r.params)["n_neighbors"]: r.macro_f1 for r in out["table"].collect()}
    for k in (5, 12):
        det = fit_detector("lof", {"n_neighbors": k, "metric": "euclidean",
                                   "contamination": 0.1},
                           prepared.table.filter(F.col("split") == "train"), prepared.features,
                           ["flow_id"], n_rows=prepared.counts["train"])
        _, conf, _ = jobs.evaluate(det, prepared, cfg, ("val",))
        want = metrics.macro_f1(conf).collect()[0]["macro_f1"]
        assert abs(got[k] - want) < 1e-12


def test_svm_grid_equals_separate_fits(spark):
    """Shared Fourier draws: each grid member equals its own single fit."""
    import numpy as np
    from flowsentry.operators.ocsvm import fit_ocsvm, fit_ocsvm_grid
    rng = np.random.default_rng(9)
    X = rng.normal(size=(400, 3))
    df = spark.createDataFrame([(i, *map(float, X[i])) for i in range(400)],
                               "k long, a double, b double, c double")
    configs = [{"nu": 0.1, "gamma": "scale"}, {"nu": 0.2, "gamma": 0.5}]
    grid = fit_ocsvm_grid(df, ["a", "b", "c"], configs, n_components=32, n_iter=5)
    for p, g in zip(configs, grid):
        one = fit_ocsvm(df, ["a", "b", "c"], ["k"], nu=p["nu"], gamma=p["gamma"],
                        n_components=32, n_iter=5)
        assert np.allclose(one.W, g.W) and np.allclose(one.w, g.w, atol=1e-12)
        assert abs(one.rho - g.rho) < 1e-9


def test_checkpoint_materialization_gives_the_same_report(spark):
    cfg_p = ExperimentConfig(domain_features=FEATS)
    cfg_c = ExperimentConfig(domain_features=FEATS, materialize="checkpoint")
    f = fixtures.flows(spark, SF_SMALL)
    a = sorted(map(tuple, jobs.run_detection(f, cfg_p).report.collect()))
    b = sorted(map(tuple, jobs.run_detection(f, cfg_c).report.collect()))
    assert a == b


def test_grid_keeps_declared_order_with_contamination_innermost():
    from flowsentry.plans.search import parameter_grid
    grid = {"n": [2, 1], "contamination": [0.1, 0.2], "a": ["x", "y"]}
    got = [(p["n"], p["a"], p["contamination"]) for p in parameter_grid(grid)]
    assert got == [(n, a, k) for n in (2, 1) for a in ("x", "y") for k in (0.1, 0.2)]


def test_enrichment_refits_searched_parameters_and_keeps_colliding_keys(spark, monkeypatch):
    from flowsentry.config import ExperimentConfig
    from flowsentry.plans import jobs, search
    from flowsentry.sources import fixtures
    flows = fixtures.flows(spark, "/root/testdata/sf0.001")
    found = {"n_neighbors": 7, "metric": "euclidean", "contamination": 0.1}
    monkeypatch.setattr(search, "detector_search", lambda prepared, cfg: {"params": found})
    seen = []
    real = jobs.fit_detector
    monkeypatch.setattr(jobs, "fit_detector", lambda a, p, t, *x, **k: (seen.append((dict(p), t)), real(a, p, t, *x, **k))[1])
    cfg = ExperimentConfig(algorithm="lof", hyper_search=True)
    res = jobs.run_extra_normal(flows, flows, cfg)  # the second table repeats every key
    assert [p for p, _ in seen] == [found, found]
    train = seen[1][1]
    assert train.count() == train.select("flow_id").distinct().count() == seen[0][1].count() + res.added_rows
    assert res.after_report.count() > 0
