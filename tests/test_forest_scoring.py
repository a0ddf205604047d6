"""Forests of a search are walked once per row; confusion tables score rows once."""

import numpy as np

from paths import SF_SMALL


def test_one_walk_scores_all_sizes_of_a_forest(spark):
    from flowsentry.operators.iforest import fit_forests, scores
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=3)), None if i % 50 else 1.0) for i in range(600)], "k long, a double, b double, c double, d double")
    f, g = fit_forests(df, ["a", "b", "c", "d"], ["k"], [{"n_estimators": 12, "max_samples": 64}, {"n_estimators": 5, "max_features": 0.5}])
    got = {r.k: (r.x, r.y, r.z) for r in scores(df, [(f, 12), (f, 4), (g, 5)], ["k"], ["x", "y", "z"]).collect()}
    for model, at in ((f, 0), (f.first(4), 1), (g, 2)):
        one = {r.k: r.score for r in model.score(df, keep=["k"]).collect()}
        assert one == {k: v[at] for k, v in got.items()}


def test_confusion_scores_rows_once(spark):
    from flowsentry.operators import metrics
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("a" if i % 3 else "b", 1 if i % 2 else -1, -1 if i % 5 else 1) for i in range(900)], "s string, y int, p int")
    conf = metrics.confusion(df.mapInArrow(run, df.schema), "y", "p", [1, -1], by=["s"]).collect()
    assert seen.value == 900 and len(conf) == 8 and sum(r.n for r in conf) == 900
    assert {(r.s, r.y_true, r.y_pred): r.n for r in conf}["b", 1, -1] == df.filter("s = 'b' AND y = 1 AND p = -1").count()


def test_forest_search_scores_each_row_once(spark, monkeypatch):
    from flowsentry.config import ExperimentConfig
    from flowsentry.operators import iforest
    from flowsentry.plans import jobs, search
    from flowsentry.sources import fixtures
    calls, real = [], iforest.scores
    monkeypatch.setattr(iforest, "scores", lambda *a: (calls.append(a), real(*a))[1])
    cfg = ExperimentConfig(domain_features=("Eng_Flow_Rates",))
    grid = {"contamination": [0.1], "max_features": [1.0, 0.5], "max_samples": [32], "n_estimators": [3, 6], "bootstrap": [False]}
    table = search.iforest_search(jobs.prepare(fixtures.flows(spark, SF_SMALL), cfg), cfg, grid)["table"]
    assert len(calls) == 2 and table.count() == 4   # train and val, whatever the grid


def test_thresholds_of_many_scores_equal_single_sweeps(spark):
    from flowsentry.operators import metrics
    rows = [(float(a), float(b), 1 if i % 4 else -1) for i, (a, b) in enumerate(np.random.default_rng(1).normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    asked = {"a": [0.1, 0.3], "b": [0.2]}
    got = {(r.score, r.contamination): (r.offset, r.macro_f1) for r in metrics.sweeps(df, asked, "y", df).collect()}
    want = {(n, r.contamination): (r.offset, r.macro_f1) for n, v in asked.items() for r in metrics.sweep(df, n, "y", df, v).collect()}
    assert got == want
