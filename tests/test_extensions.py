"""Registered groups and models, removed-row counts, shared fits of a search, skipped views."""

import json

import pytest
from pyspark.sql import functions as F

from flowsentry import registry
from flowsentry.config import ExperimentConfig
from flowsentry.functions import features as feat
from flowsentry.operators import metrics
from flowsentry.operators.boost import fit_boost
from flowsentry.operators.prep import PrepModel
from flowsentry.operators.smote import oversample
from flowsentry.plans import jobs, search, views
from flowsentry.sources import fixtures
from paths import SF_SMALL


class Distance:
    """A toy detector from outside the package: minus the distance to the training mean."""

    def __init__(self, means, power):
        self.means, self.power = means, power

    def score(self, df, keep=(), out="score"):
        far = sum((F.pow(F.abs(F.col(f"`{f}`") - F.lit(m)), F.lit(self.power)) for f, m in self.means.items()), F.lit(0.0))
        return df.select(*[F.col(f"`{k}`") for k in keep], (-far).alias(out))


def fit_distance(train, features, key_cols, *, seed, n_rows, power=1.0):
    row = train.agg(*[F.avg(f"`{f}`").alias(f) for f in features]).collect()[0]
    return Distance({f: row[f] for f in features}, power)


class Constant:
    def predict(self, df, keep=()):
        return df.select(*[F.col(f"`{k}`") for k in keep], F.lit(1).alias("y_pred"))


@pytest.fixture
def extended():
    feat.register_group("Own_Group", [("own_ratio", (feat.FP, feat.BP), lambda e: e[feat.FP] / (e[feat.BP] + F.lit(2.0)))])
    registry.register_detector("distance", registry.Detector(fit_distance, -1.0, grid={"power": [1.0, 2.0], "contamination": [0.1, 0.3]}))
    registry.register_classifier("constant", registry.Classifier(lambda *a, **k: Constant()))
    yield
    feat.unregister_group("Own_Group")
    del registry.DETECTORS["distance"], registry.CLASSIFIERS["constant"]


def test_own_group_and_detector_run_in_j1_and_h1(spark, extended):
    flows = fixtures.flows(spark, SF_SMALL)
    d = feat.add_domain_features(flows, ["Own_Group"])
    assert d.columns == [*flows.columns, "own_ratio"]
    cfg = ExperimentConfig(algorithm="distance", domain_features=("Own_Group",), params={"power": 2.0, "contamination": 0.2})
    res = jobs.run_detection(flows, cfg)
    assert "own_ratio" in [*res.prepared.prep.output_columns, *res.prepared.prep.input_columns]
    assert res.scored.filter("y_pred = -1").count() > 0 and res.report.count() == 10
    out = search.detector_search(res.prepared, cfg)
    rows = out["table"].collect()
    assert len(rows) == 4 and out["macro_f1"] == max(r.macro_f1 for r in rows)
    with pytest.raises(ValueError):
        registry.register_detector("distance", registry.DETECTORS["lof"])
    with pytest.raises(ValueError):
        feat.register_group("Another", [("own_ratio", (), lambda e: F.lit(1.0))])


def test_own_classifier_runs_in_j2(spark, extended):
    res = jobs.run_classification(fixtures.flows(spark, SF_SMALL), ExperimentConfig(novelty=False, classifier="constant"))
    rows = {(r.split, r.row): r for r in res.report.collect()}
    assert rows["test", "1"].recall == 1.0 and rows["test", "0"].recall == 0.0


def test_config_checks():
    for bad in ({"algorithm": "none"}, {"classifier": "none"}, {"train_size": 1.0}, {"few_shot_ratio": 0.0}, {"max_active_time": -1.0},
                {"materialize": "memory"}, {"feature_whitelist": ("a", "a")}, {"params": {"not a name": 1}}, {"key_cols": ("Label",)}):
        with pytest.raises(ValueError):
            ExperimentConfig(**bad)
    assert ExperimentConfig(few_shot_ratio=1.0, max_active_time=5).model_params() == {}


@pytest.mark.parametrize("keep", ["persist", "checkpoint"])
def test_removed_rows_are_counted_without_a_job(spark, keep):
    flows = fixtures.flows(spark, SF_SMALL)
    bad = flows.withColumn("Flow Duration", F.when(F.col("flow_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("`Flow Duration`")))
    cut = float(flows.agg(F.percentile_approx("`Active Max`", 0.9)).collect()[0][0])
    invalid = bad.filter("flow_id % 10 = 0").count()
    valid = bad.filter("flow_id % 10 <> 0")
    from flowsentry.operators.clean import drop_invalid
    invalid = bad.count() - drop_invalid(bad).count()
    trimmed = drop_invalid(valid).filter(F.col("`Active Max`") > cut).count()
    assert invalid > 0 and trimmed > 0
    res = jobs.run_detection(bad, ExperimentConfig(max_active_time=cut, materialize=keep, params={"n_estimators": 5}))
    assert res.removed == {"invalid": invalid, "trimmed": trimmed}
    res.release()
    assert res.prepared.kept == []
    two = jobs.run_classification(bad, ExperimentConfig(novelty=False, materialize=keep), {"n_estimators": 2, "max_depth": 2})
    assert two.removed == {"invalid": invalid, "trimmed": 0}


def test_a_large_fit_holds_the_smaller_ones(spark):
    """H3: the best of shared fits is the best of separate fits, configuration by configuration."""
    cfg = ExperimentConfig(novelty=False, domain_features=("Eng_Flow_Rates",))
    prepared = jobs.classifier_prepare(fixtures.flows(spark, SF_SMALL), cfg)
    grid = {"n_estimators": [2, 4], "max_depth": [2, 3], "learning_rate": [0.1, 0.3], "subsample": [0.8], "colsample_bytree": [0.8]}
    out = search.classifier_search(prepared, cfg, grid)
    got = {r.grid_idx: r for r in out["table"].collect()}
    assert len(got) == 8
    rows = oversample(prepared.table.filter("split = 'train'"), "flow_id", prepared.features, seed=cfg.random_state).persist()
    val, n, alone = prepared.table.filter("split = 'val'").persist(), rows.count(), {}
    for i, p in enumerate(search.parameter_grid(grid)):
        assert json.loads(got[i].params) == p
        pred = fit_boost(rows, prepared.features, "Label", p, seed=cfg.random_state, n_rows=n).predict(val, keep=["Label"])
        alone[i] = metrics.macro_f1(metrics.confusion(pred, "Label", "y_pred", [0, 1])).collect()[0]["macro_f1"]
    assert all(abs(got[i].macro_f1 - alone[i]) < 1e-12 for i in got)
    assert out["grid_idx"] == min(i for i in alone if alone[i] == max(alone.values()))


def test_cross_domain_view_skips_empty_or_unlabelled_targets(spark):
    flows = fixtures.flows(spark, SF_SMALL)
    prep = PrepModel.fit(flows, fixtures.FLOW_FEATURES, ["flow_id"])
    assert views.cross_domain_view(flows, flows.drop("Label"), prep, "flow_id") is None
    assert views.cross_domain_view(flows, flows.limit(0), prep, "flow_id") is None
    assert views.cross_domain_view(flows, flows, prep, "flow_id") is not None
