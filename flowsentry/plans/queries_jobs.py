"""Catalogue part 3: models and jobs (rows-only checks unless SQL can state them)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..config import ExperimentConfig
from ..sources import fixtures
from . import jobs
from .catalog import register

FLAGSHIP_FEATURES = ("Eng_Flow_Rates", "Eng_Packet_Shape", "Eng_Temporal_Burstiness")


@register("j1_detection_iforest")
def j1_detection_iforest(spark, sf):
    """J1 with Isolation Forest: clean → features → novelty split → filters and
    imputer fitted on train → robust scaling → forest → val/test report."""
    cfg = ExperimentConfig(domain_features=FLAGSHIP_FEATURES)
    res = jobs.run_detection(fixtures.flows(spark, sf), cfg)
    return res.report.select("split", "row", *[F.round(k, 6).alias(k) for k in
                                               ("precision", "recall", "f1")], "support")


@register("j1_detection_iforest_wide")
def j1_detection_iforest_wide(spark, sf):
    """J1 on ``flows_wide`` (every flow 20×): the scaling run of the flagship."""
    cfg = ExperimentConfig(domain_features=FLAGSHIP_FEATURES)
    res = jobs.run_detection(fixtures.flows_wide(spark, sf), cfg)
    return res.report.select("split", "row", *[F.round(k, 6).alias(k) for k in
                                               ("precision", "recall", "f1")], "support")


@register("j1_detection_lof")
def j1_detection_lof(spark, sf):
    """J1 with LOF (novelty, exact neighbours) on the flows table."""
    cfg = ExperimentConfig(algorithm="lof", domain_features=FLAGSHIP_FEATURES)
    res = jobs.run_detection(fixtures.flows(spark, sf), cfg)
    return res.report.select("split", "row", *[F.round(k, 6).alias(k) for k in
                                               ("precision", "recall", "f1")], "support")


@register("j2_classification_gbt")
def j2_classification_gbt(spark, sf):
    """Stratified split, prep fitted on train, SMOTE + boosted trees, test and
    train reports (A17 gap from the same fitted model)."""
    cfg = ExperimentConfig(novelty=False, domain_features=FLAGSHIP_FEATURES)
    res = jobs.run_classification(fixtures.flows(spark, sf), cfg)
    return res.report.select("split", "row", *[F.round(k, 6).alias(k) for k in
                                               ("precision", "recall", "f1")], "support")


@register("a17_train_test_gap")
def a17_train_test_gap(spark, sf):
    """Macro F1 on train and test of one fitted classifier, and the gap."""
    cfg = ExperimentConfig(novelty=False, domain_features=FLAGSHIP_FEATURES)
    res = jobs.run_classification(fixtures.flows(spark, sf), cfg)
    g = res.f1
    return spark.createDataFrame([(float(g["f1_train"]), float(g["f1_test"]), float(g["gap"]))],
                                 "f1_train double, f1_test double, gap double")


def _domains(spark, sf):
    f = fixtures.flows(spark, sf)
    return f.filter(F.col("domain") == "train"), f.filter(F.col("domain") == "gen")


@register("j3_extra_normal")
def j3_extra_normal(spark, sf):
    """Normals of the ``gen`` domain appended to train, detector refitted;
    test report after enrichment."""
    a, b = _domains(spark, sf)
    res = jobs.run_extra_normal(a, b, ExperimentConfig(domain_features=FLAGSHIP_FEATURES))
    return res.after_report.select("split", "row", *[F.round(k, 6).alias(k) for k in
                                                     ("precision", "recall", "f1")], "support")


@register("j4_fewshot_detection")
def j4_fewshot_detection(spark, sf):
    """A few target-domain normals join train; test and holdout after refit."""
    a, b = _domains(spark, sf)
    res = jobs.run_fewshot_detection(a, b, ExperimentConfig(domain_features=FLAGSHIP_FEATURES))
    return res.after.unionByName(res.holdout).select(
        "split", "row", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")],
        "support")


@register("j5_fewshot_classification")
def j5_fewshot_classification(spark, sf):
    """A few target-domain attacks join train; test and holdout after refit."""
    a, b = _domains(spark, sf)
    res = jobs.run_fewshot_classification(
        a, b, ExperimentConfig(novelty=False, domain_features=FLAGSHIP_FEATURES))
    return res.after.unionByName(res.holdout).select(
        "split", "row", *[F.round(k, 6).alias(k) for k in ("precision", "recall", "f1")],
        "support")


@register("j7_component_report")
def j7_component_report(spark, sf):
    """Explained-variance curve of the prepared training rows."""
    return jobs.component_report(fixtures.flows(spark, sf), ExperimentConfig())


@register("f4_pca_reduce")
def f4_pca_reduce(spark, sf):
    """filters + imputer + 5-component PCA fitted on train, val/test projected."""
    from ..operators.prep import PrepModel
    from .queries_stats import kept_x1
    x1 = kept_x1(spark, sf)
    model = PrepModel.fit(x1.filter(F.col("split") == "train"), fixtures.FLOW_FEATURES,
                          ["flow_id"], pca_components=5)
    return model.transform(x1, keep=["flow_id", "Label", "split"])


@register("f5_pca_view")
def f5_pca_view(spark, sf):
    """≤ 10,000 rows per class of the test split, standard-scaled, 3-D PCA."""
    from ..operators.prep import PrepModel
    from .queries_stats import kept_x1
    from .views import pca_view
    x1 = kept_x1(spark, sf)
    prep = PrepModel.fit(x1.filter(F.col("split") == "train"), fixtures.FLOW_FEATURES,
                         ["flow_id"])
    test = prep.transform(x1.filter(F.col("split") == "test"))
    return pca_view(test, prep.output_columns, "flow_id", n_components=3).points


@register("f6_cross_domain_view")
def f6_cross_domain_view(spark, sf):
    """train-domain vs target-domain normal/attack sets in one 2-D PCA,
    with each set's centroid distance to the train-domain normals."""
    from ..operators import splits
    from ..operators.prep import PrepModel
    from .views import cross_domain_view
    kept = fixtures.flows(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)  # both domains, built once
    a, b = kept.filter(F.col("domain") == "train"), kept.filter(F.col("domain") == "gen")
    x1 = splits.novelty_split(a, ["flow_id"])
    prep = PrepModel.fit(x1.filter(F.col("split") == "train"), fixtures.FLOW_FEATURES,
                         ["flow_id"])
    view, drift = cross_domain_view(x1.filter(F.col("split") != "val"), b, prep, "flow_id")
    pts = view.points.join(drift, on=["domain", "class"], how="left")
    return pts.select("flow_id", "domain", "class", "pc1", "pc2",
                      F.round("centroid_dist", 6).alias("centroid_dist"))


@register("a15_explained_variance")
def a15_explained_variance(spark, sf):
    """A15 on the embeddings: per-component and cumulative explained variance."""
    from ..operators.pca import explained_variance_curve
    from .queries_models import emb
    e = emb(spark, sf)
    cols = [F.col("embedding")[i].alias(f"e{i}") for i in range(64)]
    wide = e.select("vec_id", *cols)
    return explained_variance_curve(wide, [f"e{i}" for i in range(64)])


@register("j1_detection_svm")
def j1_detection_svm(spark, sf):
    """J1 with the One-Class SVM (random-Fourier-feature approximation)."""
    cfg = ExperimentConfig(algorithm="svm", domain_features=FLAGSHIP_FEATURES)
    res = jobs.run_detection(fixtures.flows(spark, sf), cfg)
    return res.report.select("split", "row", *[F.round(k, 6).alias(k) for k in
                                               ("precision", "recall", "f1")], "support")


@register("h1_search_iforest")
def h1_search_iforest(spark, sf):
    """H1 over the full Isolation Forest grid (216 configurations, 9 forests)."""
    from .search import iforest_search
    cfg = ExperimentConfig(domain_features=FLAGSHIP_FEATURES)
    prepared = jobs.prepare(fixtures.flows(spark, sf), cfg)
    return iforest_search(prepared, cfg)["table"]


@register("h1_search_lof")
def h1_search_lof(spark, sf):
    """H1 over the full LOF grid (30 configurations, 2 neighbour tables)."""
    from .search import lof_search
    cfg = ExperimentConfig(algorithm="lof", domain_features=FLAGSHIP_FEATURES)
    prepared = jobs.prepare(fixtures.flows(spark, sf), cfg)
    return lof_search(prepared, cfg)["table"]


@register("st1_stream_scoring")
def st1_stream_scoring(spark, sf):
    """ST1: the fitted J1 path applied to a file stream of target-domain flows
    (availableNow trigger into a Parquet sink below the shared folder)."""
    from ..session import scratch_path
    from ..streaming.score import file_stream, run_available_now, score_stream
    flows = fixtures.flows(spark, sf)
    cfg = ExperimentConfig(domain_features=FLAGSHIP_FEATURES)
    res = jobs.run_detection(flows.filter(F.col("domain") == "train"), cfg)
    src = scratch_path(spark, "stream-in")
    target = flows.filter(F.col("domain") == "gen")
    target.repartition(4).write.mode("overwrite").parquet(src)
    stream = file_stream(spark, src, target.schema)
    scored = score_stream(stream, res.prepared.prep, res.prepared.scaler, res.detector,
                          cfg.domain_features, keep=["flow_id", "Label"])
    out, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    run_available_now(scored, out, ckpt)
    return spark.read.parquet(out).select("flow_id", "Label", F.round("score", 6).alias("score"),
                                          "y_pred")


@register("h1_search_svm")
def h1_search_svm(spark, sf):
    """H1 over the full one-class SVM grid (20 configurations fitted together)."""
    from .search import svm_search
    cfg = ExperimentConfig(algorithm="svm", domain_features=FLAGSHIP_FEATURES)
    prepared = jobs.prepare(fixtures.flows(spark, sf), cfg)
    return svm_search(prepared, cfg)["table"]


@register("h3_classifier_search")
def h3_classifier_search(spark, sf):
    """H3 over the shape of the full grid (2 round counts x 2 depths x 2 rates), with 8 and 20
    rounds: four fits, of which each holds its smaller one."""
    from ..config import CLASSIFIER_GRID
    from .search import classifier_search
    cfg = ExperimentConfig(novelty=False, domain_features=FLAGSHIP_FEATURES)
    prepared = jobs.classifier_prepare(fixtures.flows(spark, sf), cfg)
    return classifier_search(prepared, cfg, {**CLASSIFIER_GRID, "n_estimators": [8, 20]})["table"]
