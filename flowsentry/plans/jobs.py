"""End-to-end jobs (J1–J7) as Spark plans.

The shape of every job: one lazy plan from the source table to the split
table, **persisted once** (it feeds several small fitting passes), fitted
numbers brought to the driver as literals, then one scoring plan and one
metrics aggregate.  No row-level data reaches the driver.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .. import registry
from ..config import ExperimentConfig
from ..functions import features as feat
from ..functions.safe import c
from ..operators import clean, metrics, splits
from ..operators.detect import FittedDetector, fit_detector
from ..operators.prep import PrepModel, Scaler

log = logging.getLogger(__name__)


@dataclass
class Prepared:
    """The split table after features, prep and scaling, plus what was fitted."""
    table: DataFrame            # key, Label, split, y_det, feature columns (scaled)
    features: list[str]
    prep: PrepModel
    scaler: Scaler | None
    counts: dict = field(default_factory=dict)   # rows per split
    unscaled: DataFrame | None = None            # the table before scaling, for refits
    removed: dict = field(default_factory=dict)  # rows dropped by P1 ("invalid") and P4 ("trimmed")
    kept: list = field(default_factory=list)     # persisted tables

    def release(self) -> None:
        """Free the persisted tables; what is computed later from this result is recomputed."""
        while self.kept:
            self.kept.pop().unpersist()


def feature_table(df: DataFrame, cfg: ExperimentConfig) -> tuple[DataFrame, dict]:
    """P1 → P4 → D48 → P5: the cleaned flow table with engineered features, and the
    observations of P1 and P4 (filled by the first job that reads the whole table)."""
    d, invalid = clean.drop_invalid(df, observe=True)
    d, trimmed = clean.trim_by_feature(d, "Active Max", cfg.max_active_time, observe=True)
    d = feat.add_domain_features(d, cfg.domain_features, whitelist=cfg.feature_whitelist,
                                 strict=True)
    if cfg.feature_whitelist:
        d = clean.whitelist(d, list(cfg.feature_whitelist), cfg.label,
                            keep=[k for k in cfg.meta_cols if k in d.columns])
    return d, {"invalid": invalid, "trimmed": trimmed}


def removed_counts(observed: dict) -> dict:
    """Removed rows by step, once a job has read the table (no job of its own)."""
    return {step: int(obs.get["removed"]) if obs is not None else 0 for step, obs in observed.items()}


def split_counts(s: DataFrame, cfg: ExperimentConfig) -> dict:
    """Rows per split from one (split, class) aggregate; warns (A16) when a
    split that should hold both classes holds one (a novelty train split is
    normals-only by design)."""
    per: dict = {}
    for r in s.groupBy("split", c(cfg.label).alias("y")).count().collect():
        per.setdefault(r["split"], {})[r["y"]] = r["count"]
    novelty_train = cfg.novelty or cfg.algorithm == "svm"
    for name, by_class in per.items():
        if len(by_class) < 2 and not (name == "train" and novelty_train):
            log.warning("split %r has a single class %s: unstable metrics", name,
                        sorted(by_class))
    return {name: sum(v.values()) for name, v in per.items()}


def materialize(d: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    """Keep the cleaned feature table for the several fitting passes."""
    if cfg.materialize == "checkpoint":
        from ..session import cut_lineage
        return cut_lineage(d)
    return d.persist(StorageLevel.MEMORY_AND_DISK)


def split_table(d: DataFrame, cfg: ExperimentConfig) -> DataFrame:
    keys = list(cfg.key_cols)
    if cfg.novelty or cfg.algorithm == "svm":
        s = splits.novelty_split(d, keys, cfg.label, cfg.train_size, cfg.val_ratio,
                                 cfg.random_state)
    elif cfg.temporal_split:
        s = splits.positional_split(d, list(cfg.order_cols), cfg.label, cfg.train_size,
                                    cfg.val_ratio)
    else:
        s = splits.stratified_split(d, keys, cfg.label, cfg.train_size, cfg.val_ratio,
                                    cfg.random_state)
    if not cfg.novelty and cfg.algorithm != "svm":
        # X4 on the training rows only; val/test keep the real class mix.
        train = splits.contamination(s.filter(c("split") == "train"), cfg.contamination,
                                     keys, cfg.label, cfg.random_state)
        s = train.unionByName(s.filter(c("split") != "train"))
    return s


def prepare(df: DataFrame, cfg: ExperimentConfig, scale: bool = True) -> Prepared:
    # The cleaned feature table feeds the split's histogram, its boundary rows
    # and every fitting pass: persisted once.  The split itself is a narrow
    # projection over it.
    d, observed = feature_table(df, cfg)
    d = materialize(d, cfg)
    features = clean.feature_names(d, cfg.label, exclude=cfg.meta_cols)
    s = split_table(d, cfg)
    train = s.filter(c("split") == "train")
    prep = PrepModel.fit(train, features, list(cfg.key_cols),
                         apply_filters=cfg.apply_filters and not cfg.feature_whitelist,
                         pca_components=cfg.pca_reduce)
    keep = [*cfg.key_cols, cfg.label, "split"]
    p = prep.transform(s, keep=keep)
    feats = list(prep.output_columns)
    counts = split_counts(s, cfg)
    unscaled = p.withColumn("y_det", clean.detector_label(c(cfg.label)))
    scaler = None
    if scale:
        scaler = Scaler.fit(p.filter(c("split") == "train"), feats, "robust")
        p = scaler.transform(p)
    p = p.withColumn("y_det", clean.detector_label(c(cfg.label)))
    return Prepared(p, feats, prep, scaler, counts, unscaled, removed_counts(observed), [d])


@dataclass
class DetectionResult:
    prepared: Prepared
    detector: FittedDetector
    scored: DataFrame           # key, Label, split, y_det, score, y_pred
    report: DataFrame           # A14 per split (val, test)
    confusion: DataFrame        # A12 per split
    params: dict                # what the detector was fitted with (searched, if asked for)

    @property
    def removed(self) -> dict:
        """Rows that cleaning and trimming dropped: {"invalid": n, "trimmed": m}."""
        return self.prepared.removed

    def release(self) -> None:
        self.prepared.release()
        self.confusion.unpersist()


def evaluate(det: FittedDetector, prepared: Prepared, cfg: ExperimentConfig,
             splits_: tuple[str, ...] = ("val", "test")) -> tuple[DataFrame, DataFrame, DataFrame]:
    keep = [*cfg.key_cols, cfg.label, "split", "y_det"]
    rows = prepared.table.filter(c("split").isin(*splits_))
    scored = det.predict(rows, keep=keep)
    # the confusion table has 4 rows per split; caching it lets every branch
    # of the report read it instead of re-scoring
    conf = metrics.confusion(scored, "y_det", "y_pred", [1, -1], by=["split"]).cache()
    return scored, conf, metrics.report(conf, by=["split"])


def run_detection(df: DataFrame, cfg: ExperimentConfig | None = None) -> DetectionResult:
    """S1/P1/P4 → F7 → fit → val and test metrics."""
    cfg = cfg or ExperimentConfig()
    prepared = prepare(df, cfg)
    train = prepared.table.filter(c("split") == "train")
    n_train = prepared.counts.get("train", 0)
    params = cfg.model_params()
    if cfg.hyper_search:
        from .search import detector_search
        params = detector_search(prepared, cfg)["params"]
    det = fit_detector(cfg.algorithm, params, train, prepared.features, list(cfg.key_cols),
                       n_rows=n_train, seed=cfg.random_state, max_fit_rows=cfg.max_fit_rows)
    scored, conf, rep = evaluate(det, prepared, cfg)
    return DetectionResult(prepared, det, scored, rep, conf, params)


# ---------------------------------------------------------------- J2 supervised


@dataclass
class ClassificationResult:
    prepared: Prepared
    model: Any
    report: DataFrame          # A14 per split ("test", "train")
    f1: dict                   # macro F1 per split and the train/test gap (A17)
    params: dict | None = None  # what the model was fitted with

    @property
    def removed(self) -> dict:
        return self.prepared.removed

    def release(self) -> None:
        self.prepared.release()


def classifier_prepare(df: DataFrame, cfg: ExperimentConfig) -> Prepared:
    """S1/P1 → D48 → X2 (or X3) → filters + imputer fitted on train (no scaling)."""
    d, observed = feature_table(df, cfg)
    d = materialize(d, cfg)
    features = clean.feature_names(d, cfg.label, exclude=cfg.meta_cols)
    keys = list(cfg.key_cols)
    if cfg.temporal_split:
        s = splits.positional_split(d, list(cfg.order_cols), cfg.label, cfg.train_size,
                                    cfg.val_ratio)
    else:
        s = splits.stratified_split(d, keys, cfg.label, cfg.train_size, cfg.val_ratio,
                                    cfg.random_state)
    prep = PrepModel.fit(s.filter(c("split") == "train"), features, keys,
                         apply_filters=cfg.apply_filters and not cfg.feature_whitelist,
                         pca_components=cfg.pca_reduce)
    p = prep.transform(s, keep=[*keys, cfg.label, "split"])
    counts = split_counts(s, cfg)
    return Prepared(p, list(prep.output_columns), prep, None, counts, None, removed_counts(observed), [d])


def fit_classifier(train: DataFrame, features, cfg: ExperimentConfig, params: dict | None,
                   use_smote: bool = True):
    """M9 (fit time only) then M8."""
    from ..operators.smote import oversample
    key = cfg.key_cols[0]
    fit_rows = (oversample(train, key, features, cfg.label, seed=cfg.random_state)
                if use_smote else train).persist(StorageLevel.MEMORY_AND_DISK)
    n = fit_rows.count()
    model = registry.classifier(cfg.classifier).fit(fit_rows, features, cfg.label, params, seed=cfg.random_state, n_rows=n)
    fit_rows.unpersist()
    return model


def classifier_metrics(model, rows: DataFrame, cfg: ExperimentConfig, split_name: str):
    keep = [*cfg.key_cols, cfg.label]
    pred = model.predict(rows, keep=keep).withColumn("split", F.lit(split_name))
    conf = metrics.confusion(pred, cfg.label, "y_pred", [0, 1], by=["split"])
    return conf


def run_classification(df: DataFrame, cfg: ExperimentConfig | None = None,
                       params: dict | None = None, use_smote: bool = True
                       ) -> ClassificationResult:
    """Fit SMOTE + boosted trees on train, test metrics, train/test gap.

    The train F1 scores the fitted model on the (un-oversampled) training rows;
    no second fit."""
    cfg = cfg or ExperimentConfig(novelty=False)
    prepared = classifier_prepare(df, cfg)
    t = prepared.table
    if cfg.hyper_search:
        from .search import classifier_search
        params = classifier_search(prepared, cfg)["params"]
    model = fit_classifier(t.filter(c("split") == "train"), prepared.features, cfg, params,
                           use_smote)
    conf = classifier_metrics(model, t.filter(c("split") == "test"), cfg, "test") \
        .unionByName(classifier_metrics(model, t.filter(c("split") == "train"), cfg, "train"))
    conf = conf.cache()   # tiny; read by every branch of the report
    rep = metrics.report(conf, by=["split"])
    f1 = {r["split"]: r["macro_f1"] for r in metrics.macro_f1(conf, by=["split"]).collect()}
    gap = metrics.train_test_gap(f1.get("train", 0.0), f1.get("test", 0.0))
    return ClassificationResult(prepared, model, rep, gap, params)


# ---------------------------------------------------------------- J3 – J5


def extra_normals(extra: DataFrame, prep: PrepModel, cfg: ExperimentConfig) -> DataFrame:
    """D48, the other table's normals (all rows when unlabelled, with a
    warning), drop-any-missing, then the fitted prep without refitting."""
    d = feat.add_domain_features(extra, cfg.domain_features, whitelist=cfg.feature_whitelist)
    if cfg.label in d.columns:
        d = d.filter(c(cfg.label) == 0)
    else:
        log.warning("no %s column in the extra table: every row is taken as normal", cfg.label)
        d = d.withColumn(cfg.label, F.lit(0))
    d = clean.drop_invalid(d)
    return prep.transform(d, keep=[*cfg.key_cols, cfg.label])


def tag_keys(d: DataFrame, cfg: ExperimentConfig, source: int) -> DataFrame:
    """Make the first key tell its table (0 or 1), so keys of two tables never collide.

    Whole-number keys become 2 k + source (the neighbour search needs numbers), others get a
    prefix."""
    key = cfg.key_cols[0]
    if isinstance(d.schema[key].dataType, IntegralType):
        return d.withColumn(key, c(key).cast("long") * 2 + source)
    return d.withColumn(key, F.concat(F.lit(f"{source}|"), c(key).cast("string")))


def refit_enriched(base: DetectionResult, added: DataFrame, n_added: int, cfg: ExperimentConfig
                   ) -> tuple[FittedDetector, Scaler | None, Prepared]:
    """Scaler and detector fitted anew on train plus ``added`` (unscaled), with the
    parameters of the evaluated model; the scaled table to evaluate on."""
    prep = base.prepared
    rows = tag_keys(prep.unscaled, cfg, 0)
    train = rows.filter(c("split") == "train").unionByName(
        tag_keys(added, cfg, 1).select(*rows.columns))
    scaler, n = None, prep.counts.get("train", 0) + n_added
    if prep.scaler is not None:
        scaler = Scaler.fit(train, prep.features, "robust")
        rows, train = scaler.transform(rows), scaler.transform(train)
    det = fit_detector(cfg.algorithm, base.params, train, prep.features, list(cfg.key_cols),
                       n_rows=n, seed=cfg.random_state, max_fit_rows=cfg.max_fit_rows)
    return det, scaler, Prepared(rows, prep.features, prep.prep, scaler, prep.counts, prep.unscaled)


@dataclass
class EnrichmentResult:
    before: DetectionResult
    after_report: DataFrame
    added_rows: int


def run_extra_normal(df: DataFrame, extra: DataFrame, cfg: ExperimentConfig | None = None
                     ) -> EnrichmentResult:
    """X9 rows appended to train (X10), the detector refitted, test metrics
    before and after (the reference appends but never refits; we refit)."""
    cfg = cfg or ExperimentConfig()
    before = run_detection(df, cfg)
    prep = before.prepared
    ex = extra_normals(extra, prep.prep, cfg) \
        .withColumn("split", F.lit("train")).withColumn("y_det", F.lit(1))
    n_added = ex.count()
    det, _, refitted = refit_enriched(before, ex, n_added, cfg)
    _, _, rep = evaluate(det, refitted, cfg, ("test",))
    return EnrichmentResult(before, rep, n_added)


@dataclass
class FewShotResult:
    before: DataFrame          # test report before
    after: DataFrame           # test report after refit
    holdout: DataFrame         # holdout report after refit (scored, Q3)
    n_few: int


def run_fewshot_detection(df: DataFrame, target: DataFrame, cfg: ExperimentConfig | None = None
                          ) -> FewShotResult:
    """X7 normals of the target table join train, prep reused, refit with the
    same parameters, test F1 before/after, holdout scored."""
    cfg = cfg or ExperimentConfig()
    base = run_detection(df, cfg)
    prep = base.prepared
    t = feat.add_domain_features(target, cfg.domain_features, whitelist=cfg.feature_whitelist)
    # kept once: the few-shot cut reads it twice and the prep once more
    t = materialize(clean.drop_empty(t), cfg)
    parts = splits.fewshot_split(t, 0, cfg.few_shot_ratio, list(cfg.key_cols), cfg.label,
                                 cfg.random_state)
    pt = prep.prep.transform(parts, keep=[*cfg.key_cols, cfg.label, "part"]) \
        .withColumn("y_det", clean.detector_label(c(cfg.label))).cache()
    few = pt.filter(c("part") == "few").withColumn("split", F.lit("train"))
    n_few = few.count()
    det, scaler, refitted = refit_enriched(base, few, n_few, cfg)
    _, _, after = evaluate(det, refitted, cfg, ("test",))
    hold = tag_keys(pt.filter(c("part") == "holdout"), cfg, 1).withColumn("split", F.lit("holdout"))
    if scaler is not None:
        hold = scaler.transform(hold)
    scored = det.predict(hold, keep=[*cfg.key_cols, cfg.label, "split", "y_det"])
    hconf = metrics.confusion(scored, "y_det", "y_pred", [1, -1], by=["split"])
    before = base.report.filter(c("split") == "test")
    return FewShotResult(before, after, metrics.report(hconf, by=["split"]), n_few)


def run_fewshot_classification(df: DataFrame, target: DataFrame,
                               cfg: ExperimentConfig | None = None,
                               params: dict | None = None) -> FewShotResult:
    """X8 attacks of the target table join train, refit, before/after, holdout."""
    cfg = cfg or ExperimentConfig(novelty=False)
    base = run_classification(df, cfg, params)
    prep = base.prepared
    t = feat.add_domain_features(target, cfg.domain_features, whitelist=cfg.feature_whitelist)
    t = materialize(clean.drop_empty(t), cfg)
    parts = splits.fewshot_split(t, 1, cfg.few_shot_ratio, list(cfg.key_cols), cfg.label,
                                 cfg.random_state)
    pt = prep.prep.transform(parts, keep=[*cfg.key_cols, cfg.label, "part"]).cache()
    few = pt.filter(c("part") == "few").withColumn("split", F.lit("train"))
    n_few = few.count()
    train = tag_keys(prep.table.filter(c("split") == "train"), cfg, 0).unionByName(
        tag_keys(few, cfg, 1).select(*prep.table.columns))
    model = fit_classifier(train, prep.features, cfg, base.params)
    after_conf = classifier_metrics(model, prep.table.filter(c("split") == "test"), cfg, "test")
    hold_conf = classifier_metrics(model, pt.filter(c("part") == "holdout"), cfg, "holdout")
    return FewShotResult(base.report.filter(c("split") == "test"),
                         metrics.report(after_conf, by=["split"]),
                         metrics.report(hold_conf, by=["split"]), n_few)


# ---------------------------------------------------------------- J6, J7


def balance_report(df: DataFrame, label: str = "Label", smote_key: str | None = None,
                   features: list[str] | None = None, arff_path: str | None = None
                   ) -> dict[str, DataFrame]:
    """Class distribution before and after P1, and the balance verdict;
    optionally SMOTE-balanced rows (M9), written as ARFF (S3)."""
    from ..operators import stats
    cleaned = clean.drop_invalid(df)
    out = {"before": stats.class_distribution(df, label),
           "after": stats.class_distribution(cleaned, label),
           "verdict": stats.balance_verdict(cleaned, label)}
    if smote_key is not None:
        from ..operators.smote import oversample
        from ..session import scratch_path
        feats = features or clean.feature_names(cleaned, label, exclude=[smote_key])
        # counts, the minority and the balanced rows each read the cleaned rows: derived and written once
        stored = scratch_path(df.sparkSession, "cleaned")
        cleaned.select(c(smote_key), *[c(f) for f in feats], c(label)).write.parquet(stored)
        cleaned = df.sparkSession.read.parquet(stored)
        balanced = oversample(cleaned, smote_key, feats, label)
        out["balanced"] = stats.class_distribution(balanced, label)
        if arff_path is not None:
            from ..sources.arff import write_arff
            write_arff(balanced.drop(smote_key), arff_path, relation="balanced", label=label)
    return out


def component_report(df: DataFrame, cfg: ExperimentConfig | None = None) -> DataFrame:
    """Novelty split, filters and imputer fitted on train, then the full
    explained-variance curve of the prepared training rows (A15)."""
    from ..operators.pca import explained_variance_curve
    cfg = cfg or ExperimentConfig()
    prepared = prepare(df, cfg, scale=False)
    train = prepared.table.filter(c("split") == "train")
    return explained_variance_curve(train, prepared.features)
