"""Edge inputs (FIXTURES.md §5) for the row-wise and fitted operators."""

import math

import pytest
from pyspark.sql import functions as F

from flowsentry.functions.features import add_domain_features
from flowsentry.operators import clean, splits, stats
from flowsentry.operators.filters import fit_filters
from flowsentry.operators.prep import PrepModel

INF, NAN = float("inf"), float("nan")


def frame(spark, rows, cols="k long, a double, b double, Label int"):
    return spark.createDataFrame(rows, cols)


def test_empty_table(spark):
    df = frame(spark, [])
    assert clean.drop_invalid(df).count() == 0
    assert stats.class_distribution(df).count() == 0
    assert splits.novelty_split(df, ["k"]).count() == 0


def test_nan_null_inf_in_one_column(spark):
    df = frame(spark, [(1, NAN, 1.0, 0), (2, None, 1.0, 0), (3, INF, 1.0, 1),
                       (4, -INF, 1.0, 1), (5, 2.0, 1.0, 0)])
    assert [r.k for r in clean.drop_invalid(df).collect()] == [5]
    out = {r.k: r.a for r in clean.nonfinite_to_missing(df).collect()}
    assert out == {1: None, 2: None, 3: None, 4: None, 5: 2.0}
    # a row whose features are all missing still keeps its label → not dropped
    assert clean.drop_empty(df).count() == 5


def test_safe_division_by_minus_one_and_nonfinite(spark):
    names = ["Soma Fwd Packets", "Subflow Bwd Packets"]
    df = spark.createDataFrame([(5.0, -1.0), (INF, 1.0), (NAN, 0.0), (None, 3.0), (4.0, 1.0)],
                               ", ".join(f"`{n}` double" for n in names))
    out = add_domain_features(df, ["pkts_ratio_bwd_fwd", "avg_pkt_size_fwd"])
    vals = [(r.pkts_ratio_bwd_fwd) for r in out.collect()]
    # BP / (FP + 1): FP=-1 → den 0 → 0 (never raises under ANSI)
    assert vals == [-1.0 / 6.0, 0.0, 0.0, 0.0, 0.2]


def test_indicator_on_missing_is_zero(spark):
    df = spark.createDataFrame([(None,), (NAN,), (50.0,), (-INF,)], "`Flow Duration` double")
    out = add_domain_features(df, ["is_short_flow"]).collect()
    assert [r.is_short_flow for r in out] == [0, 0, 1, 1]


def test_init_win_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None, 5.0), (-1.0, -1.0), (3.0, -1.0)],
                               "Init_Win_bytes_forward double, Init_Win_bytes_backward double")
    out = [r.init_win_ratio for r in add_domain_features(df, ["init_win_ratio"]).collect()]
    assert out == [0.0, 0.0, 3.0]


def test_filters_constant_allnull_duplicate_columns(spark):
    rows = [(i, float(i % 7), 1.0, None, float(i % 7), float(i * i % 11), 0) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, a double, const double, nul double, "
                                     "dup double, z double, Label int")
    fm = fit_filters(df, ["a", "const", "nul", "dup", "z"], ["k"])
    assert fm.dropped_low_variance == ["const", "nul"]   # all-null → 0 → constant
    assert fm.dropped_duplicates == ["dup"]
    assert fm.kept_columns == ["a", "z"]


def test_one_row_variance_keeps_column(spark):
    df = frame(spark, [(1, 1.0, 2.0, 0)])
    fm = fit_filters(df, ["a", "b"], ["k"])
    assert fm.kept_columns == ["a", "b"]


def test_imputer_drops_all_missing_and_clamps(spark):
    tr = frame(spark, [(1, -4.0, None, 0), (2, 2.0, None, 0)])
    m = PrepModel.fit(tr, ["a", "b"], ["k"], apply_filters=False)
    assert m.output_columns == ["a"]
    out = m.transform(frame(spark, [(3, None, 1.0, 0), (4, -2.0, 1.0, 0)]), keep=["k"]).collect()
    # mean −1 (negatives included), then negatives → 0
    assert [r.a for r in out] == [0.0, 0.0]


def test_column_missing_from_second_domain(spark):
    tr = frame(spark, [(1, 1.0, 2.0, 0), (2, 3.0, 4.0, 0)])
    m = PrepModel.fit(tr, ["a", "b"], ["k"], apply_filters=False)
    other = spark.createDataFrame([(9, 5.0)], "k long, a double")
    r = m.transform(other, keep=["k"]).collect()[0]
    assert (r.a, r.b) == (5.0, 3.0)


def test_one_class_only_and_contamination_cap(spark):
    df = frame(spark, [(i, float(i), 0.0, 0) for i in range(20)])
    s = splits.novelty_split(df, ["k"])
    assert s.filter(F.col("Label") == 1).count() == 0
    bad = splits.single_class_splits(s).collect()
    assert {r.split for r in bad} == {"train", "val", "test"}
    mixed = frame(spark, [(i, float(i), 0.0, 1 if i < 2 else 0) for i in range(40)])
    # 0.5 would need 38 attacks; only 2 exist → capped, normals all kept
    out = splits.contamination(mixed, 0.5, ["k"])
    assert out.filter(F.col("Label") == 1).count() == 2
    assert out.filter(F.col("Label") == 0).count() == 38


def test_split_counts_follow_the_rounding_rules(spark):
    df = frame(spark, [(i, float(i), 0.0, 1 if i % 5 == 0 else 0) for i in range(103)])
    s = splits.novelty_split(df, ["k"]).groupBy("Label", "split").count().collect()
    got = {(r.Label, r.split): r["count"] for r in s}
    n0, n1 = 82, 21
    t0 = math.ceil(0.4 * n0)
    assert got[(0, "train")] == n0 - t0
    assert got[(0, "test")] == math.ceil(0.75 * t0)
    t1 = math.ceil(0.4 * n1)
    assert (1, "train") not in got
    assert got[(1, "val")] + got[(1, "test")] == t1


def test_smote_needs_more_minority_rows_than_neighbours(spark):
    from flowsentry.operators.smote import smote
    rows = [(i, [float(i), 0.0], 1 if i < 5 else 0) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, v array<double>, Label int")
    with pytest.raises(ValueError):
        smote(df, "k", "v", k_neighbors=5)


def test_drop_invalid_reports_removed_count_in_the_same_job(spark):
    df = frame(spark, [(1, NAN, 1.0, 0), (2, 1.0, 1.0, 0), (3, INF, 1.0, 1), (4, 2.0, None, 0)])
    kept, obs = clean.drop_invalid(df, observe=True)
    assert kept.count() == 1
    assert obs.get == {"removed": 3, "rows_in": 4}


def test_fit_row_cap_uses_at_most_the_cap(spark):
    from flowsentry.operators.detect import fit_detector
    rows = [(i, float(i % 17), float(i % 5), 0) for i in range(600)]
    df = frame(spark, rows)
    det = fit_detector("isolation_forest", {"n_estimators": 5}, df, ["a", "b"], ["k"],
                       n_rows=600, max_fit_rows=100)
    assert det.model.psi == 100          # ψ = min(256, rows actually fitted)


def test_jobs_reject_unknown_feature_names(spark):
    from flowsentry.config import ExperimentConfig
    from flowsentry.plans import jobs
    from flowsentry.sources import fixtures
    f = fixtures.flows(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        jobs.feature_table(f, ExperimentConfig(domain_features=("Eng_Flow_Rates", "nope")))
    # the operator itself only warns and skips
    assert "pkt_rate" in add_domain_features(f, ["Eng_Flow_Rates", "nope"]).columns
