"""The column filters take all their numbers from one pass."""

import numpy as np

from flowsentry.operators.filters import correlation_matrix, column_profile, duplicate_columns, fit_filters, high_correlation, low_variance


def test_filters_read_the_rows_once_and_decide_as_the_single_steps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 3)) * [1, 50, 1e6] + [0, 1e5, 0]
    names = ["a", "b", "c", "flat", "a2", "b_near", "odd", "a3", "b2"]
    rows = [(i, *map(float, r), 7.0, float(r[0]), float(r[1] + rng.normal()), None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(i % 3),
             float(r[0]) if i != 650 else 0.5, float(r[1])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k long," + ",".join(f"{n} double" for n in names)).repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        spark.sparkContext.setJobGroup("filters", "")
        m = fit_filters(df, names, ["k"])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        passes = len(spark.sparkContext.statusTracker().getJobIdsForGroup("filters"))
        flat = low_variance(df, names)
        left = [n for n in names if n not in flat]
        dup = duplicate_columns(df, left, ["k"])
        left = [n for n in left if n not in dup]
        assert (m.dropped_low_variance, m.duplicate_of) == (flat, dup) == (["flat"], {"a2": "a", "b2": "b"})
        assert m.dropped_high_correlation == high_correlation(df, left) == ["b_near", "a3"]
        assert passes <= 2                                         # the rows are dealt, and read once
        prof, at = column_profile(df, names, ["k"]), [names.index(n) for n in left]
        sd = np.sqrt(np.diag(prof["moments"]))[at]
        assert np.allclose(prof["moments"][at][:, at] / np.outer(sd, sd), correlation_matrix(df, left), rtol=0, atol=1e-9)
        assert fit_filters(df.limit(0), names, ["k"]).kept_columns == ["a"]   # as before: columns without rows are equal
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
