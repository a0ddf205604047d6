"""Fits read a table that is built once, and per-task sums equal Spark's aggregates."""

import math

import numpy as np
from pyspark.sql import functions as F

from paths import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().withCachedData().toString()


def test_filter_and_pca_queries_fit_on_a_kept_table(spark):
    from flowsentry.plans.catalog import QUERIES
    for name in ("f7_prep_filters_impute", "f4_pca_reduce", "f5_pca_view", "f6_cross_domain_view"):
        assert "InMemoryRelation" in _plan(QUERIES[name](spark, SF_SMALL)), name
    spark.catalog.clearCache()


def test_column_profile_equals_aggregates_over_several_tasks(spark):
    from flowsentry.operators.filters import column_profile
    odd = [None, float("nan"), float("inf"), -float("inf"), 1e9]
    rows = [(i, 0.1, float(i % 7), odd[i % 5], 0.1 + i, 3) for i in range(1003)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double, e int").repartition(5)
    got = column_profile(df, ["a", "b", "c", "d", "e"], ["k"])
    filled = F.when((F.col("c") - F.col("c")) == 0.0, F.col("c"))
    want = df.agg(F.var_samp("b").alias("b"), F.var_samp(F.coalesce(filled, F.lit(0.0))).alias("c"), F.avg(filled).alias("m"), F.var_samp("d").alias("d")).first()
    assert got["_n"] == 1003 and got["v0"] == 0.0 and got["v4"] == 0.0   # constants stay exactly 0
    assert all(math.isclose(x, y, rel_tol=1e-12) for x, y in ((got["v1"], want["b"]), (got["v2"], want["c"]), (got["m2"], want["m"]), (got["v3"], want["d"])))
    assert (got["mn2"], got["mx2"], got["mx4"]) == (0.0, 1e9, 3.0)
    twin = column_profile(df.withColumn("z", F.col("b")), ["b", "z", "d"], ["k"])
    assert twin["h0"] == twin["h1"] != twin["h2"]
    none = column_profile(df.filter("k < 0"), ["a"], ["k"])
    assert none["_n"] == 0 and none["v0"] is None and none["m0"] is None
    one = column_profile(df.filter("k = 2"), ["c"], ["k"])
    assert one["_n"] == 1 and one["v0"] is None and one["m0"] is None
