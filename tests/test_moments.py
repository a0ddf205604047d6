"""Moments leave the Python stage as one vector per task."""

import numpy as np
from pyspark.sql import functions as F

from flowsentry.operators.filters import centered_moments


def test_one_vector_per_task_and_exact_sums(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # many batches a task
    try:
        n, d = 3000, 6
        df = spark.range(n, numPartitions=4).select(*[(F.sin(F.col("id") * (k + 1)) * 100 + k).alias(f"x{k}") for k in range(d)]).cache()
        made = []
        real = type(df).mapInPandas
        monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: (made.append(real(self, *a, **k)), made[-1])[1])
        got_n, mean, C = centered_moments(df, [F.col(c) for c in df.columns], [0.0, None, float("nan"), 1.0, 2.0, 3.0])
        assert made[0].count() == 4
        X = np.array(df.collect(), float)
        assert got_n == n
        assert np.allclose(mean, X.mean(axis=0), rtol=0, atol=1e-9)
        assert np.allclose(C, (X - X.mean(axis=0)).T @ (X - X.mean(axis=0)), rtol=1e-10, atol=1e-6)
        assert centered_moments(df.limit(0), [F.col("x0")], [0.0])[0] == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
