"""Aggregations and fitted statistics.

Each fitted statistic is one aggregate pass over the training rows: Spark
computes partial aggregates per task and merges them (map-side combine), so
only one row per task crosses the shuffle.  The results are a handful of
numbers per column that live on the driver as literals.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c, is_finite
from .quantile import percentiles

LABEL = "Label"

# Class names of the distribution report.
CLASS_NAMES = {0: "normal/benign", 1: "outlier/attack"}


def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    """A1: class, name (0 normal/benign, 1 outlier/attack, else ``?``), n, pct;
    missing labels not counted.  One aggregate; its result has one row per
    class (bounded by the label's cardinality), so percentages are computed
    from the collected counts."""
    rows = (df.filter(c(label).isNotNull()).groupBy(c(label).alias("y"))
            .agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(int(r["n"]) for r in rows)
    out = [(int(r["y"]), CLASS_NAMES.get(int(r["y"]), "?"), int(r["n"]),
            100.0 * int(r["n"]) / total) for r in rows]
    res = df.sparkSession.createDataFrame(out, "class int, name string, n long, pct double")
    return res.select("class", "name", "n", F.round("pct", 6).alias("pct"))


def balance_verdict(df: DataFrame, label: str = LABEL) -> DataFrame:
    """A2: majority:minority ratio, contamination % and the verdict, one row."""
    a = df.agg(F.count_if(c(label) == 0).alias("n0"), F.count_if(c(label) == 1).alias("n1"),
               F.count_distinct(c(label)).alias("n_classes"))
    big, small = F.greatest("n0", "n1"), F.least("n0", "n1")
    ratio = F.when(small == 0, F.lit(float("inf"))).otherwise(big / small)
    pct = F.when((F.col("n0") + F.col("n1")) == 0, F.lit(None).cast("double")) \
        .otherwise(F.lit(100.0) * F.col("n1") / (F.col("n0") + F.col("n1")))
    verdict = (F.when(F.col("n_classes") < 2, F.lit("single class"))
               .when(F.col("ratio") <= 1.5, F.lit("balanced"))
               .when(F.col("ratio") <= 4, F.lit("slightly imbalanced"))
               .otherwise(F.lit("strongly imbalanced")))
    return (a.withColumn("ratio", ratio).withColumn("contamination_pct", F.round(pct, 6))
            .withColumn("verdict", verdict)
            .select(F.col("n0").cast("long"), F.col("n1").cast("long"),
                    F.round("ratio", 6).alias("ratio"), "contamination_pct", "verdict"))


def split_profile(split_df: DataFrame, n_features: int, label: str = LABEL) -> DataFrame:
    """A3: rows, feature count and outlier share per split."""
    return split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(n_features).alias("features"),
        F.round(F.avg(c(label).cast("double")), 6).alias("outlier_share"))


def _one_row(df: DataFrame, exprs) -> dict:
    row = df.agg(*exprs).collect()[0]
    return row.asDict()


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Mean per column over non-missing values (NULL when none)."""
    r = _one_row(df, [F.avg(F.when(is_finite(c(n)), c(n))).alias(n) for n in columns])
    return {n: r[n] for n in columns}


def variances(df: DataFrame, columns: Sequence[str], fill_missing: float | None = 0.0
              ) -> dict[str, float | None]:
    """Sample variance (ddof 1) per column; missing → ``fill_missing`` first."""
    def v(n):
        x = c(n) if fill_missing is None else F.coalesce(
            F.when(is_finite(c(n)), c(n)), F.lit(fill_missing))
        return F.var_samp(x).alias(n)
    r = _one_row(df, [v(n) for n in columns])
    return {n: r[n] for n in columns}


def quartiles(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Linear-interpolated 25/50/75 % of the finite values per column, exact at every
    size."""
    r = percentiles(df, {n: F.when(is_finite(c(n)), c(n)) for n in columns}, [0.25, 0.5, 0.75])
    return {n: tuple(r[n]) if r[n] is not None else (None, None, None) for n in columns}


def mean_std(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """A10: mean and population std (std 0 or missing → 1)."""
    exprs = []
    for n in columns:
        x = F.when(is_finite(c(n)), c(n))
        exprs += [F.avg(x).alias(f"m_{n}"), F.stddev_pop(x).alias(f"s_{n}")]
    r = _one_row(df, exprs)
    out = {}
    for n in columns:
        s = r[f"s_{n}"]
        out[n] = (r[f"m_{n}"] or 0.0, s if s not in (None, 0.0) and not math.isnan(s) else 1.0)
    return out
