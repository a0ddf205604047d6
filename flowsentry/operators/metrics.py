"""Thresholds and evaluation metrics as DataFrames.

Everything reduces a scored table with one ``groupBy`` on (truth, prediction)
(two keys of two values each: four partial-aggregate rows per task), so
evaluation costs one narrow scan whatever the table size.  Metric formulas run
on the four-cell confusion table as column expressions.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantile import percentiles


def score_percentile(scores: DataFrame, col: str, fractions: Sequence[float]) -> list[float]:
    """Linear-interpolated percentiles of a score column (train scores), exact at
    every size.  The scores are kept for its passes, so rows are scored once."""
    x = scores.select(F.col(col).alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    found = percentiles(x, {"x": F.col("x")}, [float(f) for f in fractions])["x"]
    x.unpersist()
    if found is None:
        raise ValueError(f"no {col} to take percentiles of")
    return found


def predict_by_threshold(score: Column, offset: float) -> Column:
    """M3: -1 (outlier) iff score < offset, else +1."""
    return F.when(score < F.lit(float(offset)), F.lit(-1)).otherwise(F.lit(1)).cast("int")


def confusion(scored: DataFrame, y: str, pred: str, labels: Sequence[int],
              by: Sequence[str] = ()) -> DataFrame:
    """Counts for every (truth, prediction) cell of ``labels``², zeros kept.

    One pass of conditional counts: the rows are scored once.
    """
    t, p = F.col(y), F.col(pred)
    agg = scored.groupBy(*by).agg(*[F.count_if((t == a) & (p == b)).alias(f"_n{i}_{j}")
                                    for i, a in enumerate(labels) for j, b in enumerate(labels)])
    return agg.select(*by, F.inline(F.array(*[
        F.struct(F.lit(a).cast("int").alias("y_true"), F.lit(b).cast("int").alias("y_pred"), F.col(f"_n{i}_{j}").alias("n"))
        for i, a in enumerate(labels) for j, b in enumerate(labels)])))


def per_class(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table."""
    tp = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    a = conf.groupBy(*by, F.col("y_true").alias("cls")).agg(
        tp.alias("tp"), F.sum("n").alias("support"))
    p = conf.groupBy(*by, F.col("y_pred").alias("cls")).agg(F.sum("n").alias("pred_n"))
    j = a.join(p, on=[*by, "cls"], how="full").na.fill(0, ["tp", "support", "pred_n"])
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when((F.col("precision") + F.col("recall")) > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return (j.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", f1).select(*by, "cls", "tp", "pred_n", "support",
                                          "precision", "recall", "f1"))


def macro_f1(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of per-class F1 (0 where undefined)."""
    pc = per_class(conf, by)
    return pc.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def report(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long-form classification report.

    Rows per group: one per class, then ``accuracy``, ``macro avg`` and
    ``weighted avg``; columns precision, recall, f1, support.
    """
    pc = per_class(conf, by)
    cls_rows = pc.select(*by, F.col("cls").cast("string").alias("row"),
                         "precision", "recall", "f1", F.col("support").cast("long"))
    tot = pc.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("n"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    n = F.col("n")
    acc = tot.select(*by, F.lit("accuracy").alias("row"),
                     F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     F.when(n > 0, F.col("tp") / n).otherwise(0.0).alias("f1"),
                     n.cast("long").alias("support"))
    mac = tot.select(*by, F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                     F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                     n.cast("long").alias("support"))
    wavg = tot.select(*by, F.lit("weighted avg").alias("row"),
                      F.when(n > 0, F.col("wp") / n).otherwise(0.0).alias("precision"),
                      F.when(n > 0, F.col("wr") / n).otherwise(0.0).alias("recall"),
                      F.when(n > 0, F.col("wf") / n).otherwise(0.0).alias("f1"),
                      n.cast("long").alias("support"))
    return cls_rows.unionByName(acc).unionByName(mac).unionByName(wavg)


def sweep(scored: DataFrame, score: str, y_det: str, train_scores: DataFrame,
          contaminations: Sequence[float]) -> DataFrame:
    """H2: one fit, many thresholds.

    Offsets are the train-score percentiles at each contamination.  All K confusion tables then come from a single pass of
    ``4·K`` conditional counts (no row replication); the one aggregate row is
    turned into the long confusion table with ``inline``.
    Returns contamination, offset, macro_f1.
    """
    offs = score_percentile(train_scores, score, contaminations)
    x, y = F.col(score), F.col(y_det)
    counts, cells = [], []
    for k, (cval, off) in enumerate(zip(contaminations, offs)):
        pred = F.when(x < F.lit(float(off)), -1).otherwise(1)
        for yt in (1, -1):
            for yp in (1, -1):
                name = f"n_{k}_{'p' if yt > 0 else 'm'}{'p' if yp > 0 else 'm'}"
                counts.append(F.count_if((y == yt) & (pred == yp)).alias(name))
                cells.append(F.struct(F.lit(float(cval)).alias("contamination"),
                                      F.lit(float(off)).alias("offset"),
                                      F.lit(yt).alias("y_true"), F.lit(yp).alias("y_pred"),
                                      F.col(name).cast("long").alias("n")))
    conf = scored.agg(*counts).select(F.inline(F.array(*cells)))
    return macro_f1(conf, by=["contamination", "offset"])


def sweeps(scored: DataFrame, contaminations: dict[str, Sequence[float]], y_det: str, train_scores: DataFrame) -> DataFrame:
    """H2 of several score columns, each with its contaminations: the percentiles of all from the
    same passes, the counts of all from one.  Returns score (its name), contamination, offset, macro_f1."""
    names = list(contaminations)
    kept = train_scores.select(*[F.col(n).alias(f"x{i}") for i, n in enumerate(names)]).persist(StorageLevel.MEMORY_AND_DISK)
    shares = sorted({float(v) for vs in contaminations.values() for v in vs})
    found = percentiles(kept, {n: F.col(f"x{i}") for i, n in enumerate(names)}, shares)
    kept.unpersist()
    for name in names:
        if found[name] is None:
            raise ValueError(f"no {name} to take percentiles of")
    cuts = [(s, float(v), found[name][shares.index(float(v))]) for s, name in enumerate(names) for v in contaminations[name]]

    def run(batches):
        n = np.zeros((len(cuts), 4), np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            inner, outer = y == 1, y == -1
            for k, (s, _, off) in enumerate(cuts):
                low = batch.column(1 + s).to_numpy(zero_copy_only=False) < off
                n[k] += (inner & ~low).sum(), (inner & low).sum(), (outer & ~low).sum(), (outer & low).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n.size, dtype=np.int32)), pa.array(n.ravel())], names=["cell", "n"])

    # four numbers per threshold reach the driver
    counts = {r["cell"]: r["n"] for r in scored.select(F.col(y_det).cast("double"), *[F.col(n).cast("double") for n in names])
              .mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    rows = [(names[s], v, float(off), yt, yp, counts.get(4 * k + j, 0)) for k, (s, v, off) in enumerate(cuts)
            for j, (yt, yp) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1)))]
    conf = scored.sparkSession.createDataFrame(rows, "score string, contamination double, offset double, y_true int, y_pred int, n long")
    return macro_f1(conf, by=["score", "contamination", "offset"])


def best_by(df: DataFrame, metric: str, order_col: str) -> DataFrame:
    """H4: the first maximum (ties → smallest ``order_col``)."""
    return df.orderBy(F.col(metric).desc(), F.col(order_col).asc()).limit(1)


def train_test_gap(f1_train: float, f1_test: float) -> dict:
    """A17."""
    return {"f1_train": f1_train, "f1_test": f1_test, "gap": f1_train - f1_test}
