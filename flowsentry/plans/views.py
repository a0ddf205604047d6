"""PCA views behind the reference's figures (F5, F6): tables, not pictures."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c
from ..operators import splits
from ..operators.clean import drop_empty
from ..operators.pca import fit_pca, project
from ..operators.prep import PrepModel, Scaler


log = logging.getLogger(__name__)


@dataclass
class PCAView:
    points: DataFrame           # key, group columns, pc1..pck
    explained: list[float]


def pca_view(rows: DataFrame, features: Sequence[str], key: str, label: str = "Label",
             n_components: int = 2, per_class: int = 10000, seed: int = 42) -> PCAView:
    """≤ ``per_class`` rows per class (X12), standard-scaled on that sample (F3),
    projected on its first 2 or 3 principal components."""
    if n_components not in (2, 3):
        raise ValueError("n_components must be 2 or 3")
    sample = splits.sample_n(rows.select(c(key), c(label), *[c(f) for f in features]),
                             per_class, [key], purpose="view", seed=seed,
                             group_cols=[label]).cache()
    scaled = Scaler.fit(sample, features, "standard").transform(sample)
    comps, mean, ratio = fit_pca(scaled, features, n_components)
    pts = scaled.select(c(key), c(label).alias("class"),
                        *project(features, comps, mean,
                                 [f"pc{i + 1}" for i in range(n_components)]))
    return PCAView(pts, ratio)


def cross_domain_view(train_domain: DataFrame, target: DataFrame, prep: PrepModel, key: str,
                      label: str = "Label", per_set: int = 5000, seed: int = 42
                      ) -> tuple[PCAView, DataFrame] | None:
    """four sets (train-domain normal/attack, target normal/attack), ≤ ``per_set``
    each, the target through the fitted prep, joint standard scaling and PCA.

    Also returns each set's centroid distance (in the 2-D view) to the
    train-domain normal centroid, a one-number drift summary per set.

    A target without labels, or without a row that has a value (P3), has no view: None, with a
    warning.
    """
    if label not in target.columns:
        log.warning("cross-domain view skipped: the target has no %s column", label)
        return None
    target = drop_empty(target)
    if target.isEmpty():
        log.warning("cross-domain view skipped: the target has no rows")
        return None
    feats = prep.output_columns
    a = prep.transform(train_domain, keep=[key, label]).withColumn("domain", F.lit("train"))
    b = prep.transform(target, keep=[key, label]).withColumn("domain", F.lit("target"))
    both = a.unionByName(b)
    sample = splits.sample_n(both, per_set, [key], purpose="cross-view", seed=seed,
                             group_cols=["domain", label]).cache()
    scaled = Scaler.fit(sample, feats, "standard").transform(sample)
    comps, mean, ratio = fit_pca(scaled, feats, 2)
    pts = scaled.select(c(key), "domain", c(label).alias("class"),
                        *project(feats, comps, mean, ["pc1", "pc2"]))
    cent = pts.groupBy("domain", "class").agg(F.avg("pc1").alias("c1"), F.avg("pc2").alias("c2"),
                                              F.count(F.lit(1)).alias("n"))
    # one row per (domain, class): at most four rows, compared on the driver
    cents = cent.collect()
    ref = [r for r in cents if r["domain"] == "train" and r["class"] == 0]
    r1, r2 = (ref[0]["c1"], ref[0]["c2"]) if ref else (None, None)
    drift_rows = [(r["domain"], int(r["class"]), int(r["n"]),
                   None if r1 is None else float(((r["c1"] - r1) ** 2 +
                                                  (r["c2"] - r2) ** 2) ** 0.5))
                  for r in cents]
    drift = pts.sparkSession.createDataFrame(
        drift_rows, "domain string, class int, n long, centroid_dist double")
    return PCAView(pts, ratio), drift
