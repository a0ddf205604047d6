"""PCA fit, explained-variance curve and views.

The covariance matrix comes from one mean aggregate and one distributed pass
of per-batch cross-product sums (``filters.centered_moments``).  Only this ``d×d`` matrix reaches the driver,
where ``numpy.linalg.eigh`` gives components and variances.  Projection is a
plain linear expression per component, so scoring stays in codegen.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c
from .filters import centered_moments


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mean vector, sample covariance matrix) of the given columns: one mean
    aggregate for the shift, one pass of per-batch cross-product sums."""
    cols = list(columns)
    row = df.agg(*[F.avg(c(n)).alias(f"m{i}") for i, n in enumerate(cols)]).collect()[0]
    shift = [row[f"m{i}"] for i in range(len(cols))]
    n, mean, C = centered_moments(df, [c(n) for n in cols], shift)
    if n < 2:
        return mean, np.zeros((len(cols), len(cols)))
    return mean, C / (n - 1)


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending, clipped at 0) and unit eigenvectors (columns),
    each vector's sign fixed so its largest-magnitude loading is positive."""
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0.0, None), vecs[:, order]
    for j in range(vecs.shape[1]):
        i = int(np.argmax(np.abs(vecs[:, j])))
        if vecs[i, j] < 0:
            vecs[:, j] = -vecs[:, j]
    return vals, vecs


def fit_pca(df: DataFrame, columns: Sequence[str], k: int
            ) -> tuple[list[list[float]], list[float], list[float]]:
    """(components k×d, mean, explained variance ratios) fitted on ``df``."""
    mean, cov = covariance(df, columns)
    vals, vecs = eigen(cov)
    total = vals.sum()
    ratio = (vals / total if total > 0 else np.zeros_like(vals))[:k]
    return vecs[:, :k].T.tolist(), mean.tolist(), ratio.tolist()


def project(columns: Sequence[str], components, mean, names=None) -> list[Column]:
    """Centred projection ``(x − mean)·v`` per component, as column expressions."""
    out = []
    for k, comp in enumerate(components):
        acc = None
        for n, w, mu in zip(columns, comp, mean):
            term = (c(n) - F.lit(float(mu))) * F.lit(float(w))
            acc = term if acc is None else acc + term
        out.append(acc.alias(names[k] if names else f"PC{k + 1}"))
    return out


# Cuts and targets of the component report.
CUTS = (9, 12, 16)
TARGETS = (80, 90, 95, 99)


def explained_variance_curve(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per component: variance %, cumulative %; plus, per row, whether the
    component is one of the reported cuts and which targets it first reaches.

    Returns (component, pct, cum_pct, is_cut, reaches) with d rows; cuts above d
    are simply absent.
    """
    _, cov = covariance(df, columns)
    vals, _ = eigen(cov)
    total = vals.sum()
    pct = 100.0 * vals / total if total > 0 else np.zeros_like(vals)
    cum = np.cumsum(pct)
    rows = []
    reached = set()
    for i in range(len(vals)):
        hit = [t for t in TARGETS if t not in reached and cum[i] >= t - 1e-9]
        reached.update(hit)
        rows.append((i + 1, float(pct[i]), float(cum[i]), (i + 1) in CUTS,
                     ",".join(str(t) for t in hit) or None))
    return df.sparkSession.createDataFrame(
        rows, "component int, pct double, cum_pct double, is_cut boolean, reaches string")
