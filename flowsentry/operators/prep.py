"""Fitted transforms (F1–F3, F7) and the ``PrepModel`` that carries them.

``PrepModel`` is the Spark counterpart of the reference's split bundle: it
records the input columns, the filter decisions, the training means and the
optional PCA parameters, all fitted on the training split only.
``transform`` is a single projection (align → non-finite to NULL → impute and
clamp → project), so scoring any table is a narrow, codegen-only step with
the fitted numbers inlined as literals.  ``Scaler`` (F2, F3) is fitted on the
prepared training rows and applied the same way.
"""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c, is_finite
from . import stats
from .filters import FilterModel, column_profile, fit_filters

log = logging.getLogger(__name__)


def impute_clamp(x: Column, mean: float) -> Column:
    """missing/non-finite → train mean, then negatives → 0."""
    filled = F.when(is_finite(x), x).otherwise(F.lit(float(mean)))
    return F.greatest(filled, F.lit(0.0))


def robust_scale(x: Column, q1: float, med: float, q3: float) -> Column:
    """(x − median) / IQR, IQR 0 → divide by 1."""
    iqr = (q3 - q1) if q3 is not None and q1 is not None else 0.0
    return (x - F.lit(float(med or 0.0))) / F.lit(float(iqr) if iqr != 0 else 1.0)


def standard_scale(x: Column, mean: float, std: float) -> Column:
    """(x − mean) / std (std 0 → 1)."""
    return (x - F.lit(float(mean))) / F.lit(float(std) if std else 1.0)


@dataclass
class PrepModel:
    input_columns: list[str]
    output_columns: list[str]
    means: dict[str, float]
    filters: dict | None = None
    pca_components: list[list[float]] | None = None  # k × d, rows = components
    pca_mean: list[float] | None = None
    pca_explained: list[float] | None = None

    # ------------------------------------------------------------ fitting
    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str], key_cols: Sequence[str],
            apply_filters: bool = True, variance_threshold: float = 0.0,
            correlation_threshold: float = 0.95,
            pca_components: int | None = None) -> "PrepModel":
        columns = list(columns)
        cleaned = train.select(*[c(k) for k in key_cols],
                               *[F.when(is_finite(c(n)), c(n)).alias(n) for n in columns])
        fm: FilterModel | None = None
        kept = columns
        # one pass gives the filter statistics and the means of every column
        prof = column_profile(cleaned, columns, key_cols)
        if apply_filters:
            fm = fit_filters(cleaned, columns, key_cols, variance_threshold,
                             correlation_threshold, profile=prof)
            kept = fm.kept_columns
        means = {n: prof[f"m{columns.index(n)}"] for n in kept}
        empty = [n for n in kept if means[n] is None]
        if empty:
            log.warning("imputer: all-missing column(s) dropped: %s", empty)
            kept = [n for n in kept if means[n] is not None]
        model = cls(list(columns), list(kept), {n: means[n] for n in kept},
                    asdict(fm) if fm else None)
        if pca_components:
            from .pca import fit_pca
            if pca_components >= len(kept):
                log.warning("pca_reduce=%d >= n_features=%d, PCA skipped",
                            pca_components, len(kept))
            else:
                base = model.transform(train, keep=[])
                comp, mean, expl = fit_pca(base, kept, pca_components)
                model.pca_components, model.pca_mean, model.pca_explained = comp, mean, expl
                model.output_columns = [f"PC{i + 1}" for i in range(pca_components)]
        return model

    # ------------------------------------------------------------ applying
    def feature_exprs(self) -> list[Column]:
        exprs = [impute_clamp(c(n), self.means[n]).alias(n)
                 for n in self.output_source_columns()]
        if self.pca_components:
            proj = []
            for k, comp in enumerate(self.pca_components):
                acc = None
                for w, mu, e in zip(comp, self.pca_mean, exprs):
                    term = (e - F.lit(float(mu))) * F.lit(float(w))
                    acc = term if acc is None else acc + term
                proj.append(acc.alias(f"PC{k + 1}"))
            return proj
        return exprs

    def transform(self, df: DataFrame, keep: Sequence[str] = ("flow_id", "Label")) -> DataFrame:
        """P7 + F1 (+F4): one projection over any table of the input schema."""
        have = set(df.columns)
        absent = [n for n in self.output_source_columns() if n not in have]
        if absent:
            log.warning("transform: %d fitted column(s) absent, imputed: %s",
                        len(absent), absent[:5])
        aligned = df.select(*[c(k) for k in keep if k in have],
                            *[c(n) if n in have else F.lit(None).cast("double").alias(n)
                              for n in self.output_source_columns()])
        return aligned.select(*[c(k) for k in keep if k in have], *self.feature_exprs())

    def output_source_columns(self) -> list[str]:
        return [n for n in self.input_columns if n in self.means]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, s: str) -> "PrepModel":
        return cls(**json.loads(s))


@dataclass
class Scaler:
    """F2 / F3 fitted on training rows: per column (q1, median, q3) or (mean, std)."""
    kind: str
    params: dict[str, list[float]]

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str], kind: str = "robust") -> "Scaler":
        if kind == "robust":
            qs = stats.quartiles(train, columns)
            return cls(kind, {n: list(qs[n]) for n in columns})
        ms = stats.mean_std(train, columns)
        return cls(kind, {n: list(ms[n]) for n in columns})

    def expr(self, n: str) -> Column:
        if self.kind == "robust":
            q1, med, q3 = self.params[n]
            return robust_scale(c(n), q1, med, q3)
        m, s = self.params[n]
        return standard_scale(c(n), m, s)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.expr(n).alias(n) if n in self.params else c(n)
                           for n in df.columns])
