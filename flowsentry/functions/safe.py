"""Null/NaN/Inf-total scalar helpers, all plain Catalyst expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def c(name: str) -> Column:
    """Column reference that tolerates blanks and dots in names."""
    return F.col(f"`{name}`")


def is_finite(x: Column) -> Column:
    """True for finite values; false for +-Inf and NaN; NULL for NULL (which
    ``when``/``filter`` treat as false).  ``x − x`` is 0 exactly when x is
    finite and NaN otherwise: one compact expression, which keeps the fused
    feature projections under the JVM's 64 KB method limit for codegen."""
    return (x - x) == F.lit(0.0)


def finite_or(x: Column, fill) -> Column:
    """``x`` when finite, else ``fill`` (NULL, NaN and +-Inf all count as missing)."""
    return F.when(is_finite(x), x).otherwise(F.lit(fill))


def nonfinite_to_null(x: Column) -> Column:
    """+-Inf and NaN become NULL; NULL stays NULL."""
    return F.when(is_finite(x), x).otherwise(F.lit(None).cast("double"))


def safe_div(num: Column, den: Column) -> Column:
    """``num / (den + 1)`` with every missing or non-finite result mapped to 0.

    ``try_divide`` keeps ANSI mode on: a zero divisor (``den = -1``) yields
    NULL instead of raising, and NULL becomes 0 like the non-finite cases.
    """
    q = F.try_divide(num.cast("double"), den.cast("double") + F.lit(1.0))
    return finite_or(q, 0.0)


def flag(cond: Column) -> Column:
    """Boolean → 0/1 int where a missing comparison counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip_low(x: Column, low: float = 0.0) -> Column:
    """Lower clip that keeps a missing value missing (``greatest`` alone would not)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def values(batch, first: int, d: int) -> np.ndarray:
    """``d`` double columns of an Arrow batch as a matrix, missing values as 0."""
    X = np.empty((batch.num_rows, d))
    for i in range(d):
        X[:, i] = batch.column(first + i).to_numpy(zero_copy_only=False)
    X[np.isnan(X)] = 0.0
    return X
