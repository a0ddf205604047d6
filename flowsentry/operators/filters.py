"""Statistical column filters fitted on the training rows.

Each step alone is a single aggregate pass (partial aggregation per task, one row
per task shuffled), and ``fit_filters`` takes all three from one; decisions are
made on the driver from ``d`` or ``d²`` numbers, never from rows.

* A4 low variance: ``var_samp`` per column (missing → 0 first).
* A5 literal duplicates: a per-column fingerprint (min, max and ``bit_xor``
  of ``xxhash64(key, value)``) finds candidate pairs in one pass; only
  colliding pairs are verified with ``<=>`` in a second pass.
* A6 high correlation: one pass of per-batch cross-product sums (BLAS in
  ``mapInPandas``, added by a ``groupBy``) gives the ``d×d`` matrix; column j
  drops if any earlier column i has ``|ρ| > threshold`` (even when i drops).
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import c, is_finite

log = logging.getLogger(__name__)


def _filled(n: str, fill: float = 0.0) -> Column:
    """Missing / non-finite → ``fill``; -0.0 → 0.0 so equal values hash equal."""
    return F.when(is_finite(c(n)), c(n) + F.lit(0.0)).otherwise(F.lit(fill))


@dataclass
class FilterModel:
    input_columns: list[str]
    kept_columns: list[str]
    dropped_low_variance: list[str] = field(default_factory=list)
    dropped_duplicates: list[str] = field(default_factory=list)
    dropped_high_correlation: list[str] = field(default_factory=list)
    duplicate_of: dict[str, str] = field(default_factory=dict)

    def report_rows(self) -> list[tuple]:
        out = []
        for i, n in enumerate(self.input_columns):
            if n in self.dropped_low_variance:
                reason = "low_variance"
            elif n in self.dropped_duplicates:
                reason = "duplicate"
            elif n in self.dropped_high_correlation:
                reason = "high_correlation"
            else:
                reason = None
            out.append((i, n, reason is None, reason))
        return out


def low_variance(df: DataFrame, columns: Sequence[str], threshold: float = 0.0) -> list[str]:
    """A4: columns whose sample variance (missing → 0) ≤ threshold; a NULL
    variance (one row) keeps the column."""
    row = df.agg(*[F.var_samp(_filled(n)).alias(f"v{i}") for i, n in enumerate(columns)]
                 ).collect()[0]
    out = []
    for i, n in enumerate(columns):
        v = row[f"v{i}"]
        if v is not None and not math.isnan(v) and v <= threshold:
            out.append(n)
    return out


def duplicate_columns(df: DataFrame, columns: Sequence[str], key_cols: Sequence[str]
                      ) -> dict[str, str]:
    """A5: {dropped column: earlier identical column}."""
    if len(columns) < 2:
        return {}
    key = [c(k) for k in key_cols]
    exprs = []
    for i, n in enumerate(columns):
        x = _filled(n)
        exprs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                  F.bit_xor(F.xxhash64(*key, x)).alias(f"h{i}")]
    row = df.agg(*exprs).collect()[0]
    fp: dict[tuple, list[int]] = {}
    for i in range(len(columns)):
        k = (row[f"mn{i}"], row[f"mx{i}"], row[f"h{i}"])
        fp.setdefault(k, []).append(i)
    pairs = []
    for idx in fp.values():
        for a in range(len(idx)):
            for b in range(a + 1, len(idx)):
                pairs.append((idx[a], idx[b]))
    if not pairs:
        return {}
    checks = [F.bool_and(_filled(columns[a]).eqNullSafe(_filled(columns[b]))).alias(f"e{k}")
              for k, (a, b) in enumerate(pairs)]
    ver = df.agg(*checks).collect()[0]
    dup: dict[str, str] = {}
    for k, (a, b) in enumerate(pairs):
        nb, na = columns[b], columns[a]
        if ver[f"e{k}"] is not False and nb not in dup:
            dup[nb] = dup.get(na, na)
    return dup


def centered_moments(df: DataFrame, exprs: Sequence[Column], shift: Sequence[float]):
    """(n, mean vector, C = Σ (x−x̄)(x−x̄)ᵀ) of the given column expressions, in
    one pass.  Each task adds up its row count, Σ(x−a) and Σ(x−a)(x−a)ᵀ (BLAS) over
    all its Arrow batches and hands on one vector with the upper triangle, whatever
    its rows; ``posexplode`` + ``groupBy(pos).sum`` adds the tasks' vectors.  The
    shift ``a`` (an approximate mean) keeps the sums well conditioned."""
    import numpy as np
    import pandas as pd
    d = len(exprs)
    a = np.asarray([0.0 if v is None or not math.isfinite(v) else float(v) for v in shift])
    iu = np.triu_indices(d)
    names = [f"_x{i}" for i in range(d)]
    sub = df.select(*[e.alias(nm) for e, nm in zip(exprs, names)])

    def run(batches):
        n, s1, S2 = 0.0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            X = pdf[names].to_numpy(dtype=float, na_value=0.0) - a
            n += len(X)
            s1 += X.sum(axis=0)
            S2 += X.T @ X
        yield pd.DataFrame({"v": [np.concatenate([[n], s1, S2[iu]])]})

    parts = sub.mapInPandas(run, "v array<double>")
    rows = (parts.select(F.posexplode("v").alias("pos", "x")).groupBy("pos")
            .agg(F.sum("x").alias("s")).collect())
    tot = np.zeros(1 + d + len(iu[0]))
    for r in rows:
        tot[r["pos"]] = r["s"]
    n = tot[0]
    if n == 0:
        return 0, a, np.zeros((d, d))
    s1 = tot[1:1 + d]
    S2 = np.zeros((d, d))
    S2[iu] = tot[1 + d:]
    S2 = S2 + np.triu(S2, 1).T
    C = S2 - np.outer(s1, s1) / n
    return int(n), a + s1 / n, C


def correlation_matrix(df: DataFrame, columns: Sequence[str], shift=None):
    """Pearson matrix (numpy) of the filled values; NaN where a variance is 0."""
    import numpy as np
    if shift is None:
        row = df.agg(*[F.avg(_filled(n)).alias(f"m{i}") for i, n in enumerate(columns)]
                     ).collect()[0]
        shift = [row[f"m{i}"] for i in range(len(columns))]
    _, _, C = centered_moments(df, [_filled(n) for n in columns], shift)
    return _correlations(C)


def _correlations(C):
    import numpy as np
    sd = np.sqrt(np.clip(np.diag(C), 0.0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        R = C / np.outer(sd, sd)
    R[np.outer(sd, sd) == 0] = np.nan
    return R


def high_correlation(df: DataFrame, columns: Sequence[str], threshold: float = 0.95,
                     shift=None) -> list[str]:
    """Column j drops if any earlier column has |ρ| > threshold (NaN never drops)."""
    if len(columns) < 2:
        return []
    return _correlated(correlation_matrix(df, columns, shift), columns, threshold)


def _correlated(m, columns: Sequence[str], threshold: float) -> list[str]:
    out = []
    for j in range(len(columns)):
        for i in range(j):
            r = m[i, j]
            if not math.isnan(r) and abs(r) > threshold:
                out.append(columns[j])
                break
    return out


def column_profile(df: DataFrame, columns: Sequence[str], key_cols: Sequence[str]) -> dict:
    """One pass: per column the sample variance and fingerprint of the filled values
    (A4, A5) and the mean of the finite values (A8), the columns' sums of products around their
    means ("moments", A6) and for each column the first one of equal values ("same", A5).

    Each task adds up its Arrow batches with numpy and hands on one row per column and the upper
    triangle of the products: five aggregates per column in one fused stage are more code than the
    JVM compiles.  Values are centred on the batch's first one, so a constant column has a variance
    of exactly 0."""
    import numpy as np
    import pyarrow as pa
    d = len(columns)
    upper = np.triu_indices(d)
    sub = df.select(F.xxhash64(F.lit(0), *[c(k) for k in key_cols]).alias("_k"),
                    *[c(n).cast("double").alias(f"_x{i}") for i, n in enumerate(columns)])

    def run(batches):
        seen = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            X, off = np.empty((d, len(key))), np.empty((d, len(key)))
            part = [_column_sums(batch.column(1 + i).to_numpy(zero_copy_only=False), key, X[i], off[i]) for i in range(d)]
            with np.errstate(over="ignore", invalid="ignore"):
                C = off @ off.T
            same = _same_columns(X, np.zeros(d, np.int64) if seen is None else seen[2])
            seen = (part, C, same) if seen is None else (*_merged_products(seen[0], seen[1], part, C), same)
        if seen is not None:
            at, *cols = zip(*[(i, *s) for i, s in enumerate(seen[0])])
            kinds = (pa.int64(), *(pa.float64(),) * 3, pa.int64(), *(pa.float64(),) * 2, pa.int64())
            more = [None] * d
            more[0] = seen[1][upper].tobytes() + seen[2].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(x, k) for x, k in zip(cols, kinds)], pa.array(more, pa.binary())],
                                             names=["i", "n", "mean", "m2", "total", "finite", "mn", "mx", "h", "more"])

    rows = sub.mapInArrow(run, "i int, n long, mean double, m2 double, total double, finite long, "
                               "mn double, mx double, h long, more binary").collect()
    tasks, C, same = [rows[s:s + d] for s in range(0, len(rows), d)], np.zeros((d, d)), np.zeros(d, np.int64)
    sums: list[tuple] = []
    for task in tasks:
        mine = [tuple(r)[1:-1] for r in task]
        held = np.frombuffer(task[0]["more"], float, len(upper[0]))
        products = np.zeros((d, d))
        products[upper] = held
        products += np.triu(products, 1).T
        same = _same_in_both(same, np.frombuffer(task[0]["more"], np.int64, d, held.nbytes))
        sums, C = _merged_products(sums, C, mine, products) if sums else (mine, products)
    out = {"_n": sums[0][0] if sums else 0, "moments": C, "same": same.tolist()}
    for i in range(d):
        n, _, m2, total, finite, mn, mx, h = sums[i] if sums else (0, None, None, None, 0, None, None, None)
        out |= {f"v{i}": m2 / (n - 1) if n > 1 else None, f"mn{i}": mn, f"mx{i}": mx, f"h{i}": h,
                f"m{i}": total / finite if finite else None}
    return out


def _column_sums(x, key, filled, off) -> tuple:
    """(n, mean, Σ(x−mean)² of the filled values, Σ and number of finite ones, min, max, fingerprint); the
    filled values and their distances from the mean are written into ``filled`` and ``off``."""
    import numpy as np
    finite = np.isfinite(x)
    filled[:] = np.where(finite, x, 0.0) + 0.0
    x = filled
    with np.errstate(over="ignore", invalid="ignore"):
        np.subtract(x, x[0], out=off)
        mean = off.mean()
        off -= mean
        h = (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ key
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        return (len(x), float(x[0] + mean), float(off @ off), float(x.sum()), int(finite.sum()),
                float(x.min()), float(x.max()), int(np.bitwise_xor.reduce(h).view(np.int64)))


def _merged_sums(a: tuple, b: tuple) -> tuple:
    n, apart = a[0] + b[0], b[1] - a[1]
    return (n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart * apart * (a[0] * b[0] / n), a[3] + b[3], a[4] + b[4],
            min(a[5], b[5]), max(a[6], b[6]), a[7] ^ b[7])


def _merged_products(a: list[tuple], C, b: list[tuple], D):
    """Sums of two parts, and their sums of products around the common means."""
    import numpy as np
    n, m = a[0][0], b[0][0]
    with np.errstate(over="ignore", invalid="ignore"):
        apart = np.array([y[1] - x[1] for x, y in zip(a, b)])
        return [_merged_sums(x, y) for x, y in zip(a, b)], C + D + np.outer(apart, apart) * (n * m / (n + m))


def _same_columns(X, same):
    """For each row of X the first one with equal values, among those that ``same`` says were equal so far."""
    import numpy as np
    out = np.arange(len(X))
    for i in range(1, len(X)):
        if same[i] == i:
            continue
        for j in range(same[i], i):
            if out[j] == j and same[j] == same[i] and X[i, 0] == X[j, 0] and np.array_equal(X[i], X[j]):
                out[i] = j
                break
    return out


def _same_in_both(a, b):
    import numpy as np
    first: dict[tuple, int] = {}
    return np.array([first.setdefault(pair, i) for i, pair in enumerate(zip(a.tolist(), b.tolist()))], np.int64)


def fit_filters(df: DataFrame, columns: Sequence[str], key_cols: Sequence[str],
                variance_threshold: float = 0.0, correlation_threshold: float = 0.95,
                profile: dict | None = None) -> FilterModel:
    """A4 → A5 → A6 on the training rows, column order kept.

    One pass, that of the profile, gives what all three steps need."""
    columns = list(columns)
    prof = profile or column_profile(df, columns, key_cols)
    idx = {n: i for i, n in enumerate(columns)}
    lv = []
    for n in columns:
        v = prof[f"v{idx[n]}"]
        if v is not None and not math.isnan(v) and v <= variance_threshold:
            lv.append(n)
    step1 = [n for n in columns if n not in lv]
    first: dict[int, str] = {}
    dup: dict[str, str] = {}
    for n in step1:
        if first.setdefault(prof["same"][idx[n]], n) != n:
            dup[n] = first[prof["same"][idx[n]]]
    step2 = [n for n in step1 if n not in dup]
    # fewer than two rows: every correlation is undefined (NaN), nothing drops
    at = [idx[n] for n in step2]
    hc = _correlated(_correlations(prof["moments"][at][:, at]), step2, correlation_threshold) if prof["_n"] >= 2 else []
    kept = [n for n in step2 if n not in hc]
    log.info("filters: %d in, %d low-variance, %d duplicate, %d correlated, %d kept",
             len(columns), len(lv), len(dup), len(hc), len(kept))
    return FilterModel(list(columns), kept, lv, list(dup), hc, dup)
