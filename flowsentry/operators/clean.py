"""Row cleaning, projections and label handling.

All of these are narrow transformations (no shuffle): single ``select`` or
``filter`` steps that Catalyst fuses and pushes toward the scan.
"""

from __future__ import annotations

import logging
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.safe import c, is_finite, nonfinite_to_null

log = logging.getLogger(__name__)

LABEL = "Label"


def strip_names(df: DataFrame) -> DataFrame:
    """Blanks around column names removed."""
    return df.toDF(*[n.strip() for n in df.columns])


def _float_cols(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields
            if f.dataType.typeName() in ("double", "float")}


def nonfinite_to_missing(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """+-Inf and NaN → NULL in floating columns, rows kept."""
    target = _float_cols(df) if columns is None else set(columns) & _float_cols(df)
    return df.select(*[nonfinite_to_null(c(n)).alias(n) if n in target else c(n)
                       for n in df.columns])


def drop_invalid(df: DataFrame, observe: bool = False
                 ) -> DataFrame | tuple[DataFrame, Observation]:
    """Non-finite → missing, then drop rows with any missing value.

    With ``observe=True`` the removed count is gathered by an ``Observation``
    on the same job that consumes the result (no extra ``count()`` pass):
    ``obs.get['removed']`` after the first action.
    """
    cleaned = nonfinite_to_missing(df)
    if not observe:
        return cleaned.na.drop(how="any")
    obs = Observation("drop_invalid")
    ok = F.lit(True)
    for n in cleaned.columns:
        ok = ok & c(n).isNotNull()
    tagged = cleaned.observe(obs, F.count_if(~ok).alias("removed"),
                             F.count(F.lit(1)).alias("rows_in"))
    return tagged.filter(ok), obs


def drop_empty(df: DataFrame) -> DataFrame:
    """Drop rows where every value is missing (NaN counts as missing)."""
    cleaned = nonfinite_to_missing(df)
    return cleaned.na.drop(how="all")


def trim_by_feature(df: DataFrame, feature: str, max_value: float | None, observe: bool = False
                    ) -> DataFrame | tuple[DataFrame, Observation | None]:
    """Keep ``feature <= max_value``; no-op for None or an absent column.

    Missing and NaN values fail the comparison and drop, as with pandas.  ``observe`` as in
    ``drop_invalid`` (no observation when nothing is trimmed).
    """
    if max_value is not None and feature not in df.columns:
        log.warning("trim skipped: %s not in table", feature)
    if max_value is None or feature not in df.columns:
        return (df, None) if observe else df
    x = c(feature)
    ok = F.coalesce(x.isNotNull() & ~F.isnan(x) & (x <= F.lit(float(max_value))), F.lit(False))
    if not observe:
        return df.filter(ok)
    obs = Observation("trim_by_feature")
    tagged = df.observe(obs, F.count_if(~ok).alias("removed"), F.count(F.lit(1)).alias("rows_in"))
    return tagged.filter(ok), obs


def whitelist(df: DataFrame, columns: Sequence[str], label: str = LABEL,
              keep: Sequence[str] = ()) -> DataFrame:
    """P5: listed columns, in the listed order, plus the label."""
    missing = [n for n in columns if n not in df.columns]
    if missing:
        avail = sorted(n for n in df.columns if n != label)
        raise ValueError(f"whitelist columns not found: {missing}. Available: {avail}")
    extra = [k for k in keep if k in df.columns and k not in columns]
    tail = [label] if label in df.columns else []
    return df.select(*[c(n) for n in [*extra, *columns, *tail]])


def feature_names(df: DataFrame, label: str = LABEL, exclude: Sequence[str] = ()) -> list[str]:
    """Every numeric column but the label and the listed meta columns."""
    return [f.name for f in df.schema.fields
            if f.name != label and f.name not in exclude and isinstance(f.dataType, NumericType)]


def align(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Fitted columns in order; absent ones become NULL (with a warning)."""
    have = set(df.columns)
    absent = [n for n in columns if n not in have]
    if absent:
        log.warning("align: %d fitted column(s) absent, filled as missing: %s",
                    len(absent), absent[:5])
    cols: list[Column] = [c(k) for k in keep if k in have]
    cols += [c(n) if n in have else F.lit(None).cast("double").alias(n) for n in columns]
    return df.select(*cols)


def class_filter(df: DataFrame, cls: int, label: str = LABEL) -> DataFrame:
    """P8."""
    return df.filter(c(label) == F.lit(cls))


def detector_label(y: Column) -> Column:
    """0 → +1 (inlier), anything else → -1."""
    return F.when(y == 0, F.lit(1)).otherwise(F.lit(-1)).cast("int")


def plot_label(y: Column, detector_coding: bool) -> Column:
    """P10: 1 = attack.  The coding is explicit rather than guessed from the data."""
    if detector_coding:
        return F.when(y == -1, 1).otherwise(0).cast("int")
    return F.when(y > 0, 1).otherwise(0).cast("int")


def normalise_label(df: DataFrame, label: str | None = None, normal_text: str = "BENIGN"
                    ) -> DataFrame:
    """The label (default: last column) → 0 normal / 1 attack."""
    label = label or df.columns[-1]
    dtype = df.schema[label].dataType
    y = c(label)
    if isinstance(dtype, NumericType):
        out = F.when(y == 0, 0).otherwise(1)
    else:
        out = F.when(y.cast("string") == F.lit(normal_text), 0).otherwise(1)
    out = F.when(y.isNull(), F.lit(None)).otherwise(out).cast("int")
    return df.select(*[out.alias(LABEL) if n == label else c(n) for n in df.columns])


def viz_prepare(df: DataFrame, columns: Sequence[str], fill: dict[str, float],
                keep: Sequence[str] = (), label: str | None = None,
                per_class: int | None = None, key_cols: Sequence[str] = (),
                seed: int = 42) -> DataFrame:
    """Normalised label, aligned columns, non-finite → per-column fill value,
    clipped at 0; with ``per_class``, at most that many hash-chosen rows per
    class (``splits.sample_n``, keyed by ``key_cols``)."""
    d = normalise_label(df, label)
    if per_class is not None:
        from .splits import sample_n
        d = sample_n(d, per_class, key_cols, purpose="viz", seed=seed, group_cols=[LABEL])
    d = align(d, columns, keep=[*keep, LABEL])
    out = []
    for n in d.columns:
        if n in columns:
            x = c(n)
            filled = F.when(is_finite(x), x).otherwise(F.lit(fill.get(n)).cast("double"))
            out.append(F.when(filled.isNotNull(), F.greatest(filled, F.lit(0.0))).alias(n))
        else:
            out.append(c(n))
    return d.select(*out)
