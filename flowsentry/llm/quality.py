"""Quality classifier: regularised quadratic discriminant over document statistics.

``statistics`` turns every whole text into a fixed vector of transformed statistics (logs of
counts, square roots of shares).  Each class gets a mean and a covariance shrunk towards the
pooled covariance and towards a scaled identity; a document's score is the difference of the
two Gaussian log densities, from Mahalanobis distances through Cholesky factors that are
computed once per fit and broadcast (2 x d x d numbers), mapped to 0..1 by a logistic
calibration fitted on the same training rows.

Defined cases: a null text counts as empty; an empty text has its own vector (all counts 0)
and so a score; without training rows of both classes every score is the share of label 1
(0.5 without any label); several labels of one document count by their mean (0.5 and more is
1); documents without a label or with a null id teach nothing; repeated documents are scored
each; a null quality is no label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_WORDS, Shared, WordHasher, free_worker_cache, fresh_name, low_hashes, mix, slices, utf8

BLOCK_BYTES = 1 << 20
FEATURES = ("chars", "words", "mean_word", "long_word", "upper", "digit", "punct", "symbol",
            "bang", "newline", "non_ascii", "distinct_words", "repeats", "pair_repeats",
            "mean_line", "distinct_lines", "line_end", "short_words", "capital_words", "entropy")


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_KINDS = {"upper": _class(bytes(range(65, 91))), "lower": _class(bytes(range(97, 123))),
          "digit": _class(b"0123456789"), "punct": _class(b".,;:'\"()-"),
          "symbol": _class(b"|<>{}[]#*=_~^\\/@$%&+`"), "bang": _class(b"!?"),
          "newline": _class(b"\n"), "lead": _class(bytes(range(0xC0, 256))),
          "tail": _class(bytes(range(0x80, 0xC0)))}
_KIND_OF = np.zeros(256, np.int64)
for _i, _name in enumerate(_KINDS):
    _KIND_OF[_KINDS[_name] == 1] = _i + 1
_LINES = np.ones(256, np.uint8)
_LINES[:] = np.arange(256)
_LINES[0] = 0xFF
_LINES[10] = 0


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each row."""
    if len(h) == 0:
        return np.zeros(n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=n).astype(float)


def _block(data: np.ndarray, offsets: np.ndarray, words: WordHasher, lines: WordHasher) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row_of * (len(_KINDS) + 1) + _KIND_OF[data],
                        minlength=n * (len(_KINDS) + 1)).reshape(n, -1).astype(float)
    k = {name: kinds[:, i + 1] for i, name in enumerate(_KINDS)}
    chars = np.diff(offsets) - k["tail"]
    some = np.maximum(chars, 1)
    letters = np.maximum(k["upper"] + k["lower"] + k["lead"], 1)
    h, start, end, row = words.words(data, offsets)
    length = end - start
    count = np.bincount(row, minlength=n).astype(float)
    per = np.maximum(count, 1)
    word_bytes = np.bincount(row, weights=length, minlength=n)
    same = (row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
    repeats = np.bincount(row[1:][same & (h[1:] == h[:-1])], minlength=n)
    pair = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[same] if len(h) else h
    pair_row = row[1:][same] if len(row) else row
    pairs = np.bincount(pair_row, minlength=n).astype(float)
    lh, ls, le, lrow = lines.words(data, offsets)
    line_count = np.maximum(np.bincount(lrow, minlength=n).astype(float), 1)
    ends = np.isin(data[le - 1], np.frombuffer(b".!?\"", np.uint8)) if len(le) else np.zeros(0, bool)
    capital = (_KINDS["upper"][data[start]] == 1) | (data[start] == 0xC3)
    # byte entropy of each row from its 256-bin histogram
    hist = np.bincount(row_of * 256 + data, minlength=n * 256).reshape(n, 256) / \
        np.maximum(np.diff(offsets), 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(hist > 0, hist * np.log2(hist), 0).sum(axis=1)
    root = lambda x, of: np.sqrt(x / of)
    values = (
        np.log1p(chars), np.log1p(count), np.log1p(word_bytes / per),
        root(np.bincount(row[length > 15], minlength=n), per),
        root(k["upper"], letters), root(k["digit"], some), root(k["punct"], some),
        root(k["symbol"], some), root(k["bang"], some), root(k["newline"], some),
        root(k["lead"], some),
        np.log1p(_distinct(h, row, n)) / np.log1p(per),
        root(repeats, per), root(pairs - _distinct(pair, pair_row, n), np.maximum(pairs, 1)),
        np.log1p(np.bincount(lrow, weights=le - ls, minlength=n) / line_count),
        _distinct(lh, lrow, n) / line_count,
        root(np.bincount(lrow[ends], minlength=n), line_count),
        root(np.bincount(row[length <= 3], minlength=n), per),
        root(np.bincount(row[capital], minlength=n), per),
        entropy)
    for i, v in enumerate(values):
        out[:, i] = v
    return out


def statistics(col: pa.Array, words: WordHasher | None = None, lines: WordHasher | None = None) -> np.ndarray:
    """Feature matrix of a string column (memory: one block of texts at a time)."""
    words, lines = words or WordHasher(SPACE_WORDS), lines or WordHasher(_LINES)
    data, offsets = utf8(col)
    parts = [_block(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], words, lines)
             for i, j in slices(offsets, BLOCK_BYTES)]
    return np.vstack(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class QualityModel:
    """Standardisation, class means, Cholesky factors and calibration."""
    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray] | None
    inverse_factors: tuple[np.ndarray, np.ndarray] | None  # inverses of the Cholesky factors
    log_dets: tuple[float, float]
    slope: float
    offset: float
    clip: float = 6.0

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 minus class 0, per feature count."""
        z = np.clip((x - self.centre) / self.scale, -self.clip, self.clip)
        out = np.zeros(len(z))
        for sign, mean, inv, log_det in zip((-1, 1), self.means, self.inverse_factors, self.log_dets):
            d = (z - mean) @ inv.T
            out += sign * -0.5 * (np.einsum("ij,ij->i", d, d) + log_det)
        return out / z.shape[1]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), 1 / (1 + np.exp(-self.offset)))
        t = np.clip(self.slope * self.log_ratio(x) + self.offset, -700, 700)
        return 1 / (1 + np.exp(-t))


def fit(x: np.ndarray, y: np.ndarray, *, to_pooled: float = 0.6, to_identity: float = 0.01) -> QualityModel:
    """Fit on a feature matrix and 0/1 labels."""
    d = len(FEATURES)
    ones, n = int(y.sum()), len(y)
    share = (ones + 0.5) / (n + 1)
    if min(ones, n - ones) < 2:
        return QualityModel(np.zeros(d), np.ones(d), None, None, (0, 0), 0.0, float(np.log(share / (1 - share))))
    centre = np.median(x, axis=0)
    scale = np.maximum(x.std(axis=0), 1e-3)
    model = QualityModel(centre, scale, None, None, (0, 0), 0.0, 0.0)
    z = np.clip((x - centre) / scale, -model.clip, model.clip)
    parts = [z[y == c] for c in (0, 1)]
    covs = [np.cov(p, rowvar=False) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covs)) / n
    factors, dets = [], []
    for cov in covs:
        cov = (1 - to_pooled) * cov + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * np.eye(d) * max(np.trace(cov) / d, 1e-6)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.solve(low, np.eye(d)))
        dets.append(float(2 * np.log(np.diag(low)).sum()))
    model.means = tuple(p.mean(axis=0) for p in parts)
    model.inverse_factors, model.log_dets = tuple(factors), tuple(dets)
    ratio = model.log_ratio(x)
    a, b = 0.0, float(np.log(share / (1 - share)))
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (n - ones + 2))  # Platt's smoothed targets
    for _ in range(100):  # Newton steps of the two-parameter logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * ratio + b, -50, 50)))
        w, g = p * (1 - p) + 1e-9, p - target
        grad = np.array([(g * ratio).sum(), g.sum()])
        hess = np.array([[(w * ratio * ratio).sum() + 1e-6, (w * ratio).sum()],
                         [(w * ratio).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(a), float(b)
    return model


def with_statistics(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """All columns of ``docs`` plus the feature vector ``out`` (array of doubles)."""
    plain = fresh_name(docs, "_text")
    staged = docs.withColumn(plain, F.col(text_col).cast("string"))
    at = len(docs.columns)
    schema = T.StructType(docs.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        free_worker_cache()
        words, lines = WordHasher(SPACE_WORDS), WordHasher(_LINES)
        for batch in batches:
            x = statistics(batch.column(at), words, lines)
            flat = pa.array(x.ravel(), pa.float64())
            edges = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(at)] + [pa.ListArray.from_arrays(edges, flat)],
                names=[*batch.schema.names[:at], out])
        free_worker_cache()

    return staged.mapInArrow(run, schema)


def label_table(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One 0/1 label per id: (label_id, y)."""
    return labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("_y")) \
        .filter("label_id is not null and _y is not null") \
        .groupBy("label_id").agg((F.avg("_y") >= 0.5).cast("int").alias("y"))


def fit_sample(rows: DataFrame, features: str, label: str, key: str, *, max_rows: int = 20_000,
               **options) -> QualityModel:
    """Fit on the ``max_rows`` rows of lowest hashed key: a bounded, repeatable sample."""
    hashed = rows.select(F.xxhash64(F.col(key).cast("string")).alias("_h"), F.col(key).cast("string").alias("_k"),
                         F.col(features).alias("_x"), F.col(label).alias("_y"))
    got = low_hashes(hashed, "_h", max_rows).orderBy("_h", "_k").limit(max_rows).collect()
    x = np.array([r["_x"] for r in got], float).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["_y"] for r in got], int), **options)


def with_scores(spark: SparkSession, rows: DataFrame, features: str | None, out: str, model: QualityModel,
                text_col: str | None = None) -> DataFrame:
    """Replace the feature column by its score ``out``.

    With ``text_col``, keep all columns and score that text: its statistics are taken in the same
    task, which so needs one Python worker instead of two and hands the rows over once.
    """
    shared = Shared(spark, model)
    keep = [c for c in rows.columns if c != features or text_col is not None]
    given = F.col(features) if text_col is None else F.col(text_col).cast("string").alias(fresh_name(rows, "_text"))
    staged = rows.select(*[F.col(f"`{c}`") for c in keep], given)
    at = len(keep)
    schema = T.StructType(staged.schema.fields[:at] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        m = shared.value
        if text_col is not None:
            free_worker_cache()
            words, lines = WordHasher(SPACE_WORDS), WordHasher(_LINES)
        for batch in batches:
            if text_col is None:
                x = np.asarray(batch.column(at).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, len(FEATURES))
            else:
                x = statistics(batch.column(at), words, lines)
            s = m.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(at)] + [pa.array(s, pa.float64())],
                names=[*batch.schema.names[:at], out])
        if text_col is not None:
            free_worker_cache()

    return staged.mapInArrow(run, schema)
