"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams (orders 1 to 3 of the lower-cased text, everything but letters a
space) of every labelled document, hashed to ``buckets`` columns.  Counts are summed per task
in numpy, then per (language, segment of buckets) on Spark.  The log-probability matrix has
``languages x buckets`` numbers (both are parameters, so the broadcast is bounded) and
documents are scored in blocks: one gather and one segmented sum per language.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows with a null
or empty language teach nothing; without any training row every document is ``und``; ties go
to the first language in code-point order; repeated rows are scored (and counted) each; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, free_worker_cache, fresh_name

UND = "und"
ORDERS = (1, 2, 3)
BLOCK_CHARS = 1 << 18
SEGMENTS = 16
_LOW = 592  # code points below are mapped by table: letters stay, the rest is a space


def has_letter(text: str) -> bool:
    """Is any character of a letter category (numbers such as ½, ² or Ⅷ are not)?"""
    return any(map(str.isalpha, text))


def _low_table() -> np.ndarray:
    return np.array([i if chr(i).isalpha() else 32 for i in range(_LOW)], np.uint32)


def _blocks(texts):
    """Blocks of code points: (codes, [(row, first, last)]) with two spaces after each part.

    A long text is cut into parts that overlap by two characters, so no n-gram is lost; an
    n-gram belongs to the part in which it starts.
    """
    table = _low_table()
    parts, spans, size = [], [], 0

    def flush():
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(codes < _LOW, table[np.minimum(codes, _LOW - 1)], codes), list(spans)

    for row, text in enumerate(texts):
        if not text:
            continue
        text = text.lower()
        for at in range(0, len(text), BLOCK_CHARS):
            own = min(BLOCK_CHARS, len(text) - at)
            part = text[at:at + own + 2] + "  "
            if size + len(part) > 2 * BLOCK_CHARS and parts:
                yield flush()
                parts, spans, size = [], [], 0
            parts.append(part)
            spans.append((row, size, size + own))
            size += len(part)
    if parts:
        yield flush()


def _hashes(codes: np.ndarray, buckets: int):
    """Bucket of the n-gram of each order that starts at each position.

    Runs of spaces carry nothing: an n-gram that starts at a space followed by a space is
    sent to bucket 0 like the lone space.
    """
    mask = np.uint32(buckets - 1)
    a = codes
    b = np.concatenate([codes[1:], np.full(1, 32, np.uint32)])
    c = np.concatenate([codes[2:], np.full(2, 32, np.uint32)])[:len(codes)]
    h = a * np.uint32(0x9E3779B1)
    dull = (a == 32) & (b == 32)
    for order in ORDERS:
        if order == 2:
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + b * np.uint32(0xC2B2AE3D)
        elif order == 3:
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F) + c * np.uint32(0x165667B1)
        g = h ^ (h >> np.uint32(16))
        g = (g * np.uint32(0x7FEB352D) + np.uint32(order))
        g = ((g ^ (g >> np.uint32(15))) & mask).astype(np.int64)
        g[dull] = 0
        yield g


@dataclass
class LanguageModel:
    """languages (sorted), log priors, log probabilities [language, bucket]."""
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray
    background: float = 0.0

    @property
    def buckets(self) -> int:
        return self.log_prob.shape[1]

    def score(self, texts: list[str | None]):
        """(language, posterior, mean log-probability per n-gram) of each text."""
        n, k = len(texts), len(self.languages)
        logs = np.zeros((n, max(k, 1)))
        grams = np.zeros(n)
        live = [t is not None and has_letter(t) for t in texts]
        if k:
            use = [t if ok else None for t, ok in zip(texts, live)]
            for codes, spans in _blocks(use):
                rows = np.array([s[0] for s in spans])
                edge = np.array([(s[1], s[2]) for s in spans]).ravel()
                for g in _hashes(codes, self.buckets):
                    for j in range(k):
                        sums = np.add.reduceat(self.log_prob[j][g], edge)[::2]
                        np.add.at(logs[:, j], rows, sums)
                np.add.at(grams, rows, len(ORDERS) * (edge[1::2] - edge[::2]))
            mean = logs.max(axis=1) / np.maximum(grams, 1)
            logs = logs + self.log_prior
            best = logs.argmax(axis=1)
            post = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            live = np.array(live)
            names = np.where(live, np.array(self.languages, object)[best], UND)
            return names, np.where(live, post, 0.0), np.where(live, mean, 0.0)
        return np.full(n, UND, object), np.zeros(n), np.zeros(n)


def _count_schema() -> T.StructType:
    return T.StructType([T.StructField("lang", T.StringType()), T.StructField("seg", T.IntegerType()),
                         T.StructField("docs", T.LongType()),
                         T.StructField("bucket", T.ArrayType(T.IntegerType())),
                         T.StructField("n", T.ArrayType(T.LongType()))])


def train(docs: DataFrame, text_col: str, lang_col: str, *, buckets: int = 1 << 16,
          alpha: float = 0.1, max_languages: int = 200) -> LanguageModel:
    """Fit on all rows of ``docs`` with a non-empty language and a text.

    ``max_languages`` bounds the model; more distinct labels raise ``ValueError`` (nothing is
    dropped silently).
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang")) \
        .filter("text is not null and lang is not null and lang <> ''")
    width = buckets // SEGMENTS
    schema = _count_schema()

    def count(batches):
        free_worker_cache()
        counts: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang and has_letter(t)]
                if lang not in counts:
                    if len(counts) >= max_languages:
                        raise ValueError(f"more than {max_languages} language labels")
                    counts[lang], docs_of[lang] = np.zeros(buckets, np.int64), 0
                docs_of[lang] += len(own)
                for codes, spans in _blocks(own):
                    starts = np.zeros(len(codes) + 1, np.int8)
                    for _, a, b in spans:
                        starts[a] += 1
                        starts[b] -= 1
                    keep = np.cumsum(starts[:-1]) > 0
                    for g in _hashes(codes, buckets):
                        counts[lang] += np.bincount(g[keep], minlength=buckets)
        out = []
        for lang, c in counts.items():
            for seg in range(SEGMENTS):
                part = c[seg * width:(seg + 1) * width]
                at = np.flatnonzero(part)
                out.append({"lang": lang, "seg": seg, "docs": docs_of[lang] if seg == 0 else 0,
                            "bucket": at.astype(np.int32), "n": part[at]})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("lang", pa.string()), ("seg", pa.int32()), ("docs", pa.int64()),
                ("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))]))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for at, n in zip(pdf["bucket"], pdf["n"]):
            total[np.asarray(at, np.int64)] += np.asarray(n, np.int64)
        at = np.flatnonzero(total)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "seg": [pdf["seg"].iloc[0]],
                             "docs": [int(pdf["docs"].sum())],
                             "bucket": [at.astype(np.int32)], "n": [total[at]]})

    summed = rows.mapInArrow(count, schema).groupBy("lang", "seg").applyInPandas(add, schema)
    got = summed.collect()  # languages x buckets numbers at most
    languages = sorted({r["lang"] for r in got})
    if len(languages) > max_languages:
        raise ValueError(f"{len(languages)} language labels; at most {max_languages}")
    counts = np.zeros((len(languages), buckets))
    n_docs = np.zeros(len(languages))
    for r in got:
        j = languages.index(r["lang"])
        n_docs[j] += r["docs"]
        counts[j, r["seg"] * width + np.asarray(r["bucket"], np.int64)] += np.asarray(r["n"], float)
    keep = n_docs > 0
    languages = [x for x, ok in zip(languages, keep) if ok]
    counts, n_docs = counts[keep], n_docs[keep]
    log_prob = np.log((counts + alpha) / (counts.sum(axis=1, keepdims=True) + alpha * buckets))
    log_prior = np.log((n_docs + 1) / (n_docs + 1).sum()) if len(languages) else np.zeros(0)
    return LanguageModel(languages, log_prior, log_prob, -float(np.log(buckets)))


def predict(spark: SparkSession, docs: DataFrame, text_col: str, model: LanguageModel, *,
            lang_out: str = "lang_pred", score_out: str = "score",
            fits_out: str = "fits") -> DataFrame:
    """All columns of ``docs`` plus language, posterior and ``fits``.

    ``fits`` is false for ``und`` and for texts whose n-grams are less likely under their best
    language than under a uniform choice of buckets: they look like no learned language.
    The three new names must not be columns of ``docs`` (see ``common.fresh_name``).
    """
    shared = Shared(spark, model)
    plain = fresh_name(docs, "_text")
    staged = docs.withColumn(plain, F.col(text_col).cast("string"))
    schema = T.StructType(docs.schema.fields + [
        T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType()),
        T.StructField(fits_out, T.BooleanType())])
    at = len(docs.columns)

    def score(batches):
        free_worker_cache()
        m = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):  # texts of one slice at a time
                batch = whole.slice(i, 1024)
                lang, post, mean = m.score(batch.column(at).to_pylist())
                fits = (lang != UND) & (mean > m.background)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k) for k in range(at)]
                    + [pa.array(lang, pa.string()), pa.array(post, pa.float64()), pa.array(np.asarray(fits, bool))],
                    names=[*batch.schema.names[:at], lang_out, score_out, fits_out])

    return staged.mapInArrow(score, schema)
