"""Importance resampling towards a target: hashed feature weights and exact distributed ranks.

Every document's features (runs of 1 to ``max_run`` consecutive words) fall into ``buckets``
hash buckets.  A bucket's gain is the floored log ratio of its smoothed share in the target
texts and in all documents; a document's weight is the sum of its features' gains, read from
one array.  Weight plus Gumbel noise (a hash of seed and id) is the score, and the documents of
the highest scores are a weighted draw without replacement.  Steps:

1. ``cells``: one pass over the texts keeps each document's bucket numbers (two bytes a feature)
   in a table; counting and weighting read that table, not the texts.
2. Weights and scores: the array of gains (``buckets`` numbers, a fixed bound) goes to the tasks.
3. Ranks by *parallel sorting by regular sampling*: each task sorts its rows into a run and
   numbers them; every ``step``-th row of the runs (about ``SAMPLES`` in all, whatever the size)
   gives the splitters; rows per segment between splitters are counted, and their prefix sums
   say where each segment starts.  Only segments that hold drawn ranks are exchanged, one
   segment a task; a segment's pieces are merged there and numbered from its prefix count.

Rows are ordered by score, id, run and place in the run, so rows that tie in score, or repeat an
id, can fall into different segments: no value is too frequent to be divided.

Defined cases: a null or wordless text has no features and weight 0; a null id draws the noise
of an empty id and comes first among ties; repeated rows are ranked one by one; empty documents
give no rows; an empty target gives the gains of T = 0; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALNUM_WORDS, Workspace

SAMPLES = 20_000        # regular samples on the driver, about
SEGMENT_ROWS = 200_000  # rows of a segment, about, while that needs no more than MOST_SEGMENTS
MOST_SEGMENTS = 10_000
MEMO_BYTES = 32 << 20   # words whose bucket a task remembers

#: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: other bytes become blanks.
_WORDS = bytes(ALNUM_WORDS).translate(bytes.maketrans(b"\0", b" "))


class Buckets(dict):
    """Bucket of a word, remembered within a bound of bytes."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets, self.held = buckets, 0

    def __missing__(self, word: bytes) -> int:
        cell = zlib.crc32(word) % self.buckets
        if self.held < MEMO_BYTES:
            self.held += len(word) + 120
            self[word] = cell
        return cell


def feature_cells(words: Sequence[bytes], memo: Buckets, max_run: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``max_run`` words, shorter runs first."""
    kind = np.uint16 if memo.buckets <= 1 << 16 else np.uint32
    cells = [np.fromiter(map(memo.__getitem__, words), kind, len(words))]
    if max_run > 1:
        last = [zlib.crc32(w) for w in words]
        for n in range(2, max_run + 1):
            last = [zlib.crc32(w, zlib.crc32(b" ", c)) for c, w in zip(last, words[n - 1:])]
            cells.append((np.fromiter(last, np.uint32, len(last)) % memo.buckets).astype(kind))
    return np.concatenate(cells)


def cells(docs: DataFrame, id_col: str, text_col: str, buckets: int, max_run: int) -> DataFrame:
    """(id, n_words, n_features, cells): the bucket numbers as little-endian unsigned integers."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches):
        memo = Buckets(buckets)
        for batch in batches:
            texts, some, n = batch.column(1), [], []
            for k in range(len(texts)):
                words = (texts[k].as_py() or b"").translate(_WORDS).split()
                some.append(feature_cells(words, memo, max_run))
                n.append(len(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([len(c) for c in some], pa.int64()),
                 pa.array([c.tobytes() for c in some], pa.binary())], names=["id", "n_words", "n_features", "cells"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_words long, n_features long, cells binary")


def _flat(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All cells of a binary column in one array, and the offsets of its rows."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = b"" if data is None else memoryview(data)[ends[0]:ends[-1]]
    return np.frombuffer(data, kind), (ends - ends[0]) // kind.itemsize


def bucket_counts(table: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: one row per task and used bucket, summed by Spark."""

    def run(batches):
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            count += np.bincount(_flat(batch.column(0), buckets)[0], minlength=buckets)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in table.select("cells").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed shares' ratio) of each bucket."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(y + 1) * float(s + b) / (float(x + 1) * float(t + b))))
                     for x, y in zip(source.tolist(), target.tolist())], np.int64)


def with_weights(spark: SparkSession, table: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of a table of cells."""
    sent = spark.sparkContext.broadcast(gains)

    def run(batches):
        gains = sent.value
        for batch in batches:
            at, ends = _flat(batch.column(3), len(gains))
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(gains[at])])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums[ends[1:]] - sums[ends[:-1]])],
                                             names=["id", "n_words", "n_features", "weight"])

    kind = dict(table.dtypes)["id"]
    return table.select("id", "n_words", "n_features", "cells").mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(seed: str, key: Column) -> Column:
    """floor(1000 x Gumbel noise) from the first 32 bits of sha256(``seed:key``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


# ---------------------------------------------------------------- ranks by regular sampling


def sorted_runs(rows: DataFrame, ranked: Column) -> DataFrame:
    """Adds run and place: each task sorts its rows by score and id and numbers the ranked ones."""
    ordered = rows.withColumn("ranked", ranked).sortWithinPartitions(F.desc("ranked"), F.desc("score"), F.asc_nulls_first("id"))
    at = ordered.columns.index("ranked")

    def number(batches):
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch)
            live = batch.column(at).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n), mask=~live)],
                                             names=[*batch.schema.names, "run", "place"])
            place += n

    kinds = ", ".join(f"`{c}` {k}" for c, k in ordered.dtypes)
    return ordered.mapInArrow(number, f"{kinds}, run int, place long").drop("ranked")


def _key(score, ident, run, place) -> tuple:
    return (-score, ident is not None, 0 if ident is None else ident, run, place)


def splitters(runs: DataFrame, n: int, segments: int) -> list[tuple]:
    """At most ``segments`` - 1 keys between segments, from every ``step``-th row of the runs.

    The runs' phases differ by a hash, so short runs are sampled in proportion too.
    """
    step = max(1, n // SAMPLES)
    drawn = runs.filter(F.col("place").isNotNull() & (F.pmod(F.col("place") + F.xxhash64("run"), F.lit(step)) == 0))
    keys = sorted(_key(r["score"], r["id"], r["run"], r["place"]) for r in drawn.select("score", "id", "run", "place").collect())
    return [keys[len(keys) * k // segments] for k in range(1, segments)] if keys else []


def with_segments(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """Adds segment: how many splitters are at or below the row (null for unranked rows)."""
    names = runs.columns
    score, ident, run, place = (names.index(c) for c in ("score", "id", "run", "place"))
    sent = runs.sparkSession.sparkContext.broadcast(cuts)

    def find(batches):
        cuts = sent.value
        falling = np.array([c[0] for c in cuts], np.int64)
        for batch in batches:
            at = -batch.column(score).to_numpy()
            low, high = np.searchsorted(falling, at, "left"), np.searchsorted(falling, at, "right")
            for k in np.flatnonzero(low != high).tolist():  # rows that tie with a splitter's score
                low[k] = bisect_right(cuts, _key(int(-at[k]), batch.column(ident)[k].as_py(), batch.column(run)[k].as_py(),
                                                 batch.column(place)[k].as_py() or 0), int(low[k]), int(high[k]))
            ranked = batch.column(place).is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low.astype(np.int32), mask=~ranked)], names=[*names, "segment"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in runs.dtypes)
    return runs.mapInArrow(find, f"{kinds}, segment int")


def top_ranks(ws: Workspace, runs: DataFrame, n: int, draw: int) -> DataFrame:
    """Adds rank: 1 to ``draw`` by falling score, then rising id; null for all other rows."""
    out = runs.columns[:runs.columns.index("run")]
    none = F.lit(None).cast("long").alias("rank")
    if draw <= 0:
        return runs.select(*out, none)
    least = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    segments = min(max(least, -(-n // SEGMENT_ROWS)), MOST_SEGMENTS)
    cuts = splitters(runs, n, segments * -(-n // draw))  # so many segments hold the drawn rows
    held = ws.save(with_segments(runs, cuts), "segments")
    counts = {r["segment"]: r["n"] for r in held.filter("segment is not null").groupBy("segment").agg(F.count("*").alias("n")).collect()}
    start, bases = 0, []
    for s in sorted(counts):
        if start >= draw:
            break
        bases.append((s, len(bases), start))
        start += counts[s]
    base = ws.spark.createDataFrame(bases, "segment int, slot int, base long")
    last = bases[-1][0]
    near = held.filter(F.col("segment") <= last).join(F.broadcast(base), "segment").repartitionById(len(bases), "slot")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_first("id"), "run", "place")
    rank = F.col("base") + F.row_number().over(order)
    drawn = near.select(*out, F.when(rank <= draw, rank).alias("rank"))
    return drawn.unionByName(held.filter(F.col("segment").isNull() | (F.col("segment") > last)).select(*out, none))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, *, id_col: str, text_col: str, target_text: str, seed: str,
             percent: int, min_words: int, buckets: int = 10_000, max_run: int = 1) -> DataFrame:
    """(id, n_features, weight, score, rank) of every document.

    Of the N documents with at least ``min_words`` words, floor(percent x N / 100) are drawn.
    """
    ws = Workspace(spark, "resample")
    table = ws.save(cells(docs, id_col, text_col, buckets, max_run), "cells")
    aim = cells(target.select(F.lit(0).alias("item"), F.col(target_text).alias("words")), "item", "words", buckets, max_run)
    gains = bucket_gains(bucket_counts(table, buckets), bucket_counts(aim, buckets))
    weighed = with_weights(spark, table, gains)
    scored = weighed.withColumn("score", F.col("weight") + noise(seed, F.col("id")))
    runs = ws.save(sorted_runs(scored, F.col("n_words") >= min_words), "runs")
    ws.drop("cells")
    n = runs.filter("place is not null").count()
    return top_ranks(ws, runs, n, percent * n // 100).drop("n_words")
