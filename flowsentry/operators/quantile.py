"""Exact linear-interpolated percentiles without sorting or holding the values.

The same definition at every size: the value at position ``f·(n − 1)`` of the sorted
values, interpolated between its two neighbours (nulls ignored, NaN above all numbers).

Every double is read as a 64-bit integer of the same order.  A pass counts, in each task,
the values of every open range by their next ``DIGIT_BITS`` bits; the counts are summed on
Spark and only the range that holds each wanted order statistic comes to the driver.  A
range is done when all of its values are equal; one of at most ``LIST_ROWS`` rows is
listed whole by the next pass.  So a column takes two to seven narrow passes whatever its
size or distribution, a task holds ``2**DIGIT_BITS`` counts per open range, and the driver
gets one row per wanted order statistic and pass.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT_BITS = 12
LIST_ROWS = 20_000     # a range of at most this many rows is listed value by value

_SIGN = np.uint64(1 << 63)


def to_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (−0 = 0, NaN above all)."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def from_key(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def percentiles(df: DataFrame, columns: dict[str, Column], fractions: Sequence[float]
                ) -> dict[str, list[float] | None]:
    """Percentiles of several expressions at once; None where no row has a value."""
    names = list(columns)
    d = df.select(*[columns[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    totals = d.agg(*[F.count(f"v{i}") for i in range(len(names))]).collect()[0]
    ranks = []
    for i, n in enumerate(totals):
        at = [f * (n - 1) for f in fractions] if n else []
        ranks.append(sorted({r for p in at for r in (math.floor(p), math.ceil(p))}))
    found = _order_statistics(d, list(totals), ranks)
    out: dict[str, list[float] | None] = {}
    for i, (name, n) in enumerate(zip(names, totals)):
        if n == 0:
            out[name] = None
            continue
        values = []
        for f in fractions:
            pos = f * (n - 1)
            a, b = math.floor(pos), math.ceil(pos)
            lo, hi = found[i, a], found[i, b]
            values.append(lo if a == b or lo == hi else (b - pos) * lo + (pos - a) * hi)
        out[name] = values
    return out


def _order_statistics(d: DataFrame, totals: list[int], ranks: list[list[int]]
                      ) -> dict[tuple[int, int], float]:
    """{(column, 0-based rank): value} for the wanted ranks of every column."""
    out: dict[tuple[int, int], float] = {}
    # open ranges: (column, bits, prefix, rows) -> [(rank in the column, rank in the range)]
    todo = {(i, 0, 0, n): [(r, r) for r in ranks[i]] for i, n in enumerate(totals) if ranks[i]}
    while todo:
        slots = list(todo)
        counts = _count(d, slots)
        want = d.sparkSession.createDataFrame(
            [(s, r, k) for s, slot in enumerate(slots) for r, k in todo[slot]],
            "slot int, rank long, inside long")
        w = Window.partitionBy("slot").orderBy("digit")   # ≤ 2**DIGIT_BITS or LIST_ROWS rows
        rows = counts.withColumn("before", F.sum("n").over(w) - F.col("n")) \
            .join(F.broadcast(want), "slot") \
            .filter((F.col("inside") >= F.col("before")) & (F.col("inside") < F.col("before") + F.col("n"))) \
            .collect()
        if len(rows) != sum(map(len, todo.values())):
            raise RuntimeError("percentile: the rows changed between two passes")
        todo_next: dict[tuple, list] = {}
        for r in rows:
            i, bits, _, _ = slots[r["slot"]]
            lo, hi = (v + (1 << 63) for v in (r["lo"], r["hi"]))
            if lo == hi:
                out[i, r["rank"]] = from_key(lo)
            else:
                bits = min(64, bits + DIGIT_BITS)
                todo_next.setdefault((i, bits, lo >> (64 - bits), r["n"]), []).append(
                    (r["rank"], r["inside"] - r["before"]))
        todo = todo_next
    return out


def _count(d: DataFrame, slots: list[tuple]) -> DataFrame:
    """Rows (slot, digit, n, lo, hi): values of each range by their next bits, or one by
    one; ``lo`` and ``hi`` are the least and greatest key, shifted into signed integers."""
    digits, listed = 1 << DIGIT_BITS, LIST_ROWS
    used = sorted({s[0] for s in slots})
    width = DIGIT_BITS
    sign = _SIGN
    keys_of = to_keys

    def run(batches):
        n = {s: np.zeros(digits, np.int64) for s, slot in enumerate(slots) if slot[3] > listed}
        lo = {s: np.full(digits, np.iinfo(np.uint64).max, np.uint64) for s in n}
        hi = {s: np.zeros(digits, np.uint64) for s in n}
        values = {s: [] for s in range(len(slots)) if s not in n}
        for batch in batches:
            keys = {i: keys_of(batch.column(k).drop_null().to_numpy(zero_copy_only=False))
                    for k, i in enumerate(used)}
            for s, (i, bits, prefix, _) in enumerate(slots):
                u = keys[i]
                if bits:
                    u = u[(u >> np.uint64(64 - bits)) == np.uint64(prefix)]
                if s in values:
                    values[s].append(u)
                    continue
                left = 64 - bits
                digit = ((u >> np.uint64(max(0, left - width)))
                         & np.uint64((1 << min(width, left)) - 1)).astype(np.int64)
                n[s] += np.bincount(digit, minlength=digits)
                np.minimum.at(lo[s], digit, u)
                np.maximum.at(hi[s], digit, u)
        for s in range(len(slots)):
            if s in values:
                u, c = np.unique(np.concatenate(values[s] or [np.zeros(0, np.uint64)]),
                                 return_counts=True)
                first = last = (u ^ sign).view(np.int64)
                digit = first
            else:
                digit = np.flatnonzero(n[s])
                c = n[s][digit]
                first, last = ((v[digit] ^ sign).view(np.int64) for v in (lo[s], hi[s]))
            if len(digit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(digit), s, np.int32)), pa.array(digit),
                     pa.array(c.astype(np.int64)), pa.array(first), pa.array(last)],
                    names=["slot", "digit", "n", "lo", "hi"])

    parts = d.select(*[f"v{i}" for i in used]) \
        .mapInArrow(run, "slot int, digit long, n long, lo long, hi long")
    return parts.groupBy("slot", "digit").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"),
                                              F.max("hi").alias("hi"))
