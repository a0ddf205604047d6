"""Ranks, cuts and draws in hash order or in an explicit order, without a single-task window.

Rows of a group are ordered by ``md5(seed|purpose|key)``, ties broken by the key.  Neither the
table is sorted nor a class put on one task: ``hash_cuts`` and ``order_cuts`` find the keys at a
few ranks, ``rows_at`` fetches the rows at many ranks.
"""

from __future__ import annotations

import math

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import c
from ..session import cut_lineage


def hash_key(key_cols: Sequence[str], seed: int | str, purpose: str) -> Column:
    """Hex md5 of ``seed|purpose|key…``; identical in Spark SQL and DuckDB."""
    parts = [F.lit(str(seed)), F.lit(purpose)] + [c(k).cast("string") for k in key_cols]
    return F.md5(F.concat_ws("|", *parts))


# ---------------------------------------------------------------------------
# Rows at given ranks
#
# The hash is read as digits.  One narrow pass counts rows by a prefix; the
# prefixes that hold a wanted rank stay open and are counted by longer prefixes
# (only their rows), until the open ones hold two rows per wanted rank at most.
# So however many rows there are, about as many as are wanted get shuffled.

CODE_DIGITS = 15           # hex digits of the hash in one integer
PREFIX_ROWS = 1 << 20      # prefixes counted in one pass, at most (they reach the driver)


def _prefix(code: Column, digits: int) -> Column:
    return F.shiftright(code, 4 * (CODE_DIGITS - digits))


def _open_prefixes(coded: DataFrame, ranks: np.ndarray, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(digits, prefixes, rows before each): the prefixes that hold ``ranks`` (0-based, sorted)."""
    digits = min(5, max(1, math.ceil(math.log(4 * max(n, 1), 16))))
    held = None
    while True:
        rows = coded if held is None else coded.join(F.broadcast(held[0]), _prefix(F.col("_code"), held[1]) == F.col("_open"), "left_semi")
        got = rows.groupBy(_prefix(F.col("_code"), digits).alias("p")).agg(F.count("*").alias("n")).toArrow()
        order = np.argsort(got["p"].to_numpy())
        prefix, count = got["p"].to_numpy()[order], got["n"].to_numpy()[order]
        if held is None:
            start = np.cumsum(count) - count
            if ranks[-1] >= count.sum():
                raise ValueError(f"rank {ranks[-1]} of {count.sum()} rows")
        else:  # rows before a prefix: those before its parent, and its smaller siblings
            parent = np.searchsorted(held[2], prefix >> (4 * (digits - held[1])))
            run = np.cumsum(count) - count
            start = held[3][parent] + run - run[np.searchsorted(parent, np.arange(len(held[2])))][parent]
        at = np.unique(np.searchsorted(start, ranks, "right") - 1)
        prefix, start, count = prefix[at], start[at], count[at]
        if count.sum() <= 2 * len(ranks) or digits == CODE_DIGITS:
            return digits, prefix, start
        more = max(1, int(math.log(max(PREFIX_ROWS / len(prefix), 1), 16)))
        table = coded.sparkSession.createDataFrame(pa.table({"_open": prefix}))
        held, digits = (table, digits, prefix, start), min(CODE_DIGITS, digits + more)


def rows_at(df: DataFrame, key_cols: Sequence[str], ranks: np.ndarray, n: int, seed: int | str, purpose: str,
            out: str = "_rank") -> DataFrame:
    """The rows at the given 0-based ``ranks`` (sorted, distinct) of the hash order, with their rank.

    Keys must be unique: a prefix of 15 hash digits that still holds many rows is an error.
    """
    code = F.conv(F.substring("_h", 1, CODE_DIGITS), 16, 10).cast("long")
    keyed = df.withColumn("_h", hash_key(key_cols, seed, purpose)).withColumn("_code", code)
    digits, prefix, start = _open_prefixes(keyed.select("_code"), ranks, n)
    spark = df.sparkSession
    opened = spark.createDataFrame(pa.table({"_open": prefix, "_start": start}))
    wanted = spark.createDataFrame(pa.table({out: ranks}))
    at = _prefix(F.col("_code"), digits)
    # as many rows as are wanted, at most: bounded by the caller's parameters, not by n
    near = keyed.join(F.broadcast(opened), at == F.col("_open"))
    place = F.row_number().over(Window.partitionBy("_open").orderBy("_h", *[c(k) for k in key_cols]))
    return near.withColumn(out, (F.col("_start") + place - 1).cast("long")).join(F.broadcast(wanted), out, "left_semi") \
        .drop("_h", "_code", "_open", "_start")


# ---------------------------------------------------------------------------
# Cuts without ranking every row
#
# A split or sample only needs, per group, the hash value of the row at a few
# cut ranks: every row with a hash at or below that value is "in".  The bucket
# histogram (one narrow pass with partial aggregation) says which bucket holds
# each cut; only rows of those boundary buckets are ordered exactly (a shuffle
# of ≈ n / 16**digits rows per cut), refining by longer hash prefixes while a
# boundary bucket is still large.  The final labelling is a comparison per row:
# no shuffle of the table.  Keys must be unique (distinct keys have distinct
# md5 values).

LOW, HIGH = "", "~"            # sentinels: below / above every hex digest
EXACT_BUCKET_ROWS = 2_000_000  # a boundary bucket larger than this is refined


def _group_match(group_cols: list[str], g: tuple, prefix: str) -> Column:
    term = F.substring("_h", 1, len(prefix)) == F.lit(prefix)
    for col, val in zip(group_cols, g):
        term = term & (c(col) == F.lit(val))
    return term


def _kth_hash(d: DataFrame, group_cols: list[str], wanted: list[tuple], prefix_len: int
              ) -> dict[tuple, str]:
    """``wanted``: (group values, prefix, r, rows in prefix) with prefixes of length
    ``prefix_len`` → {(group, prefix, r): hash of the r-th smallest row of that
    group whose hash starts with ``prefix``}."""
    out: dict[tuple, str] = {}
    exact = [w for w in wanted if w[3] <= EXACT_BUCKET_ROWS or prefix_len + 4 > 32]
    refine = [w for w in wanted if w not in exact]
    if exact:
        cond = None
        for g, p, _, _ in exact:
            t = _group_match(group_cols, g, p)
            cond = t if cond is None else cond | t
        # one window partition per (group, boundary prefix), each ≤ EXACT_BUCKET_ROWS rows
        w = Window.partitionBy(*group_cols, F.substring("_h", 1, prefix_len)).orderBy("_h")
        ranked = d.filter(cond).select(*group_cols, "_h") \
            .withColumn("_r", F.row_number().over(w))
        pick = None
        for g, p, r, _ in exact:
            t = _group_match(group_cols, g, p) & (F.col("_r") == F.lit(r))
            pick = t if pick is None else pick | t
        for row in ranked.filter(pick).collect():
            g = tuple(row[x] for x in group_cols)
            for gg, p, r, _ in exact:
                if gg == g and row["_h"].startswith(p) and row["_r"] == r:
                    out[(gg, p, r)] = row["_h"]
    for g, prefix, r, _ in refine:
        # the boundary bucket is still large: histogram it by 4 more hex digits
        plen = prefix_len + 4
        hist = sorted((row["_p"], int(row["n"])) for row in
                      d.filter(_group_match(group_cols, g, prefix))
                      .groupBy(F.substring("_h", 1, plen).alias("_p"))
                      .agg(F.count(F.lit(1)).alias("n")).collect())
        acc = 0
        for p2, n in hist:
            if acc + n >= r:
                sub = _kth_hash(d, group_cols, [(g, p2, r - acc, n)], plen)
                out[(g, prefix, r)] = sub[(g, p2, r - acc)]
                break
            acc += n
    return out


def hash_cuts(df: DataFrame, key_cols: Sequence[str], seed: int | str, purpose: str,
              group_cols: Sequence[str], cuts_for, digits: int = 3
              ) -> tuple[DataFrame, dict, dict]:
    """Per group, the hash thresholds of the requested cut ranks.

    ``cuts_for(counts) -> {group value: [rank, …]}`` gets the per-group row
    counts (from the histogram) and returns 0-based cut sizes: a cut ``b`` keeps
    the first ``b`` rows in hash order.  Returns (df with ``_h``, counts,
    {group value: [threshold hash, …]}) where row ∈ first b ⇔ ``_h <= threshold``.
    """
    group_cols = list(group_cols)
    d = df.withColumn("_h", hash_key(key_cols, seed, purpose))
    # ≤ groups · 16**digits rows reach the driver (4,096 per group by default);
    # a boundary bucket that is still large is refined by _kth_hash
    hist_rows = (d.groupBy(*group_cols, F.substring("_h", 1, digits).alias("_b"))
                 .agg(F.count(F.lit(1)).alias("n")).collect())
    per_group: dict[tuple, list[tuple[str, int]]] = {}
    for row in hist_rows:
        per_group.setdefault(tuple(row[x] for x in group_cols), []).append(
            (row["_b"], int(row["n"])))
    counts = {g: sum(n for _, n in v) for g, v in per_group.items()}
    plain = {(g[0] if len(group_cols) == 1 else g): n for g, n in counts.items()}
    wanted_cuts = cuts_for(plain)
    wanted, plan = [], {}
    for g, buckets in per_group.items():
        gk = g[0] if len(group_cols) == 1 else g
        buckets.sort()
        for b in wanted_cuts.get(gk, []):
            if b <= 0:
                plan[(g, b)] = LOW
            elif b >= counts[g]:
                plan[(g, b)] = HIGH
            else:
                acc = 0
                for prefix, n in buckets:
                    if acc + n >= b:
                        wanted.append((g, prefix, b - acc, n))
                        plan[(g, b)] = (g, prefix, b - acc)
                        break
                    acc += n
    found = _kth_hash(d, group_cols, wanted, digits) if wanted else {}
    thresholds = {}
    for g in per_group:
        gk = g[0] if len(group_cols) == 1 else g
        ts = []
        for b in wanted_cuts.get(gk, []):
            v = plan[(g, b)]
            ts.append(v if isinstance(v, str) else found[v])
        thresholds[gk] = ts
    return d, plain, thresholds


def cut_label(group_cols: Sequence[str], thresholds: dict, names) -> Column:
    """``names[i]`` for rows whose hash is at or below threshold i (first match),
    ``names[len(thresholds)]`` otherwise; per group (``names`` may be a dict
    group value → names)."""
    expr = None
    for g, ts in thresholds.items():
        nm_list = names[g] if isinstance(names, dict) else names
        inner = None
        for t, nm in zip(ts, nm_list):
            cond = F.col("_h") <= F.lit(t)
            inner = F.when(cond, F.lit(nm)) if inner is None else inner.when(cond, F.lit(nm))
        if len(nm_list) > len(ts):
            inner = F.lit(nm_list[len(ts)]) if inner is None else inner.otherwise(
                F.lit(nm_list[len(ts)]))
        gv = g if isinstance(g, tuple) else (g,)
        term = None
        for col, val in zip(group_cols, gv):
            t = c(col) == F.lit(val)
            term = t if term is None else term & t
        if term is None:
            return inner
        expr = F.when(term, inner) if expr is None else expr.when(term, inner)
    return expr if expr is not None else F.lit(None).cast("string")


# ---------------------------------------------------------------------------
# Positional cuts without sorting the table
#
# The first b rows under an order key are exactly the rows whose key is at or
# below the b-th key.  That key is found by selection: a bounded hash sample
# of keys proposes a lower and an upper candidate around each cut, one pass of
# conditional counts places the cut inside the slice between them, and only
# that slice (≈ n·margin / sample rows) is ordered exactly; a slice that is
# still large is narrowed the same way.  Labelling is a comparison per row.

SLICE_ROWS = 250_000        # keys collected for one exact slice (driver memory bound)
SAMPLE_ROWS = 100_000
MAX_DEPTH = 6               # narrowings by samples before a slice is sorted on Spark


def _lex(cols: Sequence[str], values: Sequence, strict: bool) -> Column:
    """(cols) < values (strict) or ≤ values, lexicographically."""
    expr = None
    for i in range(len(cols) - 1, -1, -1):
        v = F.lit(values[i])
        here = (c(cols[i]) < v) if (strict or i < len(cols) - 1) else (c(cols[i]) <= v)
        if expr is None:
            expr = here
        else:
            expr = (c(cols[i]) < v) | ((c(cols[i]) == v) & expr)
    return expr


def lex_le(cols: Sequence[str], values: Sequence) -> Column:
    return _lex(cols, values, strict=False)


def lex_lt(cols: Sequence[str], values: Sequence) -> Column:
    return _lex(cols, values, strict=True)


def _sorted_kth(keys: DataFrame, cols: list[str], wanted: list[int]) -> dict[int, tuple]:
    """The keys at ``wanted`` positions by a distributed sort (samples were unlucky too often).

    One count per partition and the wanted keys reach the driver, whatever the slice holds.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut_lineage(keys.repartitionByRange(parts, *[c(x) for x in cols]).withColumn("_part", F.spark_partition_id()))
    start, picks = 0, {}
    for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        picks.update({(r["_part"], b - start): b for b in wanted if start < b <= start + r["n"]})
        start += r["n"]
    w = Window.partitionBy("_part").orderBy(*[c(x) for x in cols])
    placed = ordered.withColumn("_at", F.row_number().over(w))
    hit = F.struct("_part", F.col("_at").cast("long").alias("_at"))
    wish = F.array(*[F.struct(F.lit(p).alias("_part"), F.lit(a).cast("long").alias("_at")) for p, a in picks])
    return {picks[r["_part"], r["_at"]]: tuple(r[x] for x in cols) for r in placed.filter(F.array_contains(wish, hit)).collect()}


def _select_kth(df: DataFrame, cols: list[str], wanted: list[int], n: int, lo, hi,
                seed: int, depth: int = 0) -> dict[int, tuple]:
    """Keys of the rows at 1-based positions ``wanted`` among the rows of ``df``
    whose key lies in (lo, hi] (``lo``/``hi`` None = unbounded); ``n`` rows."""
    out: dict[int, tuple] = {}
    base = df
    if lo is not None:
        base = base.filter(~lex_le(cols, lo))
    if hi is not None:
        base = base.filter(lex_le(cols, hi))
    if n > SLICE_ROWS and depth > MAX_DEPTH:
        return _sorted_kth(base.select(*[c(x) for x in cols]), cols, wanted)
    if n <= SLICE_ROWS:
        # the slice is small: order it exactly (bounded by SLICE_ROWS keys)
        keys = [tuple(r) for r in base.select(*[c(x) for x in cols]).orderBy(*cols).collect()]
        for b in wanted:
            out[b] = keys[b - 1]
        return out
    p = min(1.0, SAMPLE_ROWS / n)
    u = (F.xxhash64(F.lit(seed + depth), F.lit("order-sample"), *[c(x) for x in cols])
         .cast("double") / F.lit(2.0 ** 64) + F.lit(0.5))
    sample = sorted(tuple(r) for r in base.filter(u < F.lit(p)).select(*[c(x) for x in cols])
                    .collect())
    m = len(sample)
    margin = int(4 * math.sqrt(max(m, 1))) + 8
    cands = []
    for b in wanted:
        q = b * m / n
        i_lo, i_hi = int(q) - margin, int(q) + margin
        cands.append((b, sample[i_lo] if 0 <= i_lo < m else None,
                      sample[i_hi] if 0 <= i_hi < m else None))
    aggs = []
    for j, (_, l, h) in enumerate(cands):
        below = lex_le(cols, l) if l is not None else F.lit(False)
        upto = lex_le(cols, h) if h is not None else F.lit(True)
        aggs += [F.count_if(below).alias(f"b{j}"), F.count_if(upto).alias(f"u{j}")]
    cnt = base.agg(*aggs).collect()[0]
    for j, (b, l, h) in enumerate(cands):
        nb, nu = int(cnt[f"b{j}"]), int(cnt[f"u{j}"])
        if nb < b <= nu:
            # the cut lies in the slice (l, h]
            sub = _select_kth(df, cols, [b - nb], nu - nb, l if l is not None else lo,
                              h if h is not None else hi, seed, depth + 1)
            out[b] = sub[b - nb]
        else:
            # unlucky sample: search the whole range again with a new sample
            out.update(_select_kth(df, cols, [b], n, lo, hi, seed + 101, depth + 1))
    return out


def order_cuts(df: DataFrame, order_cols: Sequence[str], cuts: Sequence[int], n: int,
               seed: int = 42) -> list:
    """For each cut b, the key tuple of the b-th row in (order_cols) order, or
    ``LOW_KEY`` (b = 0) / ``HIGH_KEY`` (b = n).  Order keys must be unique and
    non-null."""
    cols = list(order_cols)
    inner = sorted({b for b in cuts if 0 < b < n})
    keys = _select_kth(df, cols, inner, n, None, None, seed) if inner else {}
    return [LOW_KEY if b <= 0 else HIGH_KEY if b >= n else keys[b] for b in cuts]


LOW_KEY, HIGH_KEY = "low", "high"


def key_at_or_below(cols: Sequence[str], key) -> Column:
    if key == LOW_KEY:
        return F.lit(False)
    if key == HIGH_KEY:
        return F.lit(True)
    return lex_le(cols, key)
