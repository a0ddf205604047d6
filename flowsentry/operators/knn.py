"""k-nearest neighbours (M4): exact by pivots, or approximate by random projections.

Both modes work on *points*: equal vectors are one point that lists its k + 1 smallest keys, so a
vector shared by half of all rows is met once, and its rows get their neighbours by a join.

Exact mode.  Up to ``MAX_PIVOTS`` points are pivots.  Every reference point belongs to the cell of
its nearest pivot; large cells are cut into rings by distance to the pivot, and rings of near
pivots are put together in groups of at most ``wide`` points (a larger ring is cut by hash).  For a
query the triangle inequality bounds its distance to a whole ring from below, by the ring's
distances to its pivot and by the two pivots' distances.  A first round searches the group of
each query's most promising ring and so bounds its k-th distance from above; the second sends
the query, with that bound, to the other groups that hold a ring whose lower bound does not exceed
it.  Inside a group only such rings are searched, and only neighbours within the bound are
returned.  So a query is copied once per group at most, however many rings it visits, and no
neighbour is lost.

Every search is a ``cogroup`` of a block of queries with a block of points; it keeps the k best
of each query as one row of arrays, which ``merged`` unites by query.

Approximate mode: see ``lsh.py``.

Defined cases: rows with a null key take no part, nor do vectors that are null or hold a null,
NaN or infinite component (they are neither queries nor neighbours); keys must be integers;
rows that repeat a key are one neighbour each; ties go to the smaller key; with fewer than k
candidates all of them are returned.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import c
from ..session import cut_lineage

METRICS = ("euclidean", "manhattan")

# Bound on the rounding error of ‖q‖² + ‖r‖² − 2q·r relative to ‖q‖² + ‖r‖²
# (a few hundred ulps, far above the worst case of a d-term dot product).
REL_ERR = 1e-11
ABS_ERR = 1e-300

PLAIN_ROWS = 16384   # so few rows are searched without pivots
RING_ROWS = 1024     # least points of a ring, about
MAX_PIVOTS = 1024    # at most; otherwise the square root of the rows
MAX_RINGS = 64
CELLS = 1 << 20      # (query, point) distances, or neighbours, that a task holds at once
TILE = 1 << 15         # of these that are worked on together: they stay in the processor's own cache
BLOCK_BYTES = 1 << 25  # of vectors in a block of points or queries, where there are many
MAX_SPREAD = 1024    # partitions for the blocks of a round, where these are no more
SLACK = 1e-9         # relative slack of the triangle bounds, far above rounding errors


def as_vector(df: DataFrame, key: str, features: Sequence[str] | str) -> DataFrame:
    """(key, vec array<double>) of the rows that can take part."""
    if df.schema[key].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"neighbour search needs an integer key, {key} is {df.schema[key].dataType.simpleString()}")
    if isinstance(features, str):
        vec = c(features).cast("array<double>")
    else:
        vec = F.array(*[c(f).cast("double") for f in features])
    rows = df.select(c(key).cast("long").alias("key"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce((x - x) == F.lit(0.0), F.lit(False)))
    return rows.filter(F.col("key").isNotNull() & F.coalesce(finite, F.lit(False)))


def points(rows: DataFrame, copies: int) -> DataFrame:
    """(pid, vec, keys): each distinct vector with its smallest key and its ``copies`` smallest keys."""
    at = Window.partitionBy("vec").orderBy("key")
    first = rows.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= copies)
    return first.groupBy("vec").agg(F.min("key").alias("pid"), F.sort_array(F.collect_list("key")).alias("keys")) \
        .select("pid", "vec", "keys")


def pair_distances(Q: np.ndarray, R: np.ndarray, metric: str) -> np.ndarray:
    """Exact distances, summed over dimensions in order (matches a plain SQL sum)."""
    out = np.empty((len(Q), len(R)))
    for s, D in _tiles(out):
        D[:] = 0.0
        _add_dimensions(D, Q[s:s + len(D)], R, range(Q.shape[1]), metric)
    return out if metric == "manhattan" else np.sqrt(out, out=out)


def _tiles(out: np.ndarray):
    """(first row, rows) of pieces that stay in the processor's own cache."""
    step = max(1, TILE // max(1, out.shape[1]))
    for s in range(0, len(out), step):
        yield s, out[s:s + step]


def _add_dimensions(D: np.ndarray, Q: np.ndarray, R: np.ndarray, dims, metric: str) -> None:
    """Add the distances in some dimensions, squared if Euclidean, one dimension after the other."""
    diff = np.empty_like(D)
    for j in dims:
        np.subtract(Q[:, j, None], R[None, :, j], out=diff)
        if metric == "manhattan":
            np.abs(diff, out=diff)
        else:
            np.multiply(diff, diff, out=diff)
        D += diff


def _manhattan_candidates(Q: np.ndarray, R: np.ndarray, k: int, most: np.ndarray | None, own: np.ndarray | None):
    """(query, reference) pairs that hold the k nearest references, of those within ``most``.

    Distances grow with every dimension: the widest come first, and once few pairs are left within
    ``most`` the others are not looked at any more.  ``own`` is a reference that does not count."""
    wide = np.argsort(-R.var(axis=0), kind="stable")
    columns = np.asfortranarray(R)
    qs, rs = [], []
    for s, D in _tiles(np.zeros((len(Q), len(R)))):
        part = Q[s:s + len(D)]
        cap = most[s:s + len(D)] * (1 + SLACK) if most is not None else np.full(len(D), np.inf)
        for at in range(0, len(wide), 8):
            _add_dimensions(D, part, columns, wide[at:at + 8], "manhattan")
            within = D <= cap[:, None]
            if 8 * np.count_nonzero(within) < D.size:
                break
        else:
            if own is not None:
                mine = np.flatnonzero(own[s:s + len(D)] >= 0)
                D[mine, own[s + mine]] = np.inf
            if np.count_nonzero(within) > 4 * k * len(D):
                cap = np.minimum(cap, np.partition(D, k - 1, axis=1)[:, k - 1] * (1 + SLACK))
                within = D <= cap[:, None]
        q, r = np.nonzero(within)
        qs.append(q + s)
        rs.append(r)
    return np.concatenate(qs), np.concatenate(rs)


def _exact_pairs(Q: np.ndarray, R: np.ndarray, qi: np.ndarray, ri: np.ndarray,
                 metric: str) -> np.ndarray:
    """Exact distances of selected (query, reference) pairs, same summation order
    as ``pair_distances``."""
    acc = np.zeros(len(qi))
    step = 262_144                       # pairs per chunk: bounded temporary memory
    for s0 in range(0, len(qi), step):
        # gather whole rows (contiguous), then walk dimensions in order
        D = (Q[qi[s0:s0 + step]] - R[ri[s0:s0 + step]]).T.copy()
        a = np.zeros(D.shape[1])
        for j in range(D.shape[0]):
            a += np.abs(D[j]) if metric == "manhattan" else D[j] * D[j]
        acc[s0:s0 + step] = a
    return acc if metric == "manhattan" else np.sqrt(acc)


def local_topk(qk: np.ndarray, Q: np.ndarray, rk: np.ndarray, R: np.ndarray, k: int,
               metric: str, exclude_self: bool, chunk: int | None = None, most: np.ndarray | None = None) -> pd.DataFrame:
    """k best references per query row, ordered by (exact distance, key).

    ``most`` bounds the distances that a query asks for (ties included).

    Euclidean: a BLAS pass (‖q‖² + ‖r‖² − 2q·r) with a per-pair rounding bound
    E finds, per row, every reference whose lower bound A − E is at most the
    k-th smallest upper bound A + E; only those candidates get the exact
    distance, so the result equals brute force.
    """
    outs_q, outs_r, outs_d = [], [], []
    if len(qk) == 0 or len(rk) == 0:
        return pd.DataFrame({"q": [], "r": [], "dist": []})
    rk_order = np.argsort(rk, kind="stable")
    rk_sorted = rk[rk_order]
    kk = min(k, len(rk))
    if metric != "manhattan":
        r2 = np.einsum("ij,ij->i", R, R)
        # one product gives ‖r‖²(1 − REL_ERR) − 2q·r, the lower bound of d² but for ‖q‖²
        R2 = np.empty((R.shape[1] + 1, len(R)))
        np.multiply(R.T, -2.0, out=R2[:-1])
        R2[-1] = r2 * (1.0 - REL_ERR)
    chunk = chunk or max(1, min(1024, CELLS // len(rk), max(64, 4 * TILE // len(rk))))
    for s in range(0, len(qk), chunk):
        qs, Qc = qk[s:s + chunk], Q[s:s + chunk]
        asks = most[s:s + chunk] if most is not None else None
        own = None
        if exclude_self:
            # the query's own column, found by sorted search (no dense compare)
            pos = np.minimum(np.searchsorted(rk_sorted, qs), len(rk_sorted) - 1)
            own = np.where(rk_sorted[pos] == qs, rk_order[pos], -1)
        if metric == "manhattan":
            qi, ri = _manhattan_candidates(Qc, R, kk, asks, own)
        else:
            q2 = np.einsum("ij,ij->i", Qc, Qc)
            B = np.column_stack([Qc, np.ones(len(Qc))]) @ R2
            if exclude_self:
                B[np.flatnonzero(own >= 0), own[own >= 0]] = np.inf
            # |A − d²| ≤ E = REL_ERR·(‖q‖² + ‖r‖²) + ABS_ERR.  Over the k smallest A
            # the largest A + E bounds the true k-th distance from above; a row is
            # a candidate iff its lower bound A − E is below that cap.
            # Where ``most`` leaves few, it is the cap.
            cap = asks ** 2 * (1 + SLACK) if asks is not None else None
            within = B <= (cap + REL_ERR * q2 + ABS_ERR - q2)[:, None] if cap is not None else None
            if within is None or np.count_nonzero(within) > 4 * kk * len(qs):
                S = np.argpartition(B, kk - 1, axis=1)[:, :kk]
                BS = np.take_along_axis(B, S, axis=1) + q2[:, None]
                best = (BS + REL_ERR * (q2[:, None] + 2.0 * r2[S]) + ABS_ERR).max(axis=1)
                cap = best if cap is None else np.minimum(cap, best)
                within = B <= (cap + REL_ERR * q2 + ABS_ERR - q2)[:, None]
            qi, ri = np.nonzero(within)
        dd = _exact_pairs(Qc, R, qi, ri, metric)
        if asks is not None:
            ok = dd <= asks[qi]
            qi, ri, dd = qi[ok], ri[ok], dd[ok]
        if exclude_self:
            dd[qs[qi] == rk[ri]] = np.inf
        # rank candidates per query row by (exact distance, key); keep k
        order = np.lexsort((rk[ri], dd, qi))
        qi, ri, dd = qi[order], ri[order], dd[order]
        first = np.searchsorted(qi, qi, side="left")
        pos = np.arange(len(qi)) - first
        keep = pos < kk
        qi, ri, dd = qi[keep], ri[keep], dd[keep]
        fin = np.isfinite(dd)
        outs_q.append(qs[qi[fin]])
        outs_r.append(rk[ri[fin]])
        outs_d.append(dd[fin])
    if not outs_q:
        return pd.DataFrame({"q": [], "r": [], "dist": []})
    return pd.DataFrame({"q": np.concatenate(outs_q), "r": np.concatenate(outs_r),
                         "dist": np.concatenate(outs_d)})


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list<double> column as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(q: np.ndarray, p: np.ndarray, r: np.ndarray, dist: np.ndarray, k: int, distinct: bool = False):
    """The k rows of least (dist, r) of each query, in that order; if ``distinct``, a row found twice counts once."""
    order = np.lexsort((p, r, dist, q))
    q, p, r, dist = q[order], p[order], r[order], dist[order]
    new = np.ones(len(q), bool)
    if distinct:
        new[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1]) | (dist[1:] != dist[:-1])
    place = np.cumsum(new)
    keep = new & (place - place[np.searchsorted(q, q, "left")] < k)
    return q[keep], p[keep], r[keep], dist[keep]


def _of_points(q: np.ndarray, at: np.ndarray, dist: np.ndarray, pid: np.ndarray, ends: np.ndarray, flat: np.ndarray, k: int):
    """(q, p, r, dist): the k nearest rows of each query among its points ``at`` (by q, then dist).

    A point stands for its rows.  Points behind k nearer rows are left out first, and the others
    are expanded for so many queries at a time that about ``CELLS`` rows are held.
    """
    copies = (ends[1:] - ends[:-1])[at]
    if not len(q) or copies.max() == 1:
        return q, pid[at], flat[ends[at]], dist
    before = np.cumsum(copies) - copies
    start = np.searchsorted(q, q, "left")
    tie = np.ones(len(q), bool)
    tie[1:] = (q[1:] != q[:-1]) | (dist[1:] != dist[:-1])
    first = np.maximum.accumulate(np.where(tie, np.arange(len(q)), 0))
    keep = before[first] - before[start] < k
    q, at, dist, copies = q[keep], at[keep], dist[keep], copies[keep]
    total, edge = np.cumsum(copies), np.append(np.flatnonzero(np.append(True, q[1:] != q[:-1])), len(q))
    out, i = [], 0
    while i < len(edge) - 1:
        done = total[edge[i] - 1] if edge[i] else 0
        j = max(i + 1, int(np.searchsorted(total[edge[1:] - 1], done + CELLS, "right")))
        x = slice(edge[i], edge[j])
        n = copies[x]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(_best(np.repeat(q[x], n), np.repeat(pid[at[x]], n), flat[np.repeat(ends[at[x]], n) + inner], np.repeat(dist[x], n), k))
        i = j
    return tuple(np.concatenate(c) for c in zip(*out))


PACKED = "q long, p array<long>, r array<long>, dist array<double>"


def _packed(q: np.ndarray, p: np.ndarray, r: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    """One row per query of neighbours that are sorted by query."""
    edge = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    ends = pa.array(np.append(edge, len(q)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((p, pa.int64()), (r, pa.int64()), (dist, pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array(q[edge], pa.int64()), *lists], names=["q", "p", "r", "dist"])


def _points_of(table: pa.Table, names: Sequence[str]):
    """Keys, vectors and row lists (ends, keys) of a block of points."""
    pid, vec, keys = (table.column(n).combine_chunks() for n in names)
    return pid.to_numpy(), matrix(vec), keys.offsets.to_numpy(), keys.values.to_numpy()


def _near_points(qi: np.ndarray, Q: np.ndarray, pid: np.ndarray, R: np.ndarray, ends: np.ndarray, flat: np.ndarray, k: int, metric: str, most):
    """(q, p, r, dist) of the k nearest rows among the points, for queries numbered ``qi`` in ascending order."""
    best = local_topk(qi, Q, pid, R, k, metric, False, most=most)
    q, p, dist = (best[n].to_numpy() for n in ("q", "r", "dist"))
    by = np.argsort(pid, kind="stable")
    at = by[np.searchsorted(pid[by], p.astype(np.int64))]
    return _of_points(q.astype(np.int64), at, dist, pid, ends, flat, k)


def _bounds(column: pa.ChunkedArray) -> np.ndarray:
    most = column.combine_chunks().to_numpy(zero_copy_only=False).astype(float)
    return np.where(np.isnan(most), np.inf, most)


def search_blocks(queries: DataFrame, refs: DataFrame, block: str, k: int, metric: str) -> DataFrame:
    """Packed neighbours (see ``PACKED``): the k best rows of each block for each of its queries.

    ``queries`` is (block, pid, vec) and may hold ``bound``, the distance up to which a query asks;
    ``refs`` is (block, pid, vec, keys).  The k best rows lie among the k best points by (distance,
    smallest key).
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_packed(*[np.zeros(0)] * 4)]
        if len(left) and len(right):
            qk, Q = left.column("q_pid").combine_chunks().to_numpy(), matrix(left.column("q_vec").combine_chunks())
            most = _bounds(left.column("q_bound"))
            points = _points_of(right, ("r_pid", "r_vec", "r_keys"))
            step = max(1, CELLS // k)
            for s in range(0, len(qk), step):
                x = slice(s, s + step)
                q, p, r, dist = _near_points(np.arange(len(qk[x])), Q[x], *points, k, metric, most[x] if np.isfinite(most[x]).any() else None)
                out.append(_packed(qk[x][q], p, r, dist))
        return pa.Table.from_batches(out)

    # both sides may come from one table: new names keep their columns apart
    bound = F.col("bound") if "bound" in queries.columns else F.lit(None).cast("double")
    left = queries.select(F.col(block).alias("q_block"), F.col("pid").alias("q_pid"), F.col("vec").alias("q_vec"), bound.alias("q_bound"))
    right = refs.select(F.col(block).alias("r_block"), F.col("pid").alias("r_pid"), F.col("vec").alias("r_vec"), F.col("keys").alias("r_keys"))
    return left.groupBy("q_block").cogroup(right.groupBy("r_block")).applyInArrow(run, PACKED)


def merged(found: DataFrame, k: int, distinct: bool = False) -> DataFrame:
    """The k best of each query in one packed row; if ``distinct``, a row found twice counts once."""
    def run(batches):
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        for whole in batches:
            for s in range(0, len(whole), 2048):
                batch = whole.slice(s, 2048)
                n = np.diff(batch.column("dist").offsets.to_numpy())
                mine = [np.repeat(batch.column("q").to_numpy(), n)] + [batch.column(x).flatten().to_numpy() for x in ("p", "r", "dist")]
                rows = _best(*[np.concatenate(x) for x in zip(held, mine)], k, distinct)
                if len(rows[0]):  # the last query may go on in the next batch
                    last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
                    yield _packed(*[x[:last] for x in rows])
                    held = [x[last:] for x in rows]
        yield _packed(*held)

    return found.repartition("q").sortWithinPartitions("q").mapInArrow(run, PACKED)


def exploded(near: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """(q, p, r, dist, rank) of packed neighbours, the ``first`` to the ``last``; ranks count from 1 again."""
    x = F.arrays_zip("p", "r", "dist")
    if last is not None:
        x = F.slice(x, first, last - first + 1)
    return near.select("q", F.posexplode(x).alias("i", "x")).select("q", "x.p", "x.r", "x.dist", (F.col("i") + 1).alias("rank"))


def _plain(query: DataFrame, ref: DataFrame, nq: int, nr: int, k: int, metric: str, block_rows: int) -> DataFrame:
    """One cell: every block of queries meets every block of points."""
    bq, br = max(1, math.ceil(nq / block_rows)), max(1, math.ceil(nr / block_rows))
    mine = F.pmod(F.xxhash64("pid"), F.lit(bq)) * br
    theirs = F.pmod(F.xxhash64("pid"), F.lit(br))
    q = query.withColumn("block", F.explode(F.sequence(mine, mine + (br - 1))))
    r = ref.withColumn("block", F.explode(F.sequence(theirs, theirs + (bq - 1) * br, F.lit(br).cast("long"))))
    return merged(search_blocks(q, r, "block", k, metric), k)


def wide_rows(block_rows: int, n_query: int, n_ref: int, dims: int) -> int:
    """Rows of a block where both sides are large: few copies, bounded bytes, 256 pairs of blocks or more."""
    return max(block_rows, min(BLOCK_BYTES // (8 * dims + 16), int(math.sqrt(n_query * n_ref) / 16)))


def ring_groups(pivots: np.ndarray, cell: np.ndarray, points: np.ndarray, wide: int) -> np.ndarray:
    """Group of each ring: rings of near pivots, at most ``wide`` points (or one ring) to a group."""
    group, number, todo = np.zeros(len(cell), np.int64), 0, [np.arange(len(cell))]
    while todo:
        part = todo.pop()
        if len(part) == 1 or points[part].sum() <= wide:
            group[part], number = number, number + 1
            continue
        X = pivots[cell[part]]
        part = part[np.lexsort((part, X[:, X.var(axis=0).argmax()]))]
        total = np.cumsum(points[part])
        half = min(max(int(np.searchsorted(total, total[-1] / 2)), 1), len(part) - 1)
        todo += [part[:half], part[half:]]
    return group


class PivotSearch:
    """Exact search of ``query`` points among ``ref`` points by pivots and rings.

    ``visits`` counts the (query, ring) pairs that the bounds leave, ``pairs`` all of them;
    ``pruned`` says whether that is less than half of the (query, point) pairs.  ``copies`` counts
    the (query, group) pairs of both rounds, so the vectors that are shuffled.
    """

    def __init__(self, query: DataFrame, ref: DataFrame, n_ref: int, k: int, metric: str, block_rows: int, seed: int):
        self.spark, self.k, self.metric = ref.sparkSession, k, metric
        n = min(MAX_PIVOTS, math.ceil(math.sqrt(n_ref)))
        drawn = ref.orderBy(F.xxhash64(F.lit(seed), "pid"), "pid").limit(n).select("vec").collect()
        self.pivots = np.array([r["vec"] for r in drawn], float)
        query, ref = cut_lineage(query.select("pid", "vec")), self._ringed(cut_lineage(self._placed(ref)))
        self.rings = sorted(tuple(r) for r in ref.groupBy("cell", "ring").agg(
            F.min("away").alias("lo"), F.max("away").alias("hi"), F.count("*").alias("points")).collect())
        n_query = query.count()
        cell, points = (np.array([r[i] for r in self.rings]) for i in (0, 4))
        self.wide = wide_rows(block_rows, n_query, int(points.sum()), self.pivots.shape[1])
        self.group = ring_groups(self.pivots, cell, points, self.wide)
        self.parts = [math.ceil(points[self.group == g].sum() / self.wide) for g in range(int(self.group.max()) + 1)]
        numbers = self.spark.createDataFrame(
            [(i, r[0], r[1], int(g), self.parts[g]) for i, (r, g) in enumerate(zip(self.rings, self.group))], "unit int, cell int, ring int, grp int, parts int")
        self.ref = ref.join(F.broadcast(numbers), ["cell", "ring"]).select(
            "pid", "vec", "keys", "unit", "grp", F.pmod(F.xxhash64("pid"), F.col("parts")).alias("rp"))
        self.shared = self.spark.sparkContext.broadcast((self.pivots, cell, *(np.array([r[i] for r in self.rings]) for i in (2, 3)), self.group))
        self.pairs, self.visits, self.copies = n_query * len(self.rings), n_query, 0
        first = cut_lineage(merged(self._round(*self._counts(query)[:2]), k))
        known = first.select("q", F.when(F.size("dist") == k, F.element_at("dist", -1)).alias("bound"))
        bounded = cut_lineage(query.join(known, F.col("pid") == F.col("q"), "left").drop("q"))
        sent, asked, met = self._counts(bounded)
        self.visits += sum(met.values())
        self.pruned = 2 * sum(m * points[u] for u, m in met.items()) < n_query * points.sum()
        self.near = merged(first.unionByName(self._round(sent, asked)), k) if asked else first
        self.entries = exploded(self.near)

    def _placed(self, ref: DataFrame) -> DataFrame:
        pivots, metric = self.spark.sparkContext.broadcast(self.pivots), self.metric

        def run(batches):
            step = max(1, CELLS // len(pivots.value))
            for batch in (whole.slice(s, step) for whole in batches for s in range(0, len(whole), step)):
                X = matrix(batch.column(1))
                D = pair_distances(X, pivots.value, metric)
                cell = D.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(D[np.arange(len(X)), cell])],
                                                 names=[*batch.schema.names, "cell", "away"])

        return ref.select("pid", "vec", "keys").mapInArrow(run, "pid long, vec array<double>, keys array<long>, cell int, away double")

    def _ringed(self, ref: DataFrame) -> DataFrame:
        """Rings of ``RING_ROWS`` points or more, at most MAX_RINGS to a cell, by quantiles of the distance to the pivot."""
        share = [i / MAX_RINGS for i in range(1, MAX_RINGS)]
        cells = ref.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("away", share, 10_000).alias("cuts")).collect()
        table = []
        for r in cells:
            rings = min(MAX_RINGS, math.ceil(r["n"] / (2 * RING_ROWS)))
            table.append((r["cell"], sorted({r["cuts"][MAX_RINGS * i // rings - 1] for i in range(1, rings)})))
        cuts = self.spark.createDataFrame(table, "cell int, cuts array<double>")
        above = F.size(F.filter("cuts", lambda x: F.col("away") > x))
        return ref.join(F.broadcast(cuts), "cell").withColumn("ring", above).drop("cuts")

    def _asked(self, query: DataFrame) -> DataFrame:
        """(pid, vec, base, bound, grps): the groups that each query asks, ``base`` being its distance to the nearest pivot.

        Without bounds this is the group of the most promising ring, with them all others that hold a
        ring within the bound.  Then rows (unit, n) with no pid: how many queries of a piece ask a ring.
        """
        sent, metric, bounded = self.shared, self.metric, "bound" in query.columns

        def run(batches):
            pivots, cell, lo, hi, group = sent.value
            step = max(1, CELLS // len(cell))
            one = np.zeros((len(cell), group.max() + 1), np.float32)
            one[np.arange(len(cell)), group] = 1
            for batch in batches:
                for s in range(0, len(batch), step):
                    part = batch.slice(s, step)
                    D = pair_distances(matrix(part.column(1)), pivots, metric)
                    base = D.min(axis=1)
                    away, low = _lower(D, base, cell, lo, hi)
                    home = group[np.lexsort((away, low), axis=1)[:, 0] if low.shape[1] <= 256 else low.argmin(axis=1)]
                    rings = None
                    if bounded:
                        most = part.column(2).to_numpy(zero_copy_only=False).astype(float)
                        most = np.where(np.isnan(most), np.inf, most)
                        rings = _within(low, most[:, None])
                        need = rings.astype(np.float32) @ one > 0
                        need[np.arange(len(home)), home] = False
                    else:
                        most = np.full(len(home), np.inf)
                        need = np.zeros((len(home), one.shape[1]), bool)
                        need[np.arange(len(home)), home] = True
                    q, g = np.nonzero(need)
                    grps = pa.ListArray.from_arrays(pa.array(np.searchsorted(q, np.arange(len(home) + 1)), pa.int32()), pa.array(g, pa.int32()))
                    yield record([part.column(0), part.column(1), pa.array(base), pa.array(most), grps], len(part))
                    if bounded:
                        n = rings.sum(axis=0)
                        u = np.flatnonzero(n)
                        yield record([None] * 5 + [pa.array(u, pa.int32()), pa.array(n[u], pa.int64())], len(u))

        def record(columns, n):
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) if x is None else x.cast(t) for x, t in zip([*columns, None, None], kinds)], names=names)

        names = ["pid", "vec", "base", "bound", "grps", "unit", "n"]
        kinds = [pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.int32(), pa.int64()]
        return query.mapInArrow(run, "pid long, vec array<double>, base double, bound double, grps array<int>, unit int, n long")

    def _counts(self, query: DataFrame) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
        """What the queries ask (see ``_asked``, found once), and how many ask each group and each ring (one number each reaches the driver)."""
        held = cut_lineage(self._asked(query))
        asked = {r["grp"]: r["n"] for r in held.select(F.explode("grps").alias("grp")).groupBy("grp").agg(F.count("*").alias("n")).collect()}
        self.copies += sum(asked.values())
        return held, asked, {r["unit"]: r["n"] for r in held.filter("unit IS NOT NULL").groupBy("unit").agg(F.sum("n").alias("n")).collect()}

    def _round(self, held: DataFrame, counts: dict[int, int]) -> DataFrame:
        """Search the asked groups, in blocks of at most ``wide`` queries and points."""
        sent, k, metric = self.shared, self.k, self.metric

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [_packed(*[np.zeros(0)] * 4)]
            if len(left) and len(right):
                pivots, cell, lo, hi, _ = sent.value
                unit = right.column("r_unit").combine_chunks().to_numpy()
                rings = np.unique(unit)
                points = [_points_of(right.filter(pa.array(unit == u)), ("r_pid", "r_vec", "r_keys")) for u in rings]
                near, at = np.unique(cell[rings], return_inverse=True)
                qk, Q = left.column("q_pid").combine_chunks().to_numpy(), matrix(left.column("q_vec").combine_chunks())
                base, most = left.column("q_base").combine_chunks().to_numpy(), _bounds(left.column("q_bound"))
                step = max(1, min(CELLS // (4 * k), CELLS // len(rings), 4096))
                for s in range(0, len(qk), step):
                    x = slice(s, s + step)
                    away, low = _lower(pair_distances(Q[x], pivots[near], metric), base[x], at, lo[rings], hi[rings])
                    q, p, r, dist = _ring_search(Q[x], most[x], away, low, points, k, metric)
                    out.append(_packed(qk[x][q], p, r, dist))
            return pa.Table.from_batches(out)

        size = self.spark.createDataFrame([(g, math.ceil(n / self.wide), self.parts[g]) for g, n in counts.items()], "grp int, q_parts int, r_parts int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        block = F.struct("grp", F.col("qp").cast("int").alias("qp"), F.col("rp").cast("int").alias("rp"))
        sent_to = held.filter("pid IS NOT NULL").select("pid", "vec", "base", "bound", F.explode("grps").alias("grp"))
        q = sent_to.join(F.broadcast(size), "grp").withColumn("qp", F.pmod(F.xxhash64("pid"), F.col("q_parts"))).withColumn("rp", every("r_parts"))
        r = self.ref.join(F.broadcast(size.select("grp", "q_parts")), "grp").withColumn("qp", every("q_parts"))
        left = q.select(block.alias("q_block"), *[F.col(c).alias("q_" + c) for c in ("pid", "vec", "base", "bound")])
        right = r.select(block.alias("r_block"), *[F.col(c).alias("r_" + c) for c in ("pid", "vec", "keys", "unit")])
        # a block is much work: so many partitions that most hold one block or none, and cores do not wait for a few
        blocks = sum(math.ceil(n / self.wide) * self.parts[g] for g, n in counts.items())
        spread = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), min(4 * blocks, MAX_SPREAD))
        return left.repartition(spread, "q_block").groupBy("q_block").cogroup(right.repartition(spread, "r_block").groupBy("r_block")).applyInArrow(run, PACKED)


def _lower(D: np.ndarray, base: np.ndarray, cell: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the rings' pivots and lower bounds of the distances to the rings."""
    away = D[:, cell]
    low = np.maximum(lo - away, away - hi)
    return away, np.maximum(low, (away - base[:, None]) / 2, out=low)


def _within(low: np.ndarray, most: np.ndarray) -> np.ndarray:
    return low * (1 - SLACK) <= most * (1 + SLACK)


def _ring_search(Q: np.ndarray, most: np.ndarray, away: np.ndarray, low: np.ndarray, points: list, k: int, metric: str):
    """(q, p, r, dist): the k nearest rows within ``most`` of the queries 0.. among the rings' points.

    Queries without a bound get one from their most promising rings first.
    """
    found, pending, bound = [], 0, most.copy()

    def visit(u: int, asks: np.ndarray) -> None:
        nonlocal pending
        qi = np.flatnonzero(asks)
        if len(qi):
            found.append(_near_points(qi, Q[qi], *points[u], k, metric, bound[qi] if np.isfinite(bound[qi]).any() else None))
            pending += len(found[-1][0])
            if pending > CELLS:
                settle()

    def settle() -> None:
        nonlocal pending
        if not found:
            found.append((np.zeros(0, np.int64),) * 3 + (np.zeros(0),))
        best = _best(*[np.concatenate(x) for x in zip(*found)], k)
        last = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], True)) if len(best[0]) else np.zeros(0, np.int64)
        full = last[np.bincount(best[0], minlength=len(Q))[best[0][last]] == k]
        bound[best[0][full]] = np.minimum(bound[best[0][full]], best[3][full])
        found[:], pending = [best], 0

    open_ = np.isinf(bound)
    home = np.zeros(low.shape, bool)
    if open_.any():
        home[open_] = _promising(low[open_], away[open_], np.array([len(x[3]) for x in points]), k)
        for u in range(len(points)):
            visit(u, home[:, u])
        settle()
    for u in np.argsort(low.min(axis=0), kind="stable"):
        visit(u, _within(low[:, u], bound) & ~home[:, u])
    settle()
    return found[0]


def _promising(low: np.ndarray, away: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """Per query the rings of least lower bound (then nearest pivot) that hold k rows together."""
    home = np.zeros(low.shape, bool)
    best = np.lexsort((away, low), axis=1)[:, 0] if low.shape[1] <= 256 else low.argmin(axis=1)
    home[np.arange(len(low)), best] = True
    for i in np.flatnonzero(held[best] < k):
        order = np.lexsort((away[i], low[i]))
        home[i, order[:1 + int(np.searchsorted(np.cumsum(held[order]), k))]] = True
    return home


def packed_entries(query: DataFrame, ref: DataFrame, k: int, metric: str, n_query: int, n_ref: int, block_rows: int = 20000, seed: int = 42,
                   mode: str = "exact", recall: float = 0.95) -> DataFrame:
    """``entries`` as one row per query point: (q, p, r, dist), three arrays in order of rank."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if mode == "approx":
        from .lsh import ProjectionSearch
        return ProjectionSearch(query, ref, n_ref, k, metric, block_rows=block_rows, seed=seed, recall=recall).near
    if mode != "exact":
        raise ValueError("mode must be exact or approx")
    if n_ref <= PLAIN_ROWS:
        return _plain(query, ref, n_query, n_ref, k, metric, block_rows)
    return PivotSearch(query, ref, n_ref, k, metric, block_rows, seed).near


def entries(query: DataFrame, ref: DataFrame, k: int, metric: str, n_query: int, n_ref: int, block_rows: int = 20000, seed: int = 42,
            mode: str = "exact", recall: float = 0.95) -> DataFrame:
    """(q, p, r, dist, rank): the k nearest rows r (of point p) of each query point; see ``points``."""
    return exploded(packed_entries(query, ref, k, metric, n_query, n_ref, block_rows, seed, mode, recall))


def knn(query: DataFrame, ref: DataFrame, k: int, metric: str = "euclidean",
        exclude_self: bool = False, block_rows: int = 20000, seed: int = 42,
        n_query: int | None = None, n_ref: int | None = None, mode: str = "exact", recall: float = 0.95) -> DataFrame:
    """k nearest reference rows for every query row.

    Inputs are ``(key long, vec array<double>)`` (see ``as_vector``).  Returns ``(q, r, dist,
    rank)`` with rank 1..k ordered by (dist, r).  ``exclude_self`` drops ``q == r`` pairs
    (fitting on the reference set itself).  ``mode="approx"`` finds about ``recall`` of them.
    """
    nq = n_query if n_query is not None else query.count()
    nr = n_ref if n_ref is not None else ref.count()
    most = k + 1 if exclude_self else k
    rp = points(ref, most)
    qp = rp if query is ref else points(query, 1)
    lists = packed_entries(qp, rp, most, metric, nq, nr, block_rows, seed, mode, recall).select("q", F.arrays_zip("dist", "r").alias("near"))
    mine = F.filter("near", lambda x: x["r"] != F.col("key")) if exclude_self else F.col("near")
    rows = query.join(qp.select("pid", F.col("vec").alias("at")), F.col("vec") == F.col("at")) \
        .join(lists, F.col("pid") == F.col("q")).select("key", F.slice(mine, 1, k).alias("near"))
    return rows.select(F.col("key").alias("q"), F.posexplode("near").alias("i", "x")) \
        .select("q", F.col("x")["r"].alias("r"), F.col("x")["dist"].alias("dist"), (F.col("i") + 1).alias("rank"))
