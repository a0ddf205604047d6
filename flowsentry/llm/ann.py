"""Approximate nearest neighbours with learned partitions.

1. A bounded sample of the vectors gets its exact neighbour graph (one Spark job).
2. The graph is cut into balanced parts: nodes move to the part that holds most of their
   neighbours while that part has room.
3. A small classifier (one hidden layer) learns the parts of a vector's neighbours.
4. Every vector is stored in its most probable part.  A query goes to its most probable
   parts, as many as it takes to reach ``mass`` of the probability, at least ``least_parts``,
   and is compared with every vector stored there.  The ``first_parts`` most probable ones come
   first; their k-th best score is a floor, and the other parts hand on only vectors that reach
   it, so what a query gathers does not grow with the number of parts.

Parts are split into blocks of bounded size before queries meet them, so a hot part is many
tasks.  Equal vectors are stored once with the smallest k + 1 of their ids: a query of k
neighbours can never return more of them, so a hot vector costs nothing and loses nothing.

Nearness is the largest inner product in double precision; ties go to the smaller id.
Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do those of another length than the most common one; null ids take no part; of
several rows with one id the smallest vector counts; a query with fewer than k candidates
returns them all when the table is so small that all parts are probed; empty tables give no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Shared, Workspace, low_hashes

BLOCK = 4096


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def clean_vectors(rows: DataFrame, id_col: str, vector_col: str, size: int | None = None) -> DataFrame:
    """(id, vec array<double>): one usable vector per id, of ``size`` or the most common length."""
    v = F.col("vec")
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    # x - x is 0 for finite numbers alone
    good = rows.filter(F.col("id").isNotNull() & v.isNotNull()) \
        .filter(F.forall(v, lambda x: F.coalesce(x - x == 0, F.lit(False))) & F.exists(v, lambda x: x != 0))
    good = good.groupBy("id").agg(F.min("vec").alias("vec"))
    if size is None:
        common = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = common["n"] if common else 0
    return good.filter(F.size("vec") == F.lit(size))


# ---------------------------------------------------------------- fitting on the sample


def neighbour_graph(spark: SparkSession, sample: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest sample vectors of each sample vector (exact, in blocks)."""
    n, shared = len(sample), spark.sparkContext.broadcast(sample)
    step = 1024
    starts = spark.createDataFrame([(i,) for i in range(0, n, step)], "at long").repartition(max(1, -(-n // step)), "at")

    def run(batches):
        x = shared.value
        for batch in batches:
            for at in batch.column(0).to_pylist():
                s = x[at:at + step] @ x.T
                s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
                top = np.argpartition(-s, min(k, n - 1) - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_pydict({"at": [at], "near": [top.ravel().astype(np.int32)]},
                                                 schema=pa.schema([("at", pa.int64()), ("near", pa.list_(pa.int32()))]))

    got = starts.mapInArrow(run, "at long, near array<int>").collect()  # sample x k numbers
    return np.vstack([np.array(r["near"]).reshape(-1, min(k, n - 1)) for r in sorted(got, key=lambda r: r["at"])])


def balanced_parts(sample: np.ndarray, graph: np.ndarray, parts: int, *, slack: float = 0.1, rounds: int = 30,
                   seed: int = 7) -> np.ndarray:
    """Part of each node: few cut edges, no part above (1 + slack) of the mean size."""
    n, room = len(sample), int(np.ceil((1 + slack) * len(sample) / parts))
    rng = np.random.default_rng(seed)
    centre = sample[rng.choice(n, parts, replace=False)]
    for _ in range(8):  # rough start: nearest of some means
        near = (sample @ centre.T - 0.5 * (centre ** 2).sum(axis=1)).argmax(axis=1)
        for p in range(parts):
            if (near == p).any():
                centre[p] = sample[near == p].mean(axis=0)
    score = sample @ centre.T - 0.5 * (centre ** 2).sum(axis=1)
    part, left = np.full(n, -1), np.full(parts, room)
    for i in np.argsort(-(score.max(axis=1) - np.median(score, axis=1)), kind="stable"):
        for p in np.argsort(-score[i], kind="stable"):
            if left[p]:
                part[i], left[p] = p, left[p] - 1
                break
    both = np.stack([np.repeat(np.arange(n), graph.shape[1]), graph.ravel().astype(np.int64)], 1)
    both = np.concatenate([both, both[:, ::-1]])
    for _ in range(rounds):
        votes = np.bincount(both[:, 0] * parts + part[both[:, 1]], minlength=n * parts).reshape(n, parts)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())]:
            to = int(votes[i].argmax())
            if left[to] and to != part[i]:
                left[to], left[part[i]] = left[to] - 1, left[part[i]] + 1
                part[i], moved = to, moved + 1
        if moved < n // 500 + 1:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer: vector to part probabilities."""
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_router(sample: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, *, hidden: int = 128,
                 epochs: int = 20, seed: int = 7) -> Router:
    """Cross-entropy against the parts of each vector's neighbours (Adam, mini-batches)."""
    n, d = sample.shape
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1.0)
    target[np.arange(n), part] += 1.0
    target /= target.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    scale = max(float(np.sqrt((sample ** 2).mean())), 1e-12)
    w = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)) / scale, np.zeros(hidden),
         rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            x, y = sample[order[i:i + 256]], target[order[i:i + 256]]
            h = np.maximum(x @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - y) / len(x)
            gh = (g @ w[2].T) * (h > 0)
            grads = [x.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)]
            t += 1
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                rate = 3e-3 * (1 / scale if k == 0 else 1.0)
                w[k] = w[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-12)
    return Router(*w)


# ---------------------------------------------------------------- search


def _routed(vectors: DataFrame, router, mass: float, least: int, top_only: bool) -> DataFrame:
    """Rows repeated for each part they go to, the most probable at place 0 (``top_only``: that one)."""
    kind = dict(vectors.dtypes)["id"]

    def run(batches):
        r = router.value
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(i, BLOCK)
                p = r.probabilities(_matrix(piece.column(1)))
                order = np.argsort(-p, axis=1, kind="stable")
                sums = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
                n = np.ones(len(p), int) if top_only else np.minimum(np.maximum((sums < mass).sum(axis=1) + 1, least), p.shape[1])
                row = np.repeat(np.arange(len(p)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(row)), piece.column(1).take(pa.array(row)),
                     pa.array(order[row, place].astype(np.int32)), pa.array(place.astype(np.int32))],
                    names=["id", "vec", "part", "place"])

    return vectors.mapInArrow(run, f"id {kind}, vec array<double>, part int, place int")


def _search(spark: SparkSession, index: DataFrame, routed: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """(query_id, vec_id, score): for each routed row (id, vec, part, floor) the k best of its part
    that reach its floor (null: none)."""
    kind = dict(index.dtypes)["id"]
    loads = {r["part"]: r["n"] for r in routed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    grid = [(p, -(-sizes[p] // BLOCK), -(-loads[p] // BLOCK)) for p in sorted(sizes.keys() & loads.keys())]
    blocks = F.broadcast(spark.createDataFrame(grid, "part int, cand_blocks int, query_blocks int"))
    # each block of a part's vectors meets each block of its queries in one task
    mine = F.pmod(F.xxhash64("id"), F.col("cand_blocks")).cast("int")
    ours = F.pmod(F.xxhash64("id"), F.col("query_blocks")).cast("int")
    left = index.join(blocks, "part").select("part", mine.alias("cb"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), "id", "vec")
    right = routed.join(blocks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("cand_blocks") - 1)).alias("cb"), ours.alias("qb"),
                                               "id", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))

    def meet(cand: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if not len(cand) or not len(query):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        c, ids = np.stack(cand["vec"].to_numpy()), cand["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        c, ids = c[order], ids[order]
        out = []
        for i in range(0, len(query), 512):
            q, qids = np.stack(query["vec"].to_numpy()[i:i + 512]), query["id"].to_numpy()[i:i + 512]
            floor = query["floor"].to_numpy(float)[i:i + 512]
            s = q @ c.T
            s[qids[:, None] == ids[None, :]] = -np.inf
            m = min(k, s.shape[1])
            kth = np.maximum(-np.partition(-s, m - 1, axis=1)[:, m - 1], floor)
            # the product's rounding depends on the place in the block: take a margin, sum anew row by row
            margin = 1e-12 * (np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max() + np.abs(np.where(np.isfinite(kth), kth, 0)))
            r, j = np.nonzero((s >= (kth - margin)[:, None]) & (s > -np.inf))
            exact = (q[r] * c[j]).sum(axis=1)
            high = exact >= floor[r]
            r, j, exact = r[high], j[high], exact[high]
            best = np.lexsort((ids[j], -exact, r))
            r, j, exact = r[best], j[best], exact[best]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < k
            out.append(pd.DataFrame({"query_id": qids[r[keep]], "vec_id": ids[j[keep]], "score": exact[keep]}))
        return pd.concat(out)

    return left.groupBy("part", "cb", "qb").cogroup(right.groupBy("part", "cb", "qb")) \
        .applyInPandas(meet, f"query_id {kind}, vec_id {kind}, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def nearest(spark: SparkSession, rows: DataFrame, queries: DataFrame, *, id_col: str, vector_col: str, k: int = 20,
            sample_rows: int = 10_000, part_rows: int = 1000, min_parts: int = 8, max_parts: int = 512, mass: float = 0.95,
            least_parts: int = 4, first_parts: int = 8, graph_k: int = 20) -> DataFrame:
    """The k nearest rows found for each query row: query_id, rank, vec_id, score, parts.

    ``queries`` has the same columns as ``rows``; a query is not its own candidate.  The graph
    and the router are fitted on at most ``sample_rows`` vectors (lowest hashed ids); every
    vector is indexed.  ``parts`` is the number of parts the query was sent to.
    """
    ws = Workspace(spark, "ann")
    vectors = ws.save(clean_vectors(rows, id_col, vector_col), "vectors")
    total = vectors.count()
    kind = dict(vectors.dtypes)["id"]
    shape = f"query_id {kind}, rank int, vec_id {kind}, score double, parts int"
    if total == 0:
        return spark.createDataFrame([], shape)
    # equal vectors: the smallest k + 1 ids (the query itself may be one of them)
    same = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("id")
    stored = vectors.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n")
    hashed = vectors.select(F.xxhash64("id").alias("h"), "id", "vec")
    head = low_hashes(hashed, "h", sample_rows).orderBy("h", "id").limit(sample_rows).collect()
    if not head:  # fewer low hashes than any sample can expect: take the lowest
        head = hashed.orderBy("h", "id").limit(1).collect()
    sample = np.array([r["vec"] for r in head], float)
    asked = clean_vectors(queries, id_col, vector_col, sample.shape[1])
    sample = np.unique(sample, axis=0)
    parts = int(min(max_parts, max(min_parts, total // part_rows), max(1, len(sample) // 8)))
    if parts > 1:
        graph = neighbour_graph(spark, sample, min(graph_k, len(sample) - 1))
        part = balanced_parts(sample, graph, parts)
        router = train_router(sample, graph, part, parts)
    else:
        d = sample.shape[1]
        router = Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    shared = Shared(spark, router)
    index = ws.save(_routed(stored, shared, mass, least_parts, True), "index")
    routed = ws.save(_routed(asked, shared, mass, least_parts, False), "routed")
    sizes = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    near = routed.filter(F.col("place") < first_parts).withColumn("floor", F.lit(None).cast("double"))
    near = ws.save(_best(_search(spark, index, near, sizes, k), k).drop("rank"), "near")
    floor = near.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = ws.save(routed.filter(F.col("place") >= first_parts).join(floor, "id", "left"), "rest")
    ranked = _best(near.unionByName(_search(spark, index, rest, sizes, k)), k)
    sent = routed.groupBy("id").agg(F.count("*").cast("int").alias("parts")).withColumnRenamed("id", "query_id")
    return ranked.join(sent, "query_id").select("query_id", F.col("rank").cast("int"), "vec_id", "score", "parts")
