"""Approximate nearest neighbours by random projections, calibrated to a recall (M4, approximate mode).

Each of several tables cuts space by random directions at their medians; the sides a point lies
on are the bits of its bucket.  A query probes the buckets it most nearly belongs to: those whose
differing bits have the least sum of squared margins.  All candidates of a probed bucket get
their exact distance.

How many tables, bits and probes reach the asked recall is measured, not assumed: a bounded
sample of queries is searched exactly, and of all settings that find the share ``recall`` of their
neighbours the one that meets the fewest candidates is taken, among those that copy a query or a
point no more than ``COPIES`` times (or than an exact search of all blocks would, if that is more):
many small buckets save distances, but every probe sends the query once more.  If none meets fewer
candidates than an exact search, the exact search is used.  (Data without any structure need most
buckets.)

The home buckets are searched first.  They bound each query's k-th distance, and the other
probes return only what lies within the bound.

A bucket of more than ``wide`` points is cut into slices by a second projection on one unit
direction.  A neighbour within distance ρ lies within ρ along that direction, so a query visits
the slices within ρ of it, ρ being the ``recall`` quantile of the sample's k-th distances.

Neither points nor candidates are collected: the driver sees ``SAMPLE`` points and queries, and
the buckets that need slices (at most tables x n / ``wide``).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .knn import PLAIN_ROWS, PivotSearch, _plain, exploded, matrix, merged, search_blocks, wide_rows

TABLES = (1, 2, 4, 8)
MAX_BITS = 20
BUCKET_ROWS = 256      # least rows of a bucket, about
FLIPS = 10             # bits that a probe may flip: those of least margin
SAMPLE = 256           # queries of the calibration
MEDIANS = 4096         # points whose projections give the medians
SLICES = 64
COPIES = 32            # of a query or a point that are always allowed


def _masks(bits: int) -> np.ndarray:
    return np.array(list(itertools.product((0, 1), repeat=min(bits, FLIPS))), np.int64)


class Projections:
    """Directions and cuts of all tables."""

    def __init__(self, sample: np.ndarray, tables: int, bits: int, rng: np.random.Generator):
        d = sample.shape[1]
        self.axes = rng.normal(size=(tables, d, bits))
        self.cuts = np.median(sample @ self.axes, axis=1)[:, None, :]
        lines = rng.normal(size=(d, 16))
        lines /= np.linalg.norm(lines, axis=0)
        self.line = lines[:, int((sample @ lines).var(axis=0).argmax())]
        self.tables, self.bits = tables, bits

    def margins(self, X: np.ndarray) -> np.ndarray:
        """(table, row, bit): how far a row lies above (or below) each cut."""
        return X @ self.axes[:self.tables, :, :self.bits] - self.cuts[:self.tables, :, :self.bits]

    def codes(self, margins: np.ndarray) -> np.ndarray:
        return ((margins > 0) * (np.int64(1) << np.arange(self.bits))).sum(axis=2)

    def probes(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(table, row, place): codes in probing order, over all flips of the ``FLIPS`` bits of least margin."""
        weak = np.argsort(np.abs(margins), axis=2)[:, :, :FLIPS]
        least = np.take_along_axis(np.abs(margins), weak, axis=2) ** 2
        masks = _masks(self.bits)
        order = np.argsort(least @ masks.T, axis=2, kind="stable")
        flipped = ((np.int64(1) << weak) @ masks.T)
        return self.codes(margins)[:, :, None] ^ np.take_along_axis(flipped, order, axis=2)


class ProjectionSearch:
    """``entries`` as in ``knn``; ``setting`` is (tables, bits, probes) or None for the exact search.

    ``share`` is the share of all pairs that the setting meets, as calibrated.
    """

    def __init__(self, query: DataFrame, ref: DataFrame, n_ref: int, k: int, metric: str, *, block_rows: int = 20000, seed: int = 42,
                 recall: float = 0.95, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.k, self.metric, self.block_rows = ref.sparkSession, k, metric, block_rows
        query, ref = query.select("pid", "vec"), ref.select("pid", "vec", "keys")
        self.bits = max(1, min(MAX_BITS, math.ceil(math.log2(max(n_ref, 2) / bucket_rows))))
        self.setting = self._calibrated(query, ref, n_ref, seed, recall)
        if self.setting is None:
            self.near = _plain(query, ref, n_ref, n_ref, k, metric, block_rows) if n_ref <= PLAIN_ROWS else \
                PivotSearch(query, ref, n_ref, k, metric, block_rows, seed).near
        else:
            self.maps.tables, self.maps.bits = self.setting[:2]
            self.near = self._search(query, ref)
        self.entries = exploded(self.near)

    def _calibrated(self, query: DataFrame, ref: DataFrame, n_ref: int, seed: int, recall: float):
        order = F.xxhash64(F.lit(seed), "pid")
        base = ref.orderBy(order, "pid").limit(MEDIANS).select("vec").collect()
        asked = query.orderBy(order, "pid").limit(SAMPLE).collect()
        if not base or not asked:
            return None
        base = np.array([r["vec"] for r in base], float)
        self.maps = Projections(base, max(TABLES), self.bits, np.random.default_rng(seed))
        sample = self.spark.createDataFrame(asked, query.schema)
        near = exploded(_plain(sample, ref, len(asked), n_ref, self.k, self.metric, self.block_rows))
        pairs = near.filter(F.col("p") != F.col("q")).join(ref.select(F.col("pid").alias("p"), "vec"), "p").select("q", "dist", "vec").collect()
        if not pairs:
            return None
        row = {r["pid"]: i for i, r in enumerate(asked)}
        at = np.array([row[r["q"]] for r in pairs])
        far = np.zeros(len(asked))
        np.maximum.at(far, at, np.array([r["dist"] for r in pairs]))
        self.radius = float(np.quantile(far, recall))
        self.wide = wide_rows(self.block_rows, n_ref, n_ref, base.shape[1])
        allowed = max(COPIES, 2 * math.ceil(n_ref / self.wide))
        own = self.maps.margins(np.array([r["vec"] for r in asked], float))
        theirs = self.maps.codes(self.maps.margins(np.array([r["vec"] for r in pairs], float)))
        best, self.share = None, 1.0
        for bits in range(1, self.bits + 1):
            self.maps.bits = bits
            probes = self.maps.probes(own[:, :, :bits])
            hit = probes[:, at, :] == (theirs & ((1 << bits) - 1))[:, :, None]
            place = np.where(hit.any(axis=2), hit.argmax(axis=2), 1 << 62)
            for tables in TABLES:
                need = np.sort(place[:tables].min(axis=0))[math.ceil(recall * len(pairs)) - 1]
                share = tables * float(need + 1) / 2 ** bits
                if need < 1 << 62 and share < self.share and self._copies(n_ref, tables, bits, int(need) + 1) <= allowed:
                    best, self.share = (tables, bits, int(need) + 1), share
        return best

    def _copies(self, n: int, tables: int, bits: int, probes: int) -> int:
        """How often the mean query or point is sent, whichever is more, with buckets of equal size."""
        rows = n / 2 ** bits
        return tables * max(probes * math.ceil(rows / self.wide), math.ceil(probes * rows / self.wide))

    def _search(self, query: DataFrame, ref: DataFrame) -> DataFrame:
        # the maps go with the function: executors that lack the package cannot read a broadcast object of its classes
        maps, (tables, _, probes), wide = self.maps, self.setting, self.wide

        def place(batches, first, last, whole):
            """One row per table and probe; the vectors only if ``whole``."""
            for batch in batches:
                for s in range(0, len(batch), 1024):
                    part = batch.slice(s, 1024)
                    X = matrix(part.column(1))
                    margins = maps.margins(X)
                    codes = maps.probes(margins)[:, :, first:last] if last > 1 else maps.codes(margins)[:, :, None]
                    n = codes.shape[2]
                    rows = np.tile(np.repeat(np.arange(len(X)), n), tables)
                    tab, code, side = np.repeat(np.arange(tables, dtype=np.int32), len(X) * n), codes.ravel(), (X @ maps.line)[rows]
                    for i in range(0, len(rows), 8192):
                        x = slice(i, i + 8192)
                        kept = part.columns if whole else part.columns[:1]
                        yield pa.RecordBatch.from_arrays(
                            [*(c.take(pa.array(rows[x])) for c in kept), pa.array(tab[x]), pa.array(code[x]), pa.array(side[x])],
                            names=[*part.schema.names[:len(kept)], "tab", "code", "side"])

        def placed(df, first, last, whole=True):
            kept = dict(df.dtypes) if whole else {"pid": "bigint"}
            return df.mapInArrow(lambda b: place(b, first, last, whole), ", ".join(f"{n} {t}" for n, t in kept.items()) + ", tab int, code long, side double")

        share = [i / SLICES for i in range(1, SLICES)]
        large = placed(ref, 0, 1, False).groupBy("tab", "code").agg(F.count("*").alias("n"), F.percentile_approx("side", share, 10_000).alias("cuts")) \
            .filter(F.col("n") > wide)
        self.sliced = [(x["tab"], x["code"], sorted({x["cuts"][SLICES * i // m - 1] for m in (min(SLICES, math.ceil(2 * x["n"] / wide)),)
                                                     for i in range(1, m)})) for x in large.collect()]
        cuts = F.broadcast(self.spark.createDataFrame(self.sliced, "tab int, code long, cuts array<double>"))

        def slice_of(at):
            return F.coalesce(F.size(F.filter("cuts", lambda x: at > x)), F.lit(0))

        def points(whole):
            return placed(ref, 0, 1, whole).join(cuts, ["tab", "code"], "left") \
                .withColumn("slice", F.when(F.col("cuts").isNull(), 0).otherwise(slice_of(F.col("side")))).drop("cuts")

        def asked(df, first, last, whole):
            low, high = slice_of(F.col("side") - self.radius), slice_of(F.col("side") + self.radius)
            return placed(df, first, last, whole).join(cuts, ["tab", "code"], "left").withColumn("slice", F.explode(
                F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(low, high)))).drop("cuts")

        keys = ["tab", "code", "slice"]
        r_parts = cut_lineage(points(False).groupBy(*keys).agg(F.ceil(F.count("*") / wide).alias("r_parts")))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        block = F.struct("tab", "code", "slice", F.col("qp"), F.col("rp")).alias("block")

        def search(df, first, last):
            q_parts = asked(df.select("pid", "vec"), first, last, False).groupBy(*keys).agg(F.ceil(F.count("*") / wide).alias("q_parts"))
            size = cut_lineage(r_parts.join(q_parts, keys))  # one small row per bucket
            q = asked(df, first, last, True).join(size, keys).withColumn("qp", F.pmod(F.xxhash64("pid"), F.col("q_parts"))).withColumn("rp", every("r_parts"))
            r = points(True).join(size, keys).withColumn("rp", F.pmod(F.xxhash64("pid"), F.col("r_parts"))).withColumn("qp", every("q_parts"))
            return search_blocks(q.select(block, *df.columns), r.select(block, "pid", "vec", "keys"), "block", self.k, self.metric)

        home = cut_lineage(merged(search(query, 0, 1), self.k, True))
        if probes == 1:
            return home
        known = home.select("q", F.when(F.size("dist") == self.k, F.element_at("dist", -1)).alias("bound"))
        bounded = cut_lineage(query.join(known, F.col("pid") == F.col("q"), "left").drop("q"))
        return merged(home.unionByName(search(bounded, 1, probes)), self.k, True)
