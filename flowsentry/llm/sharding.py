"""Sharding by bytes: contiguous shards cut at equal targets of a global prefix sum.

Rows are range-partitioned and sorted by (hash of the text, id); each partition numbers its
rows and sums their sizes; the partitions' totals (one row each) give every row its global
position.  Shard boundaries are the multiples of total / shards, moved to the nearest edge of
the group of equal texts they fall into.  Such a move is made when it costs at most
``max_shift`` of a shard (or less than half a row), so a group of up to twice that share
always stays whole, and a shard is off its equal size by twice that share at most.  Only the
rows at the boundaries and one total per partition reach the driver; nothing is shuffled but
(id, size, checksum, hash).

Inside a larger group of equal texts (it may hold a third of all rows) a boundary goes to the
nearest row, since the id is part of the order.  Defined cases: a null text has 0 bytes and checksum 0;
repeated rows are placed each; null ids sort first; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

ROW_BYTES = 8


def positions(ws: Workspace, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Each row's global index and byte offset in (text hash, id) order, and the total bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("crc"), F.xxhash64(text).alias("grp"))
    n = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "grp", "id", "crc", "size").sortWithinPartitions("grp", "id", "crc", "size")

    def number(batches):
        part, index, offset = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            m = len(size)
            start = offset + np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(m, part, np.int32)),
                 pa.array(np.arange(index, index + m)), pa.array(start[:-1])],
                names=[*batch.schema.names, "part", "local_index", "local_start"])
            index, offset = index + m, int(start[-1])

    kind = dict(rows.dtypes)["id"]
    numbered = ws.save(ordered.mapInArrow(
        number, f"id {kind}, size long, crc long, grp long, part int, local_index long, local_start long"), "numbered")
    totals = numbered.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("part").collect()
    bases, index, start = [], 0, 0
    for r in totals:
        bases.append((r["part"], index, start))
        index, start = index + r["n"], start + r["b"]
    base = ws.spark.createDataFrame(bases, "part int, base_index long, base_start long")
    placed = numbered.join(F.broadcast(base), "part").select(
        "id", "size", "crc", "grp", (F.col("base_index") + F.col("local_index")).alias("index"),
        (F.col("base_start") + F.col("local_start")).alias("start"))
    return placed, start


def cut_points(placed: DataFrame, total: int, shards: int, max_shift: float) -> list[int]:
    """The shards - 1 byte offsets at which a new shard begins."""
    targets = sorted({-(-total * j // shards) for j in range(1, shards)})
    if total == 0:
        return []
    at = F.col("start") <= F.lit(targets[-1])
    hit = F.exists(F.array(*[F.lit(t) for t in targets]),
                   lambda t: (t >= F.col("start")) & (t < F.col("start") + F.col("size")))
    edge = placed.filter(at & hit).select("grp", "start", "size").collect()  # a row per target at most
    groups = {r["grp"]: (r["a"], r["b"]) for r in placed
              .filter(F.col("grp").isin([r["grp"] for r in edge])).groupBy("grp")
              .agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("size")).alias("b")).collect()}
    limit = max_shift * total / shards
    cuts = []
    for j in range(1, shards):
        t = -(-total * j // shards)
        row = next((r for r in edge if r["start"] <= t < r["start"] + r["size"]), None)
        if row is None:
            cuts.append(total)
            continue
        a, b = groups[row["grp"]]
        if min(t - a, b - t) > limit:
            a, b = row["start"], row["start"] + row["size"]
        cuts.append(a if t - a <= b - t else b)
    return cuts


def assign(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, *, shards: int = 24,
           max_shift: float = 0.05) -> DataFrame:
    """(id, size, crc, shard, slot): slot counts from 0 within each shard, in order."""
    ws = Workspace(spark, "shards")
    placed, total = positions(ws, docs, id_col, text_col)
    cuts = cut_points(placed, total, shards, max_shift)
    shard = sum((F.when(F.col("start") >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    sharded = placed.withColumn("shard", shard)
    first = {r["shard"]: r["i"] for r in sharded.groupBy("shard").agg(F.min("index").alias("i")).collect()}
    base = F.lit(0).cast("long")
    for s, i in first.items():
        base = F.when(F.col("shard") == s, F.lit(i).cast("long")).otherwise(base)
    return sharded.select("id", "size", "crc", "shard", (F.col("index") - base).alias("slot"))


def write_shards(docs: DataFrame, id_col: str, placed: DataFrame, path: str) -> None:
    """Write documents as Parquet below ``path/shard=N`` (ids must be unique)."""
    keyed = placed.select(F.col("id").alias(id_col), "shard", "slot")
    docs.join(keyed, id_col).repartition("shard").sortWithinPartitions("shard", "slot") \
        .write.partitionBy("shard").parquet(path)
