"""Spark session and shared-storage helpers.

Everything the library writes (ARFF sinks, lineage cuts) goes below the
folder the cluster names in ``spark.checkpoint.dir``.  The session is only
given a folder of its own when that setting is unset, which is the case for
local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


# Session SQL settings the library relies on.  Constraint propagation is
# exponential on wide projections of aliased CASE expressions under filters
# (the feature / prep plans), and adds nothing here.
LIBRARY_SQL_CONF = {
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    # Joins between two views of one neighbour table (LOF) are on named
    # columns; the dataset-id heuristic flags them as ambiguous.
    "spark.sql.analyzer.failAmbiguousSelfJoin": "false",
}


def tune_session(spark: SparkSession) -> SparkSession:
    for k, v in LIBRARY_SQL_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def default_conf(cpus: int | None = None) -> dict[str, str]:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return {
        "spark.sql.shuffle.partitions": str(max(cpus, 8)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("FLOWSENTRY_DRIVER_MEMORY", "16g"),
        # Broadcast is decided by the library behind explicit size checks;
        # keep Spark's own automatic threshold at its modest default.
        "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
        **LIBRARY_SQL_CONF,
    }


def get_spark(master: str | None = None, app: str = "flowsentry",
              cpus: int | None = None) -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(app)
    if master or not SparkConf().contains("spark.master"):  # spark-submit has named one already
        builder = builder.master(master or f"local[{cpus}]")
    for k, v in default_conf(cpus).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder, setting one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="flowsentry-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh, unique path below the shared folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/flowsentry-{purpose}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
