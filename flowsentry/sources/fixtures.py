"""The ``flows`` test table and its variants, derived from the driver's ``lineitem``.

One flow per ``l_orderkey`` and one packet per line item.  This module only
shapes test input into the network-flow schema the library works on; it does
none of the library's own work.  The definition is fixed by ``FIXTURES.md``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Columns that are not model features.
KEY = "flow_id"
ORDER_COLS = ["first_day", "flow_id"]
META_COLUMNS = ["flow_id", "first_day", "domain"]
LABEL = "Label"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _packets(lineitem: DataFrame) -> DataFrame:
    # Per-flow order of packets; a flow is one order (a handful of lines), so
    # this window's partitions stay small whatever the table size.
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    day = F.col("l_shipdate").cast("date")
    return lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag",
        day.alias("day"),
        (F.col("l_linestatus") == "O").alias("fwd"),
        F.col("l_quantity").alias("q"),
        (F.lit(20) + F.lit(4) * F.col("l_linenumber")).alias("hdr"),
        F.round(F.col("l_discount") * 100).cast("int").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
        F.datediff(day, F.lag(day).over(w)).alias("gap"),
    )


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("double")


def _r6(c: Column) -> Column:
    return F.round(c, 6)


def _flow_columns() -> list[Column]:
    fwd, q, hdr, gap = F.col("fwd"), F.col("q"), F.col("hdr"), F.col("gap")
    bwd = ~fwd
    act = gap <= 180
    idle = gap > 180
    z = F.lit(0)
    return [
        F.min("day").alias("first_day"),
        _count_if(fwd).alias("Soma Fwd Packets"),
        _count_if(bwd).alias("Subflow Bwd Packets"),
        F.sum(F.when(fwd, q).otherwise(0)).cast("double").alias("Soma Length of Fwd Packets"),
        F.sum(F.when(fwd, q).otherwise(0)).cast("double").alias("Subflow Fwd Bytes"),
        F.sum(F.when(fwd, 0).otherwise(q)).cast("double").alias("Subflow Bwd Bytes"),
        _r6(F.avg(q)).alias("Packet Length Mean"),
        _r6(F.coalesce(F.stddev_samp(q), z)).alias("Packet Length Std"),
        F.min(q).alias("Min Packet Length"),
        F.max(q).alias("Max Packet Length"),
        _r6(F.coalesce(F.avg(F.when(fwd, q)), z)).alias("Fwd Packet Length Mean"),
        _r6(F.coalesce(F.stddev_samp(F.when(fwd, q)), z)).alias("Fwd Packet Length Std"),
        _r6(F.coalesce(F.avg(F.when(bwd, q)), z)).alias("Bwd Packet Length Mean"),
        _r6(F.coalesce(F.stddev_samp(F.when(bwd, q)), z)).alias("Bwd Packet Length Std"),
        F.sum(F.when(fwd, hdr).otherwise(0)).cast("double").alias("Fwd Header Length"),
        F.sum(F.when(fwd, 0).otherwise(hdr)).cast("double").alias("Bwd Header Length"),
        _count_if(fwd & (q > 10)).alias("act_data_pkt_fwd"),
        F.coalesce(F.min(F.when(fwd, hdr)), z).cast("double").alias("min_seg_size_forward"),
        (F.coalesce(F.sum(gap), z).cast("double") * F.lit(86400000000)).alias("Flow Duration"),
        _r6(F.coalesce(F.avg(gap), z)).alias("Flow IAT Mean"),
        _r6(F.coalesce(F.stddev_samp(gap), z)).alias("Flow IAT Std"),
        F.coalesce(F.min(gap), z).cast("double").alias("Flow IAT Min"),
        F.coalesce(F.max(gap), z).cast("double").alias("Flow IAT Max"),
        _r6(F.coalesce(F.avg(F.when(fwd, gap)), z)).alias("Fwd IAT Mean"),
        _r6(F.coalesce(F.stddev_samp(F.when(fwd, gap)), z)).alias("Fwd IAT Std"),
        _r6(F.coalesce(F.avg(F.when(bwd, gap)), z)).alias("Bwd IAT Mean"),
        _r6(F.coalesce(F.stddev_samp(F.when(bwd, gap)), z)).alias("Bwd IAT Std"),
        _r6(F.coalesce(F.avg(F.when(act, gap)), z)).alias("Active Mean"),
        _r6(F.coalesce(F.stddev_samp(F.when(act, gap)), z)).alias("Active Std"),
        F.coalesce(F.max(F.when(act, gap)), z).cast("double").alias("Active Max"),
        _r6(F.coalesce(F.avg(F.when(idle, gap)), z)).alias("Idle Mean"),
        _count_if(F.col("tax") == 0).alias("SYN Flag Count"),
        _count_if(F.col("disc") >= 8).alias("PSH Flag Count"),
        _count_if(F.col("l_returnflag") == "A").alias("ACK Flag Count"),
        _count_if(F.col("l_returnflag") == "R").alias("RST Flag Count"),
        _count_if(F.col("tax") == 8).alias("URG Flag Count"),
        _count_if(F.col("l_linenumber") == 7).alias("FIN Flag Count"),
        F.lit(0.0).alias("ECE Flag Count"),
        _count_if(fwd & (F.col("disc") >= 8)).alias("Fwd PSH Flags"),
        _count_if(fwd & (F.col("tax") == 8)).alias("Fwd URG Flags"),
        F.coalesce(F.min(F.when(fwd, F.col("l_partkey"))), F.lit(-1)).cast("double")
        .alias("Init_Win_bytes_forward"),
        F.coalesce(F.min(F.when(bwd, F.col("l_partkey"))), F.lit(-1)).cast("double")
        .alias("Init_Win_bytes_backward"),
        F.when(F.avg(q) > 36, 1).otherwise(0).cast("int").alias("Label"),
    ]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _packets(read_table(spark, sf_dir, "lineitem"))
    agg = p.groupBy("l_orderkey").agg(*_flow_columns())
    return agg.select(
        F.col("l_orderkey").alias("flow_id"), "first_day",
        F.when(F.col("l_orderkey") % 3 == 0, "gen").otherwise("train").alias("domain"),
        *[F.col(f"`{n}`") for n in FLOW_FEATURES], "Label")


FLOW_FEATURES = [
    "Soma Fwd Packets", "Subflow Bwd Packets", "Soma Length of Fwd Packets",
    "Subflow Fwd Bytes", "Subflow Bwd Bytes", "Packet Length Mean", "Packet Length Std",
    "Min Packet Length", "Max Packet Length", "Fwd Packet Length Mean",
    "Fwd Packet Length Std", "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Fwd Header Length", "Bwd Header Length", "act_data_pkt_fwd", "min_seg_size_forward",
    "Flow Duration", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Min", "Flow IAT Max",
    "Fwd IAT Mean", "Fwd IAT Std", "Bwd IAT Mean", "Bwd IAT Std", "Active Mean",
    "Active Std", "Active Max", "Idle Mean", "SYN Flag Count", "PSH Flag Count",
    "ACK Flag Count", "RST Flag Count", "URG Flag Count", "FIN Flag Count",
    "ECE Flag Count", "Fwd PSH Flags", "Fwd URG Flags", "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
]


def flows_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plants +Inf, NaN, NULL and -Inf as ``FIXTURES.md`` §3 fixes them."""
    f = flows(spark, sf_dir)
    fid = F.col("flow_id")
    one_packet = (F.col("`Soma Fwd Packets`") + F.col("`Subflow Bwd Packets`")) == 1
    repl = {
        "Flow Duration": F.when(fid % 97 == 0, F.lit(float("inf")))
        .otherwise(F.col("`Flow Duration`")),
        "Flow IAT Std": F.when(fid % 101 == 0, F.lit(float("nan")))
        .otherwise(F.col("`Flow IAT Std`")),
        "Packet Length Std": F.when(one_packet, F.lit(None).cast("double"))
        .otherwise(F.col("`Packet Length Std`")),
        "Active Max": F.when(fid % 89 == 0, F.lit(float("-inf")))
        .otherwise(F.col("`Active Max`")),
    }
    return f.select(*[repl[c].alias(c) if c in repl else F.col(f"`{c}`") for c in f.columns])


def flows_text_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flows(spark, sf_dir)
    return f.withColumn("Label", F.when(F.col("Label") == 0, "BENIGN").otherwise("ATTACK"))


def flows_missing_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).drop("ECE Flag Count", "Idle Mean")


def flows_wide(spark: SparkSession, sf_dir: str, copies: int = 20) -> DataFrame:
    f = flows(spark, sf_dir)
    rep = f.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rep.withColumn("flow_id", F.col("flow_id") * copies + F.col("_i")).drop("_i")
