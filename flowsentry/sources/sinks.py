"""Result sink (S6): metric tables written as Parquet below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_results(results: dict[str, DataFrame], path: str, mode: str = "overwrite") -> dict:
    """Write each named result table to ``path/<name>``; returns the paths."""
    out = {}
    for name, df in results.items():
        p = f"{path.rstrip('/')}/{name}"
        df.write.mode(mode).parquet(p)
        out[name] = p
    return out


def read_result(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{name}")
