"""Streaming scorer (ST1).

The fitted path D48 → P7 → F1 → F2 → M2 → M3 is row-wise and stateless, so the
same DataFrame code runs on a streaming DataFrame: no watermark or state is
needed.  Detectors whose scoring is a per-row ``mapInPandas`` (Isolation
Forest, One-Class SVM) stream; LOF scoring needs a join against the training
neighbours and stays batch-only.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame

from ..functions import features as feat
from ..operators.detect import FittedDetector
from ..operators.prep import PrepModel, Scaler


def score_stream(df: DataFrame, prep: PrepModel, scaler: Scaler | None, det: FittedDetector,
                 domain_features: Sequence[str] | None, keep: Sequence[str]) -> DataFrame:
    """Apply the fitted preparation and detector to a (streaming) flow table."""
    if det.algorithm == "lof":
        raise ValueError("LOF scoring joins against training neighbours; use batch scoring")
    d = feat.add_domain_features(df, domain_features)
    p = prep.transform(d, keep=list(keep))
    if scaler is not None:
        p = scaler.transform(p)
    return det.predict(p, keep=list(keep))


def run_available_now(stream_df: DataFrame, path: str, checkpoint: str) -> None:
    """Drain every available input file into a Parquet sink, then stop."""
    q = (stream_df.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def file_stream(spark, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

