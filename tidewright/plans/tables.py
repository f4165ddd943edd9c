"""Small tables of a study, written once and read by the steps after."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without one a temporary folder, elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    return base


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the folder that all executors share and read back; nothing stays cached."""
    path = f"{shared_folder(df.sparkSession)}/study-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
