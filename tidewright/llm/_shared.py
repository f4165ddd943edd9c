"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lists of folders to remove when their scratch() ends; the last is the open one.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; on a local master a folder of its own where it is unset, elsewhere an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _open:
        _open[-1].append(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of materialized tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path:
            _remove(t.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Collect the folders that materialize writes meanwhile; sweep() removes them once their readers are done."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        _open.pop()


def sweep(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        _remove(spark, paths.pop())


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each lengthened until it clashes with none of the taken ones (case aside)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
