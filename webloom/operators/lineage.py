"""Cutting lineage in loops, and tables on the way, in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    global _own
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    _own = _own or tempfile.mkdtemp(prefix="webloom-")
    return f"file://{_own}"


_own: str | None = None


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the session's JVM ends."""
    path = f"{_shared(spark)}/webloom-{name}-{uuid.uuid4().hex[:12]}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of df."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()
