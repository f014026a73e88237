"""Folders that all executors share, for tables that are written on the way to a result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only on a local master without it, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="cueline-shared-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
