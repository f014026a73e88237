"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Arrow batches are left to Spark, which ends one at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch)
# or 10,000 rows: however long texts are, a batch has a bound in bytes, and no operator sets anything for the session.

#: Rows of a batch that are Python values at once.
TOGETHER = 256
#: Entries after which a worker's memo of words starts afresh: most words beyond the frequent ones come once, and a memo of them is memory alone.
MEMO = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(*columns: pa.Array, rows: int = TOGETHER) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of a batch's columns, some at a time and without a copy, so that a worker never has a whole batch as Python values."""
    for at in range(0, len(columns[0]), rows):
        yield tuple(c.slice(at, rows) for c in columns)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A top-level column by its exact name, which may hold dots and backquotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame, without: set[str] = frozenset()) -> list[Column]:
    """The columns of ``df`` but for some names, compared as Spark does, without regard to case."""
    gone = {c.lower() for c in without}
    return [col(c) for c in df.columns if c.lower() not in gone]


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, set as Spark's checkpoint folder.

    Only where that is unset, on a local master, a temporary folder stands in.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="cueline-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def crc32_mod(doc_id, n: int):
    """crc32 of the id written as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
