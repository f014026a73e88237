"""A table of Parquet files dealt to folders by a hash of the key, of which a change rewrites only the folders that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cueline.operators import snapshots
from cueline.sources import folders

BUCKET = "key_bucket"


class KeyedTable:
    """A table at ``path``, keyed by ``key`` and dealt to ``buckets`` folders.

    ``buckets`` is fixed when the table is made: choose it so that a folder holds a few files.
    One writer at a time.  What a change writes is put aside in the shared folder first, and takes the place of
    the touched folders as one commit of Spark's, so a change that fails leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets))

    def read(self) -> DataFrame:
        """The rows, without the folder's number; empty before the first write."""
        return self._rows().drop(BUCKET)

    def _rows(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self._stored())
        return self.spark.read.schema(self._stored()).parquet(self.path)

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields, StructField(BUCKET, LongType())])

    def _replace(self, touched: list[int], rows: DataFrame) -> None:
        """``rows`` take the place of all that is in the touched folders."""
        kept = folders.checkpoint(rows.select(*self.schema.fieldNames()).withColumn(BUCKET, self._bucket()))
        full = {r[0] for r in kept.select(BUCKET).distinct().collect()}  # at most ``buckets``
        kept.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for empty in set(touched) - full:
            folders.discard(self.spark, f"{self.path}/{BUCKET}={empty}")

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()]

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Whole rows by key, new ones added; among rows of one key the last by ``order`` wins."""
        touched = self._touched(rows.select(self.key))
        if touched:
            self._replace(touched, snapshots.upsert(self._rows().where(F.col(BUCKET).isin(touched)).drop(BUCKET), rows, self.key, order))

    def delete(self, keys: DataFrame) -> None:
        """The rows of the keys; keys that the table doesn't have are no error."""
        touched = self._touched(keys.select(self.key))
        if touched:
            here = self._rows().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
            self._replace(touched, here.join(keys.select(self.key), self.key, "left_anti"))

    def delete_where(self, condition: Column) -> None:
        """The rows for which the condition holds; only folders that have such rows are rewritten."""
        self.delete(self.read().where(condition).select(self.key))
