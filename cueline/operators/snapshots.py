"""Changes to keyed tables: a snapshot goes in, the next one comes out.

Parquet files are not changed in place.  Each function returns the new state;
``sources.files.replace`` writes it without overwriting what is being read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class DuplicateKey(ValueError):
    pass


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.asc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Replace whole rows by key and add new ones; among rows of one key the last by ``order`` wins."""
    new = last_wins(rows, key, order).drop(order) if order else rows
    return table.join(new.select(key), key, "left_anti").unionByName(new.select(*table.columns))


def insert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Add rows whose keys must be new."""
    clash = rows.join(table.select(key), key, "left_semi").select(key).unionByName(
        rows.groupBy(key).count().where("count > 1").select(key)
    )
    if not clash.isEmpty():
        raise DuplicateKey(f"{key} exists already")
    return table.unionByName(rows.select(*table.columns))


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*table.columns))


def delete(table: DataFrame, condition: Column) -> DataFrame:
    """Drop the rows for which the condition holds; where it is null they stay."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def delete_with_children(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Drop parents by id, and the children that point to them."""
    gone = ids.select(key).distinct()
    left = parents.join(gone, key, "left_anti")
    return left, children.join(gone.withColumnRenamed(key, child_key), child_key, "left_anti")


def replace_for(table: DataFrame, rows: DataFrame, owner: str) -> DataFrame:
    """All rows of the owners in ``rows`` make way for the new ones, so that none is left over."""
    return table.join(rows.select(owner).distinct(), owner, "left_anti").unionByName(rows.select(*table.columns))


def stamp(now: datetime) -> str:
    """A time as it stands in a file's name: to the second, without colons."""
    return now.strftime("%Y-%m-%dT%H-%M-%S")


def backup(table: DataFrame, folder: str, now: datetime, name: str = "transcripts") -> str:
    """Write a copy named after the time, and return its path; an existing one is refused."""
    path = f"{folder.rstrip('/')}/{name}-{stamp(now)}"
    table.write.mode("error").parquet(path)
    return path


def create_if_missing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, made empty if there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def clear(table: DataFrame) -> DataFrame:
    return table.limit(0)
