"""Cache-first batches: what is asked for, what is cached, and what is fetched anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.functions.urls import is_video_url, video_id
from cueline.operators.snapshots import first_wins

BATCH_LIMIT, PLAYLIST_LIMIT = 50, 100


def requested(urls: DataFrame, limit: int = BATCH_LIMIT) -> DataFrame:
    """Valid addresses (ord, url), the first of each video, in order, at most ``limit``."""
    valid = urls.where(is_video_url(F.col("url"))).withColumn("video_id", video_id(F.col("url")))
    return first_wins(valid, "video_id", "ord").orderBy("ord").limit(limit)


def misses(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose video is not cached; a row without an id counts as one."""
    return asked.join(cache.select("video_id"), "video_id", "left_anti")


def hits(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows whose video is cached, with the cached columns and success (no error code)."""
    return asked.join(cache, "video_id").withColumn("success", F.nullif(F.col("error_code"), F.lit("")).isNull())


def merge(asked: DataFrame, cached: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each request (ord, video_id): the cached result, else the fresh one, else NOT_FOUND.

    ``cached`` and ``fresh`` hold success, error_code and ``columns``, one row a video.
    """
    fields = ["success", "error_code", *columns]
    pack = lambda df, name: df.select("video_id", F.struct(*fields).alias(name))
    both = asked.join(pack(cached, "__cached"), "video_id", "left").join(pack(fresh, "__fresh"), "video_id", "left")
    found = F.coalesce("__cached", "__fresh")
    source = F.when(F.col("__cached").isNotNull(), "cache").when(F.col("__fresh").isNotNull(), "fresh").otherwise("none")
    return both.select(
        *asked.columns, source.alias("result_source"),
        F.coalesce(found["success"], F.lit(False)).alias("success"),
        F.when(found.isNull(), F.lit("NOT_FOUND")).otherwise(found["error_code"]).alias("error_code"),
        *[found[c].alias(c) for c in columns],
    )


def counters(results: DataFrame, elapsed: str = "elapsed_ms") -> DataFrame:
    """One row: total, successful, failed, and the time for each, rounded half up (0 if none)."""
    return results.agg(
        F.count("*").alias("total"), F.count_if(F.col("success")).alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum(elapsed), F.lit(0)).alias("total_ms"),
    ).withColumn("avg_ms", F.coalesce(F.floor(F.try_divide("total_ms", "total") + 0.5), F.lit(0)).cast("long"))


def split(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and failures; a result that says neither is a failure."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.where(ok), results.where(~ok)


def before_abort(results: DataFrame, aborts: DataFrame, at: str = "created_at") -> DataFrame:
    """Results of batches up to their abort, if any (job_id, aborted_at); slots that were never filled have no row."""
    ended = aborts.groupBy("job_id").agg(F.min("aborted_at").alias("__aborted"))
    return results.join(ended, "job_id", "left").where(F.col("__aborted").isNull() | (F.col(at) <= F.col("__aborted"))).select(*results.columns)


def filled(slots: DataFrame, result: str) -> DataFrame:
    """Slots that hold a result."""
    return slots.where(F.col(result).isNotNull())


def together(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached results before fresh ones; result_order tells them apart."""
    return cached.withColumn("result_order", F.lit(0)).unionByName(fresh.withColumn("result_order", F.lit(1)))
