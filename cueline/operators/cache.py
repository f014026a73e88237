"""The transcript cache: lookups, touches, eviction and figures.

Rows: video_id, video_url, video_title, transcript, srt_text, plain_text,
extracted_at, last_accessed_at, access_count, extraction_time_ms, error_code,
error_message.  Only the columns that a function names are needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.operators import snapshots


def lookup(cache: DataFrame, video_id: object) -> DataFrame:
    return cache.where(F.col("video_id") == F.lit(video_id))


def get(cache: DataFrame, video_id: object, now: datetime) -> tuple[DataFrame, DataFrame]:
    """The row after its touch, and the cache after it."""
    hits = cache.sparkSession.createDataFrame([(video_id, now)], f"video_id {dict(cache.dtypes)['video_id']}, at timestamp")
    touched = touch(cache, hits)
    return lookup(touched, video_id), touched


def lookup_many(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The cached rows of the requested ids, as they were before any touch."""
    return cache.join(keys.select("video_id"), "video_id", "left_semi")


def exists(cache: DataFrame, video_id: object) -> bool:
    return not lookup(cache, video_id).isEmpty()


def touch(cache: DataFrame, hits: DataFrame) -> DataFrame:
    """Count hits (video_id, at) and move the time of last access; ids that aren't cached are ignored."""
    counted = hits.groupBy("video_id").agg(F.count("*").alias("__hits"), F.max("at").alias("__at"))
    return cache.join(counted, "video_id", "left").select(
        *[
            (F.col("access_count") + F.coalesce("__hits", F.lit(0))).cast("int").alias(c) if c == "access_count"
            else F.greatest("last_accessed_at", "__at").alias(c) if c == "last_accessed_at"
            else F.col(c)
            for c in cache.columns
        ]
    )


def save(cache: DataFrame, rows: DataFrame, order: str | None = None) -> DataFrame:
    return snapshots.upsert(cache, rows, "video_id", order)


#: Up to so many rows are picked by one sorted limit, whose rows each task keeps at most so many of; more by a bracket of quantiles.
FEW = 10_000
#: How far the quantiles that bracket the cutoff may be off, as a share of the rows.
SLACK = 0.001


def _oldest_first() -> tuple[Column, Column]:
    """Rows without a time go first, ties by video_id."""
    return F.asc_nulls_first("last_accessed_at"), F.asc_nulls_first("video_id")


def _without(cache: DataFrame, n: int) -> DataFrame:
    gone = cache.orderBy(*_oldest_first()).limit(n).select(F.col("video_id").alias("__gone"))
    return cache.join(gone, F.col("video_id").eqNullSafe(F.col("__gone")), "left_anti")


def evict_oldest(cache: DataFrame, n: int, rows: int | None = None) -> DataFrame:
    """Without the ``n`` rows accessed longest ago; rows without a time go first, ties by video_id.

    Up to ``FEW`` rows are found by a sorted limit, in one pass and without any job
    of its own.  For more, one pass takes approximate quantiles around the cutoff (``rows``: how many there are, counted
    if not given); what is surely older goes by a filter, and only the rows between the two
    quantiles, about two thousandths of the table, are put in order.
    """
    if n <= 0:
        return cache
    if n <= FEW:
        return _without(cache, n)
    known = F.unix_micros("last_accessed_at")
    rows = cache.count() if rows is None else rows
    if n >= rows:
        return cache.limit(0)
    timed, share = cache.agg(F.count("last_accessed_at"), F.count("*")).first(), n / rows
    if n <= timed[1] - timed[0]:  # rows without a time are enough
        return cache.where("last_accessed_at is not null").unionByName(_without(cache.where("last_accessed_at is null"), n))
    share = (n - (timed[1] - timed[0])) / timed[0]
    ends = cache.select(known.alias("k")).approxQuantile("k", [max(0.0, share - 2 * SLACK), min(1.0, share + 2 * SLACK)], SLACK)
    low, high = int(ends[0]), int(ends[1])
    below, upto = cache.agg(F.count_if(F.coalesce(known < low, F.lit(True))), F.count_if(F.coalesce(known <= high, F.lit(True)))).first()
    if not below <= n <= upto:  # an estimate that is further off than it should be: the whole range is between
        low, high, below = -(1 << 62), 1 << 62, timed[1] - timed[0]
    between = cache.where(known.between(low, high))
    return cache.where(known > high).unionByName(_without(between, n - below))


def evict_older_than(cache: DataFrame, days: int, now: datetime) -> DataFrame:
    cutoff = F.lit(now) - F.make_interval(days=F.lit(days))
    return snapshots.delete(cache, F.col("last_accessed_at") < cutoff)


def stats(cache: DataFrame) -> DataFrame:
    """One row: entries, oldest and newest extraction, the most accessed video, and the size in characters."""
    return cache.agg(
        F.count("*").alias("total_entries"), F.min("extracted_at").alias("oldest_entry"), F.max("extracted_at").alias("newest_entry"),
        F.max_by("video_id", F.struct("access_count", "video_id")).alias("most_accessed"),
        F.coalesce(F.sum(F.length("transcript")), F.lit(0)).alias("size_chars"),
    )


@dataclass
class EvictionPolicy:
    kind: str = "lru"  # or ttl, or none
    max_entries: int = 10_000
    max_megabytes: float = 500.0
    ttl_days: int = 30


def run_eviction(cache: DataFrame, policy: EvictionPolicy, now: datetime) -> tuple[DataFrame, dict]:
    """Apply a policy and report entries and size before and after.

    Least recently used: first the entries over the limit go; if what is left is
    still over the limit of size, one more tenth of it (rounded up) goes, once.
    The two policies never mix.
    """
    size = lambda df: df.agg(F.count("*"), F.coalesce(F.sum(F.length("transcript")), F.lit(0))).first()
    n, chars = size(cache)
    if policy.kind == "ttl":
        left = evict_older_than(cache, policy.ttl_days, now)
    elif policy.kind == "lru":
        left = evict_oldest(cache, n - policy.max_entries, n) if n > policy.max_entries else cache
        kept, kept_chars = size(left) if n > policy.max_entries else (n, chars)
        if kept_chars / (1024 * 1024) > policy.max_megabytes:
            left = evict_oldest(left, ceil(kept / 10), kept)
    elif policy.kind == "none":
        left = cache
    else:
        raise ValueError(f"unknown policy: {policy.kind}")
    after, after_chars = size(left)
    return left, {"evicted": n - after, "entries_before": n, "entries_after": after, "chars_before": chars, "chars_after": after_chars}


def hit_rate(requested: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: requested, hits, and hits in percent of them (0 if none)."""
    marked = requested.join(cache.select("video_id").distinct().withColumn("__hit", F.lit(1)), "video_id", "left")
    return marked.agg(F.count("*").alias("requested"), F.count("__hit").alias("hits")).withColumn(
        "hit_rate", F.coalesce(F.try_divide(F.col("hits") * 100.0, F.col("requested")), F.lit(0.0))
    )
