"""The driver's tables, read as the tables of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions.timecode import minutes_label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, ten seconds each."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"), minutes_label(F.col("turn") * 10).alias("time"), "text"
    )


SEGMENTS_SQL = """seg AS (
  SELECT conv_id AS video_id, turn AS idx, turn * 10 AS start, printf('%d:%02d', turn * 10 // 60, turn * 10 % 60) AS time, text,
    coalesce(lead(turn * 10) OVER (PARTITION BY conv_id ORDER BY turn), turn * 10 + 3) AS stop
  FROM conversations
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("video_id"), F.col("vec_id").cast("double").alias("start_time"), "embedding"
    )


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cached transcripts, with times and counts made from their ids."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("video_id"), F.col("text").alias("transcript"), F.col("source").alias("video_title"),
        F.timestamp_seconds(F.lit(1735689600) + i * 60).alias("extracted_at"),
        F.timestamp_seconds(F.lit(1748736000) + i * 7919 % 1000003).alias("last_accessed_at"),
        (i % 13 + 1).cast("int").alias("access_count"),
        F.when(i % 10 == 3, F.lit("NO_TRANSCRIPT")).alias("error_code"),
    )


CACHE_SQL = """cache AS (
  SELECT doc_id AS video_id, text AS transcript, source AS video_title, to_timestamp(1735689600 + doc_id * 60) AT TIME ZONE 'UTC' AS extracted_at,
    to_timestamp(1748736000 + doc_id * 7919 % 1000003) AT TIME ZONE 'UTC' AS last_accessed_at, (doc_id % 13 + 1)::INT AS access_count,
    CASE WHEN doc_id % 10 = 3 THEN 'NO_TRANSCRIPT' END AS error_code
  FROM documents
)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested ids, of which about a third is cached."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), (F.col("doc_id") * 3).alias("video_id"))


REQUESTS_SQL = "asked AS (SELECT doc_id AS ord, doc_id * 3 AS video_id FROM labels)"

#: Order statuses as job statuses.
STATUS = {"P": "pending", "O": "processing", "F": "completed"}


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "P", "pending").when(s == "O", "processing").otherwise("completed")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 3 == 0, "playlist").otherwise("batch").alias("type"),
        status.alias("status"), F.col("o_orderdate").alias("created_at"),
        F.when(s == "F", F.col("o_orderdate") + F.expr("interval 3 days")).alias("completed_at"),
    )


JOBS_SQL = """jobs AS (
  SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'playlist' ELSE 'batch' END AS type,
    CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'processing' ELSE 'completed' END AS status,
    o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END AS completed_at
  FROM orders
)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("video_id"),
        (F.col("l_returnflag") != "R").alias("success"), F.col("l_quantity").cast("long").alias("elapsed_ms"), F.col("l_shipdate").alias("created_at"),
    )


RESULTS_SQL = """results AS (
  SELECT l_orderkey AS job_id, l_linenumber AS id, l_partkey AS video_id, l_returnflag <> 'R' AS success, l_quantity::BIGINT AS elapsed_ms,
    l_shipdate AS created_at
  FROM lineitem
)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trials of two modes."""
    kind, value = F.col("event_type"), F.col("value")
    message = (
        F.when(F.col("event_id") % 5 == 0, "NO_TRANSCRIPT found").when(F.col("event_id") % 5 == 1, "page timeout")
        .when(F.col("event_id") % 5 == 2, "Timeout").when(F.col("event_id") % 5 == 3, "request blocked").otherwise("navigation failed")
    )
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "stealth").otherwise("raw").alias("mode"), (kind != "error").alias("success"),
        value.alias("duration"), message.alias("message"),
    )


TRIALS_SQL = """trials AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'stealth' ELSE 'raw' END AS mode, event_type <> 'error' AS success, value AS duration,
    CASE event_id % 5 WHEN 0 THEN 'NO_TRANSCRIPT found' WHEN 1 THEN 'page timeout' WHEN 2 THEN 'Timeout' WHEN 3 THEN 'request blocked'
      ELSE 'navigation failed' END AS message
  FROM events
), broken AS (
  SELECT mode, CASE WHEN contains(message, 'NO_TRANSCRIPT') THEN 'NO_TRANSCRIPT' WHEN contains(message, 'timeout') THEN 'TIMEOUT'
    WHEN contains(message, 'navigation') THEN 'NAVIGATION_FAILED' WHEN contains(message, 'Target closed') THEN 'BROWSER_CRASH'
    WHEN contains(message, 'blocked') THEN 'BLOCKED_BY_YOUTUBE' ELSE 'UNKNOWN' END AS error_type, count(*) AS n
  FROM trials WHERE NOT success GROUP BY ALL
), per_mode AS (
  SELECT mode, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
    round(100.0 * count(*) FILTER (success) / count(*), 6) AS success_rate, round(coalesce(avg(duration) FILTER (success), 0), 6) AS avg_duration,
    coalesce(min(duration) FILTER (success), 0) AS min_duration, coalesce(max(duration) FILTER (success), 0) AS max_duration
  FROM trials GROUP BY mode
)"""
