"""Queries that run a stream to its end, or answer for one; their SQL says what a batch over the same events gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.plans import tables as t
from cueline.plans.queries import query
from cueline.sources import folders
from cueline.sources.event_streams import EventStreams
from cueline.streaming import limits, progress, sinks

#: Turns of conversations as progress events, over two hours that start at BASE, in another order than that of their numbers.
BASE, SPAN = 1735689600, 7200
#: Files of a stream are written for one slice of time after another; no event is later than a slice.
SLICE, LATE = 1800, "31 minutes"
BEAT = "~"  # the job of an event long after all others, which lets the watermark pass them


def _at(extra: str = "0") -> str:
    return f"(conv_id * 37 + turn * 11 + {extra}) % {SPAN}"


_STATUS = "CASE WHEN (conv_id * 5 + turn * 3) % 7 = 0 THEN 'completed' WHEN (conv_id * 5 + turn * 3) % 7 = 1 AND turn > 2 THEN 'failed' ELSE 'processing' END"
_EVENTS_SQL = f"""ev AS (
  SELECT conv_id::VARCHAR AS job_id, turn AS seq, to_timestamp({BASE} + {_at()}) AT TIME ZONE 'UTC' AS ts, {_STATUS} AS status, (turn + 1)::INT AS done FROM conversations
)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("job_id"), F.col("turn").alias("seq"), F.timestamp_seconds(F.expr(f"{BASE} + {_at()}")).alias("at"),
        F.expr(_STATUS).alias("status"), (F.col("turn") + 1).cast("int").alias("done"), F.lit(8).alias("total"), F.col("role").alias("video_id"),
        F.lit(None).cast("string").alias("message"),
    )


def _beat(spark: SparkSession) -> DataFrame:
    row = spark.createDataFrame([(BEAT, 0, BASE + 3 * SPAN)], "job_id string, seq long, s long")
    return row.select("job_id", "seq", F.timestamp_seconds("s").alias("at"), F.lit("processing").alias("status"))


def _staged(rows: DataFrame, at: str, folder: str, last: DataFrame | None = None) -> DataFrame:
    """A stream over files of ``rows``, written slice after slice, in about four batches."""
    spark = rows.sparkSession
    of = F.floor((F.unix_seconds(at) - BASE) / SLICE)
    for k in range(SPAN // SLICE):
        rows.where(of == k).write.mode("append").parquet(folder)
    if last is not None:
        rows.limit(0).unionByName(last, allowMissingColumns=True).write.mode("append").parquet(folder)
    n = len(spark.read.parquet(folder).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-n // 4)).parquet(folder)


def _streamed(spark: SparkSession, name: str, make: Callable[[str], DataFrame]) -> DataFrame:
    """What the stream that ``make`` gives for a folder writes until its end; the folder is deleted afterwards."""
    folder = folders.fresh(spark, name)
    try:
        with progress.state_store(spark):
            sinks.run_to_end(make(folder), sinks.batch_writer(f"{folder}/out"), f"{folder}/state")
        return folders.checkpoint(spark.read.parquet(f"{folder}/out").drop("batch"))
    finally:
        folders.discard(spark, folder)


@query(f"""WITH {_EVENTS_SQL}, ends AS (
  SELECT DISTINCT ON (job_id) job_id, ts AS end_ts, seq AS end_seq FROM ev WHERE status IN ('completed', 'failed', 'aborted') ORDER BY job_id, ts, seq
)
SELECT job_id, seq, ts, status, status IN ('completed', 'failed', 'aborted') AS closes FROM ev LEFT JOIN ends USING (job_id)
WHERE end_ts IS NULL OR ts < end_ts OR ts = end_ts AND seq <= end_seq""")
def job_streams_ended(spark, sf_dir):
    def make(folder: str) -> DataFrame:
        return progress.until_final(_staged(_events(spark, sf_dir), "at", f"{folder}/in", _beat(spark)), LATE)

    return _streamed(spark, "ended", make).where(F.col("job_id") != BEAT).select("job_id", "seq", F.col("at").alias("ts"), "status", "closes")


_LONGEST = 1200
_VISITS_SQL = f"""visits AS (
  SELECT conv_id * 10 + turn AS client_id, conv_id::VARCHAR AS job_id, to_timestamp({BASE} + {_at("conv_id % 50")}) AT TIME ZONE 'UTC' AS connected_at,
    CASE WHEN conv_id % 5 <> 0 THEN to_timestamp({BASE} + {_at("conv_id % 50")} + turn * 13 + 20) AT TIME ZONE 'UTC' END AS left_at
  FROM conversations WHERE turn % 3 = 0
)"""


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    begun = f"{BASE} + {_at('conv_id % 50')}"
    return t.table(spark, sf_dir, "conversations").where("turn % 3 = 0").select(
        F.expr("conv_id * 10 + turn").alias("client_id"), F.col("conv_id").cast("string").alias("job_id"), F.timestamp_seconds(F.expr(begun)).alias("connected_at"),
        F.when(F.col("conv_id") % 5 != 0, F.timestamp_seconds(F.expr(f"{begun} + turn * 13 + 20"))).alias("left_at"),
    )


@query(f"""WITH {_EVENTS_SQL}, {_VISITS_SQL}
SELECT client_id, job_id, seq, ts FROM ev JOIN visits USING (job_id)
WHERE ts >= connected_at AND (left_at IS NULL OR ts < left_at) AND ts < connected_at + INTERVAL {_LONGEST} SECOND""")
def progress_routed_connected(spark, sf_dir):
    def make(folder: str) -> DataFrame:
        events = _staged(_events(spark, sf_dir), "at", f"{folder}/events")
        visits = _staged(_visits(spark, sf_dir), "connected_at", f"{folder}/visits")
        return progress.route_while_connected(events, visits, LATE, f"{_LONGEST} seconds").select("client_id", "job_id", "seq", F.col("at").alias("ts"))

    return _streamed(spark, "routed", make)


@query(f"""WITH {_EVENTS_SQL} SELECT job_id, seq, status, done FROM ev""")
def event_stream_replayed(spark, sf_dir):
    """Events to files of server-sent events and back, by the sink and the source of this library."""
    spark.dataSource.register(EventStreams)

    def make(folder: str) -> DataFrame:
        written = _staged(_events(spark, sf_dir), "at", f"{folder}/in")
        sinks.run_to_end(written, sinks.event_stream_writer(f"{folder}/sent", ["job_id", "seq", "status", "done"]), f"{folder}/sending")
        read = spark.readStream.format("event_stream").option("path", f"{folder}/sent").load()
        return read.select(F.from_json("event", "job_id string, seq long, status string, done int").alias("e")).select("e.*")

    return _streamed(spark, "replayed", make)


#: A third of the requests come from one client.
_CLIENT = "CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id % 29 + 1 END"


@query(f"""WITH RECURSIVE req AS (
  SELECT conv_id, turn, {_CLIENT} AS client, to_timestamp({BASE} + {_at()}) AT TIME ZONE 'UTC' AS ts FROM conversations
), starts AS (
  SELECT client, min(ts) AS s FROM req GROUP BY client
  UNION ALL
  SELECT r.client, min(r.ts) FROM starts JOIN req r ON r.client = starts.client AND r.ts >= starts.s + INTERVAL 60 SECOND GROUP BY r.client, starts.s
), placed AS (
  SELECT conv_id, turn, req.client, ts, max(s) AS window_start FROM req JOIN starts ON starts.client = req.client AND s <= ts GROUP BY ALL
)
SELECT conv_id, turn, client, window_start, row_number() OVER (PARTITION BY client, window_start ORDER BY ts, conv_id * 100 + turn) > 3 AS rejected FROM placed""")
def rate_limit_from_first(spark, sf_dir):
    requests = t.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.expr(_CLIENT).alias("client"), F.timestamp_seconds(F.expr(f"{BASE} + {_at()}")).alias("at"), F.expr("conv_id * 100 + turn").alias("ord")
    )
    return limits.limited(requests, "client", "at", "ord", 3, 60).select("conv_id", "turn", "client", "window_start", "rejected")
