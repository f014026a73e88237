"""Jobs as a log of events, their current state, results and summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.operators import snapshots

STATUSES = ["pending", "processing", "completed", "failed", "aborted"]
FINAL = ["completed", "failed", "aborted"]


def current_state(events: DataFrame) -> DataFrame:
    """The state of each job after all its events (job_id, seq, at, kind, status, processed, successful, failed, message).

    ``status`` events set the status and set or clear the message; ``progress``
    events set the counters, which are totals, and leave those that they hold no
    value for; ``complete``, ``fail`` and ``abort`` end the job.
    """
    order = F.struct("at", "seq")
    state = F.col("kind").isin("status", "complete", "fail", "abort")
    return events.groupBy("job_id").agg(
        F.max_by("status", F.when(state, order)).alias("status"),
        F.max_by("message", F.when(state, order)).alias("error_message"),
        *[F.coalesce(F.max_by(c, F.when(F.col("kind").isin("progress", "complete") & F.col(c).isNotNull(), order)), F.lit(0)).alias(c) for c in ("processed", "successful", "failed")],
        F.min("at").alias("created_at"), F.max("at").alias("updated_at"),
        F.max(F.when(F.col("status").isin(*FINAL) & state, F.col("at"))).alias("completed_at"),
    )


def get(jobs: DataFrame, job_id: object) -> DataFrame:
    return jobs.where(F.col("job_id") == F.lit(job_id))


def create(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    return snapshots.insert(jobs, rows, "job_id")


def summary(jobs: DataFrame, status: str = "status", names: dict[str, str] | None = None) -> DataFrame:
    """One row: total and the number of jobs in each status; zeros on an empty table."""
    names = names or {s: s for s in STATUSES}
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == value).alias(name) for name, value in names.items()])


def recent(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)


def by_status(jobs: DataFrame, status: str, kind: str | None = None) -> DataFrame:
    found = jobs.where(F.col("status") == status)
    return (found.where(F.col("type") == kind) if kind else found).orderBy(F.desc("created_at"), F.desc("job_id"))


def results_of(results: DataFrame, job_id: object) -> DataFrame:
    return results.where(F.col("job_id") == F.lit(job_id)).orderBy("created_at", "id")


def purge(jobs: DataFrame, days: int, now: datetime) -> DataFrame:
    """Without jobs that ended more than ``days`` before ``now``; jobs that have not ended stay."""
    return snapshots.delete(jobs, F.col("completed_at") < F.lit(now) - F.make_interval(days=F.lit(days)))


def delete(jobs: DataFrame, results: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without some jobs and their results."""
    return snapshots.delete_with_children(jobs, results, ids, "job_id", "job_id")


def with_results(jobs: DataFrame, results: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Jobs, their results, and the transcripts of those that are cached."""
    return jobs.join(results, "job_id").join(transcripts.select("video_id", "video_title"), "video_id", "left")
