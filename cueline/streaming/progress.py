"""Streams of progress events and requests: latest states, routing, ends of jobs, and rate limits."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

FINAL = ["completed", "failed", "aborted"]
PROGRESS = "job_id string, seq long, at timestamp, status string, done int, total int, video_id string, message string"
#: The state store that streams with timers and lists of state need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in ``ROCKSDB``; the session's settings are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Requests allowed in a window of so many seconds.
LIMITS = {"single": (10, 60), "playlist": (3, 300), "batch": (5, 300)}


def read_progress(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """A stream of JSON progress events from files."""
    return spark.readStream.schema(PROGRESS).option("maxFilesPerTrigger", files_a_trigger).json(path)


def emit_progress(results: DataFrame) -> DataFrame:
    """Progress events of jobs from their results (job_id, ord, at, video_id, success): an item's count is of items done."""
    w = Window.partitionBy("job_id").orderBy("ord")
    total = F.count("*").over(Window.partitionBy("job_id")).cast("int")
    done = F.row_number().over(w)
    return results.select(
        "job_id", done.cast("long").alias("seq"), "at", F.when(done == total, F.lit("completed")).otherwise(F.lit("processing")).alias("status"),
        done.alias("done"), total.alias("total"), "video_id", F.when(~F.col("success"), F.lit("failed")).alias("message"),
    )


def lifecycle(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """All progress events of jobs: started, each item begun and done, and how the job ended.

    ``items``: job_id, idx (from 0), video_id, started_at, ended_at, success, error,
    for the items that were processed; ``jobs``: job_id, total, status (completed,
    failed or aborted), started_at, ended_at, error.  ``done`` is the index of an
    item that begins, one more when it is done, all at completion, 0 at a failure,
    and the number of items processed at an abort.
    """
    both = items.join(jobs.select("job_id", "total"), "job_id")
    processed = jobs.join(items.groupBy("job_id").agg(F.count("*").alias("processed")), "job_id", "left")
    done = F.when(F.col("status") == "completed", F.col("total")).when(F.col("status") == "aborted", F.coalesce("processed", F.lit(0))).otherwise(0)

    def event(df: DataFrame, seq: Column, at: str, status: Column, done: Column, video: Column, message: Column) -> DataFrame:
        return df.select(
            "job_id", seq.cast("long").alias("seq"), F.col(at).alias("at"), status.alias("status"), done.cast("int").alias("done"),
            F.col("total").cast("int").alias("total"), video.alias("video_id"), message.alias("message"),
        )

    none, idx = F.lit(None).cast("string"), F.col("idx")
    video, busy = F.col("video_id").cast("string"), F.lit("processing")
    return (
        event(jobs, F.lit(0), "started_at", F.lit("started"), F.lit(0), none, none)
        .unionByName(event(both, 2 * idx + 1, "started_at", busy, idx, video, none))
        .unionByName(event(both, 2 * idx + 2, "ended_at", busy, idx + 1, video, F.when(~F.col("success"), F.coalesce("error", F.lit("failed")))))
        .unionByName(event(processed, 2 * F.col("total") + 1, "ended_at", F.col("status"), done, none, F.when(F.col("status") == "failed", F.col("error"))))
    )


def latest(events: DataFrame) -> DataFrame:
    """The last state of each job; for update or complete mode, or a batch."""
    state = F.max_by(F.struct("status", "done", "total", "message"), F.struct("at", "seq"))
    return events.groupBy("job_id").agg(state.alias("s"), F.max("at").alias("updated_at")).select("job_id", "s.*", "updated_at")


def route(events: DataFrame, clients: DataFrame) -> DataFrame:
    """Each event once for every client that listens to its job (client_id, job_id)."""
    return events.join(clients, "job_id")


def _in_order(at: str, seq: str) -> Column:
    return F.struct(F.col(at), F.col(seq))


class _UntilFinal(StatefulProcessor):
    """Holds a job's events until the watermark has passed them, and where the job has ended."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", PROGRESS)
        self.ended = handle.getValueState("ended", "at long, seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            at = _micros(batch["at"])
            if self.ended.exists():  # what came before the end is already out; what comes long after it begins the job anew
                anew = (at > self.ended.get()[0] + self.keep_ms * 1000).to_numpy()
                at, batch = at[anew], batch[anew]
                if not len(batch):
                    continue
            first = int(at.min()) if first is None else min(first, int(at.min()))
            self.waiting.appendList([tuple(r) for r in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None)])
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        if self.ended.exists():
            if now_ms * 1000 <= self.ended.get()[0] + self.keep_ms * 1000:
                return
            self.ended.clear()
        end, rest, ready = None, [], []
        for row in self.waiting.get():  # a list state is read piece by piece; only what must wait on is held
            place = (_micro(row[2]), row[1])
            if place[0] > now_ms * 1000:
                rest.append(tuple(row))
            elif row[3] in FINAL and (end is None or place < end):
                end = place
        for row in self.waiting.get():
            place = (_micro(row[2]), row[1])
            if place[0] <= now_ms * 1000 and (end is None or place <= end):
                ready.append((*row, row[3] in FINAL))
                if len(ready) == 10_000:
                    yield _frame(ready)
                    ready = []
        if ready:
            yield _frame(ready)
        self.waiting.clear()
        if end is not None:
            self.ended.update(end)
            self.handle.registerTimer(end[0] // 1000 + self.keep_ms)
        elif rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(_micro(r[2]) for r in rest) // 1000)

    def close(self) -> None:
        pass


def _micro(at: datetime) -> int:
    return int(pd.Timestamp(at).value // 1000)


def _micros(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[ns]").astype("int64") // 1000


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in PROGRESS.split(", ")]
    made = pd.DataFrame(rows, columns=[*names, "closes"])
    return made.astype({"seq": "int64", "done": "Int32", "total": "Int32", "closes": bool, "at": "datetime64[ns]"})


def until_final(events: DataFrame, late: str = "10 minutes", keep_minutes: int = 1440) -> DataFrame:
    """Events of each job up to its first final one, in the order of their times and then of ``seq``.

    Adds ``closes``: true on the event that ends the job.  Events without a job or
    a time are dropped.  Of a batch, the first end of each job is a grouped minimum that
    the events are joined with.

    A stream gives the same rows, whatever the order in which events come, as long as none is
    later than ``late``: an event is held until the watermark has passed it, so that no earlier end can
    come any more.  It ends as soon as its source does; what the last watermark hasn't
    passed stays in the state for the next run.  A job's end is remembered for
    ``keep_minutes`` of event time; an event after that begins the job anew.  State is kept per job, by RocksDB: start the stream within ``state_store``.
    """
    known = events.where("job_id is not null and at is not null")
    if not events.isStreaming:
        ends = known.where(F.col("status").isin(FINAL)).groupBy(F.col("job_id").alias("__job")).agg(F.min(_in_order("at", "seq")).alias("__end"))
        here = F.col("__end").isNull() | (_in_order("at", "seq") <= F.col("__end"))
        return known.join(ends, F.col("job_id") == F.col("__job"), "left").where(here).select(
            *events.columns, F.col("status").isin(FINAL).alias("closes")
        )
    return known.select(*[c.split()[0] for c in PROGRESS.split(", ")]).withWatermark("at", late).groupBy("job_id").transformWithStateInPandas(
        _UntilFinal(keep_minutes * 60_000), PROGRESS + ", closes boolean", "Append", "EventTime"
    )


def route_while_connected(events: DataFrame, visits: DataFrame, late: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """Each event once for every visit of a client that was connected to its job at the event's time.

    ``visits``: client_id, job_id, connected_at, left_at (null: still connected).  A
    client that connects late misses the events before, and none is sent from the
    moment that it leaves, or ``longest`` after it connected, where the server closes.

    Both sides may be streams; then events and visits later than ``late`` are dropped, and the
    join holds an event until no visit from before it can come, and a visit for ``longest``.
    Two visits of a client at once get an event once each.
    """
    sent, seen = events, visits.withColumnRenamed("job_id", "__job")
    if events.isStreaming and visits.isStreaming:
        sent, seen = sent.withWatermark("at", late), seen.withWatermark("connected_at", late)
    at, begun = F.col("at"), F.col("connected_at")
    while_there = (at >= begun) & (at < begun + F.expr(f"interval {longest}")) & (F.col("left_at").isNull() | (at < F.col("left_at")))
    return sent.join(seen, (F.col("job_id") == F.col("__job")) & while_there).drop("__job")


def request_windows(requests: DataFrame, client: str, at: str, seconds: int) -> DataFrame:
    """Requests of each client in fixed windows aligned to the epoch (client, start, n)."""
    w = F.window(at, f"{seconds} seconds")
    return requests.groupBy(w, client).agg(F.count("*").alias("n")).select(client, F.col("window.start").alias("start"), "n")


def over_limit(requests: DataFrame, client: str, at: str, limit: int, seconds: int) -> DataFrame:
    """Windows in which a client exceeded the limit, and by how many requests."""
    return request_windows(requests, client, at, seconds).where(F.col("n") > limit).withColumn("rejected", F.col("n") - limit)


def rejected(requests: DataFrame, client: str, at: str, order: str, limit: int, seconds: int) -> DataFrame:
    """Of a batch of requests those over the limit of their window, with code RATE_LIMIT_EXCEEDED."""
    start = F.window(at, f"{seconds} seconds")["start"]
    w = Window.partitionBy(client, "__start").orderBy(at, order)
    return (
        requests.withColumn("__start", start).withColumn("__n", F.row_number().over(w)).where(F.col("__n") > limit)
        .drop("__start", "__n").withColumn("code", F.lit("RATE_LIMIT_EXCEEDED"))
    )


def sliding(events: DataFrame, at: str, key: str, seconds: int, every: int, late: str = "10 minutes") -> DataFrame:
    """Counts of each key in sliding windows; events later than ``late`` are dropped."""
    w = F.window(at, f"{seconds} seconds", f"{every} seconds")
    return events.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, at: str, key: str, gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, parted by gaps of ``gap_seconds`` without events."""
    w = F.session_window(at, f"{gap_seconds} seconds")
    return events.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n")).select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"
    )
