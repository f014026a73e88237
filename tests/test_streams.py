"""Streams that end with their job, timed routing, limits from a first request, the event-stream source and its sink."""

import json
import os
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.sources import event_streams
from cueline.streaming import limits, progress, sinks

START = datetime(2025, 1, 1)
JOBS = [("j", 1, "processing"), ("j", 2, "completed"), ("j", 3, "processing"), ("k", 1, "processing"), ("l", 1, "failed"), ("l", 1, "processing"), ("l", 2, "completed"), (None, 1, "failed")]
WANT = [("j", 1, "processing", False), ("j", 2, "completed", True), ("k", 1, "processing", False), ("l", 1, "failed", True)]


def write_events(folder, rows, mtime):
    """A file for each (job, seq, status, seconds), with modification times of their own."""
    os.makedirs(folder, exist_ok=True)
    for n, (job, seq, status, second) in enumerate(rows):
        path = f"{folder}/{mtime + n}.json"
        at = None if second is None else (START + timedelta(seconds=second)).isoformat() + "Z"
        with open(path, "w") as f:
            json.dump(dict(job_id=job, seq=seq, at=at, status=status, done=seq, total=3, video_id="v", message=None), f)
        os.utime(path, (1_700_000_000 + 10 * (mtime + n),) * 2)


def ended(spark, folder, tmp_path, run="a"):
    with progress.state_store(spark):
        sinks.run_to_end(progress.until_final(progress.read_progress(spark, str(folder), 2)), sinks.batch_writer(f"{tmp_path}/out"), f"{tmp_path}/state", 120)
    rows = spark.read.parquet(f"{tmp_path}/out").where("job_id <> '~'").collect()
    return sorted((r.job_id, r.seq, r.status, r.closes) for r in rows)


@pytest.mark.parametrize("order", [range(8), [7, 6, 5, 4, 3, 2, 1, 0], [2, 1, 6, 4, 3, 0, 7, 5]])
def test_streams_end_with_their_job(spark, tmp_path, order):
    """The same rows for every order of files, each in its batch, and as a batch."""
    timed = [(*JOBS[i], i) for i in range(8)]
    write_events(tmp_path / "in", [timed[i] for i in order] + [("n", 1, "completed", None), ("~", 0, "processing", 3600)], 0)
    assert ended(spark, tmp_path / "in", tmp_path) == WANT
    batch = progress.until_final(spark.read.schema(progress.PROGRESS).json(str(tmp_path / "in"))).where("job_id <> '~'")
    assert sorted((r.job_id, r.seq, r.status, r.closes) for r in batch.collect()) == WANT


def test_an_end_is_remembered_between_runs(spark, tmp_path):
    write_events(tmp_path / "in", [("j", 1, "completed", 5), ("~", 0, "processing", 3600)], 0)
    assert ended(spark, tmp_path / "in", tmp_path) == [("j", 1, "completed", True)]
    write_events(tmp_path / "in", [("j", 2, "failed", 4000), ("~", 0, "processing", 9000)], 10)
    assert ended(spark, tmp_path / "in", tmp_path) == [("j", 1, "completed", True)]  # what comes after the end is dropped
    write_events(tmp_path / "in", [("~", 0, "processing", 200_000), ("j", 3, "processing", 200_001), ("~", 0, "processing", 300_000)], 20)
    assert ended(spark, tmp_path / "in", tmp_path)[1:] == [("j", 3, "processing", False)]  # forgotten after a day: a job anew


def test_clients_get_what_happens_while_they_are_connected(spark):
    at = lambda s: START + timedelta(seconds=s)
    events = spark.createDataFrame([("j", s, at(s)) for s in (0, 10, 20, 30, 4000)], "job_id string, seq long, at timestamp")
    visits = spark.createDataFrame(
        [("late", "j", at(10), None), ("early", "j", at(0), at(10)), ("other", "k", at(0), None), ("twice", "j", at(20), at(25)), ("twice", "j", at(20), at(31)), (None, None, None, None)],
        "client_id string, job_id string, connected_at timestamp, left_at timestamp",
    )
    got = progress.route_while_connected(events, visits)
    assert sorted((r.client_id, r.seq) for r in got.collect()) == [("early", 0), ("late", 10), ("late", 20), ("late", 30), ("twice", 20), ("twice", 20), ("twice", 30)]


def plain_limits(rows, limit, seconds):
    out, begun, n = {}, {}, {}
    for client, at, order in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        if client not in begun or at - begun[client] >= seconds:
            begun[client], n[client] = at, 0
        n[client] += 1
        out[client, at, order] = (begun[client], n[client] > limit)
    return out


def test_windows_begin_with_a_first_request(spark):
    rng = np.random.default_rng(2)
    rows = [("busy", int(s), i) for i, s in enumerate(np.cumsum(rng.integers(0, 7, 900)) - 1000)]  # also before 1970
    rows += [(f"c{c}", int(s), 1000 + 40 * c + i) for c in range(20) for i, s in enumerate(rng.integers(0, 900, 30))]
    rows += [("edge", s, 5000 + i) for i, s in enumerate((0, 59, 60, 60, 119, 120, 300, 359, 361, 420))] + [(None, 5, 6000), ("none", None, 6001), ("one", 7, 6002)]
    df = spark.createDataFrame(rows, "client string, s long, ord long").select("client", F.timestamp_seconds("s").alias("at"), "ord")
    got = {(r.client, r.at, r.ord): (r.window_start, r.rejected) for r in limits.limited(df, "client", "at", "ord", 3, 60).withColumns({c: F.unix_seconds(c) for c in ("at", "window_start")}).collect()}
    assert got == plain_limits(rows, 3, 60)
    assert limits.limited(df.limit(0), "client", "at", "ord", 3, 60).count() == 0


def line(i, **more):
    return f"data: {json.dumps({'i': i, **more})}\n\n"


def read_events(spark, path):
    return sorted(json.loads(r.event)["i"] for r in spark.read.format("event_stream").option("path", str(path)).load().collect())


def test_event_streams_are_read_once(spark, tmp_path):
    spark.dataSource.register(event_streams.EventStreams)
    folder, out, state = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/state"
    folder.mkdir()
    (folder / "_hidden").write_text(line(-1))
    (folder / "a").write_text(line(0) + ": note\nid: 7\n" + line(1) + "data: {broken\n\n" + 'data: {"i": 2')  # the last line is not whole yet

    def run():
        df = spark.readStream.format("event_stream").option("path", str(folder)).load()
        sinks.run_to_end(df, sinks.batch_writer(out), state, 120)
        return sorted(json.loads(r.event)["i"] for r in spark.read.parquet(out).collect())

    assert run() == [0, 1] == read_events(spark, folder)
    with open(folder / "a", "a") as f:
        f.write("}\n" + line(3, text="ä b"))
    (folder / "b").write_text(line(4) + "data: [DONE]\n" + line(99))
    assert run() == [0, 1, 2, 3, 4] == read_events(spark, folder)
    with open(folder / "b", "a") as f:
        f.write(line(100))
    assert run() == [0, 1, 2, 3, 4] == run()  # nothing after the end mark, and nothing twice


def test_a_batch_that_is_run_twice_leaves_one_copy(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "text string, n int")
    write = sinks.event_stream_writer(f"{tmp_path}/sent", ["text", "n"])
    for batch in (0, 1, 1, 0):
        write(df, batch)
    spark.dataSource.register(event_streams.EventStreams)
    sent = spark.read.format("event_stream").option("path", f"{tmp_path}/sent").load()
    assert sorted(r.event for r in sent.collect()) == ['{"text":"a","n":1}'] * 2 + ['{"text":"b","n":2}'] * 2
    parts = [p for p in (tmp_path / "sent" / "batch=0").iterdir() if p.name.startswith("part-")]
    assert "".join(sorted(p.read_text() for p in parts)) == 'data: {"text":"a","n":1}\n\ndata: {"text":"b","n":2}\n\n'


def test_attempts_go_on_where_they_broke_off():
    calls, waits = [], []

    def flaky(n):
        calls.append(n)
        for i in range(n, 5):
            if i == 2 * len(calls):
                raise OSError("gone")
            yield i

    assert list(event_streams.attempted(flaky, 3, 2.0, waits.append)) == [0, 1, 2, 3, 4]
    assert calls == [0, 2, 4] and waits == [2.0, 4.0]
    calls.clear()
    empty = []
    assert list(event_streams.attempted(lambda n: iter(empty.append(n) or []), 3, 2.0, waits.append)) == [] and len(empty) == 3 and len(waits) == 2
    with pytest.raises(OSError):
        list(event_streams.attempted(lambda n: (_ for _ in ()).throw(OSError("no")), 2, 0, waits.append))


def test_offsets_end_with_lines(tmp_path):
    (tmp_path / "f").write_bytes(b"data: 1\ndata: " + b"2" * 3_000_000 + b"\ntail")
    whole = event_streams.StreamReader.whole
    size = (tmp_path / "f").stat().st_size
    assert whole(str(tmp_path / "f"), 0, size) == size - 4 and whole(str(tmp_path / "f"), 0, 20) == 8
    assert whole(str(tmp_path / "f"), 8, 100) == size - 4 and whole(str(tmp_path / "f"), size - 4, size) == size - 4
    assert [at for _, at, _ in event_streams.events(str(tmp_path / "f"))] == [0, 8]
