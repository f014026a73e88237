"""Records, stores, providers, logs, life cycles of jobs, and evictions of any size."""

import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cueline.operators import batches, cache, chunking, embedding, metrics, providers, records, search, snapshots
from cueline.sources import files
from cueline.streaming import progress

NOW = datetime(2025, 6, 10, 12, 30, 5)


def test_transcripts_are_read_and_empty_values_absent(spark):
    row = ("v", "u", "", '[{"time":"0:05","text":"said"}]', "", "plain", 0, "", None)
    bad = ("w", "u", "t", "no json", "s", "", 9, "CODE", "m")
    kind = "video_id string, video_url string, video_title string, transcript_json string, srt_text string, plain_text string, extraction_time_ms int, error_code string, error_message string"
    got = {r.video_id: r for r in records.transcripts(spark.createDataFrame([row, bad], kind)).collect()}
    assert [(s.time, s.text) for s in got["v"].transcript] == [("0:05", "said")] and not got["w"].transcript
    assert (got["v"].video_title, got["v"].srt, got["v"].text, got["v"].extraction_time_ms, got["v"].error_code) == (None, None, "plain", None, None)
    assert (got["w"].video_title, got["w"].srt, got["w"].text, got["w"].extraction_time_ms, got["w"].error_code) == ("t", "s", None, 9, "CODE")
    back = records.encoded(records.transcripts(spark.createDataFrame([row], kind)), "transcript").first()
    assert back.transcript == '[{"time":"0:05","text":"said"}]'


def test_jobs_and_results(spark):
    made = records.jobs(spark.createDataFrame([("a", "", '{"k":1}'), ("b", "e", ""), ("c", None, None)], "id string, error_message string, metadata string"))
    assert {(r.id, r.error_message, str(r.metadata)) for r in made.collect()} == {("a", None, "{'k': '1'}"), ("b", "e", "None"), ("c", None, "None")}
    made = records.job_results(spark.createDataFrame([(1, "", 0), (0, "E", 5), (None, None, None)], "success int, error_code string, processing_time_ms int"))
    assert sorted(tuple(map(str, r)) for r in made.collect()) == [("False", "E", "5"), ("False", "None", "None"), ("True", "None", "None")]


def test_health(spark):
    good = {"one": spark.range(3), "two": spark.range(0)}
    assert records.health(good) == {"healthy": True, "tables": {"one": 3, "two": 0}}
    broken = spark.range(1).select(F.raise_error(F.lit("gone")).alias("x")).where("x is not null")
    report = records.health({"broken": broken})
    assert not report["healthy"] and "gone" in report["error"]


def test_providers():
    assert providers.providers({}) == providers.Providers()
    assert providers.providers({"LLM_PROVIDER": "openai", "OPENAI_API_KEY": "k"}).model == "openai"
    assert providers.check({"ENABLE_RAG": "false", "LLM_PROVIDER": "x"}) == []
    assert len(providers.check({"EMBEDDING_PROVIDER": "x", "LLM_PROVIDER": "openai", "VECTOR_STORE": "memory"})) == 2
    with pytest.raises(providers.NotConfigured):
        providers.providers({"VECTOR_STORE": "tape"})


def test_formats_logs_backups_and_missing_tables(spark, tmp_path):
    assert files.check_format(None) == "json" and files.check_format("srt") == "srt"
    with pytest.raises(files.InvalidFormat):
        files.check_format("pdf")
    events = spark.createDataFrame([("embed", 1.5)], "op string, ms double")
    for _ in range(2):
        files.append_log(metrics.metric_records(events, "op", "ms"), str(tmp_path / "log"), NOW)
    logged = spark.read.json(str(tmp_path / "log"))
    assert {(r.message, r.duration, str(r.day)) for r in logged.collect()} == {("Performance: embed", 1.5, "2025-06-10")} and logged.count() == 2
    path = snapshots.backup(spark.range(4), str(tmp_path), NOW)
    assert path.endswith("/transcripts-2025-06-10T12-30-05") and spark.read.parquet(path).count() == 4
    with pytest.raises(Exception, match="exists"):
        snapshots.backup(spark.range(4), str(tmp_path), NOW)
    where = str(tmp_path / "vectors")
    assert snapshots.create_if_missing(spark, where, "id long").count() == 0
    spark.range(2).write.mode("append").parquet(where)
    assert snapshots.create_if_missing(spark, where, "id long").count() == 2


def test_addresses_and_requests_from_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  two \n")
    assert [r.url for r in files.read_addresses(spark, str(tmp_path / "a.txt")).orderBy("ord").collect()] == ["one", "two"]
    (tmp_path / "r.json").write_text('{"query":"q","limit":3}\n')
    assert tuple(files.read_json(spark, str(tmp_path / "r.json"), "query string, limit int").first()) == ("q", 3)
    assert files.report("T", spark.createDataFrame([(1, None)], "a int, b string")) == "# T\n\n| a | b |\n|---|---|\n| 1 |  |\n"


def test_a_store(spark):
    rows = spark.createDataFrame([(1, "v", 0.0, [1.0, 0.0]), (2, "w", 5.0, [0.0, 1.0])], "id long, video_id string, start_time double, embedding array<double>")
    store = search.VectorStore(rows)
    store.upsert(rows.where("id = 2").withColumn("video_id", F.lit("x")))
    store.add(rows.where("id = 1").withColumn("id", F.lit(3).cast("long")))
    assert [r.id for r in store.search([1.0, 0.1], 2).collect()] == [1, 3]
    both = search.Filters(video_id="x", video_ids=["v"])
    assert store.search([1.0, 0.0], filters=both).count() == 0
    both.list_replaces_id = True
    assert store.search([1.0, 0.0], filters=both).count() == 2
    store.delete_video("v")
    assert tuple(store.stats().first()) == (1, 1)
    store.clear()
    assert store.rows.count() == 0


def test_pooling(spark):
    made = spark.createDataFrame([(1, [[3.0, 0.0], [0.0, 0.0], [0.0, 3.0]]), (2, []), (3, None), (4, [[1.0], [-1.0]]), (5, [[0.0, 2.0]])], "id int, t array<array<double>>")
    got = {r.id: r.p for r in made.select("id", embedding.mean_pooled(F.col("t")).alias("p")).collect()}
    assert got[1] == pytest.approx([0.5**0.5] * 2) and got[2] is None and got[3] is None and got[4] == [0.0] and got[5] == [0.0, 1.0]


def test_pooling_takes_time_in_proportion_to_the_length(spark):
    """Rows of 2,048 take minutes where the length is computed anew for each element."""
    rows = spark.range(8).select(F.transform(F.sequence(F.lit(1), F.lit(2048)), lambda x: (x % 7 + F.col("id")).cast("double")).alias("v"))
    tokens = F.array("v", F.transform("v", lambda x: F.lit(1.0)))
    begun = time.monotonic()
    got = [(r.v, r.p) for r in rows.select("v", embedding.mean_pooled(tokens).alias("p")).collect()]
    assert time.monotonic() - begun < 30
    for v, p in got:
        length = sum(((x + 1) / 2) ** 2 for x in v) ** 0.5
        assert p == pytest.approx([(x + 1) / 2 / length for x in v])


def test_the_life_of_jobs(spark):
    jobs = spark.createDataFrame([("c", 2, "completed", None), ("f", 2, "failed", "boom"), ("a", 3, "aborted", None), ("n", 1, "aborted", None)], "job_id string, total int, status string, error string").withColumns({"started_at": F.lit(NOW), "ended_at": F.lit(NOW)})
    items = spark.createDataFrame([("c", 0, True, None), ("c", 1, False, "x"), ("a", 0, False, None)], "job_id string, idx int, success boolean, error string").withColumns({"video_id": F.lit("v"), "started_at": F.lit(NOW), "ended_at": F.lit(NOW)})
    made = progress.lifecycle(items, jobs)
    got = [(r.job_id, r.seq, r.status, r.done, r.message) for r in made.orderBy("job_id", "seq").collect()]
    assert got == [
        ("a", 0, "started", 0, None), ("a", 1, "processing", 0, None), ("a", 2, "processing", 1, "failed"), ("a", 7, "aborted", 1, None),
        ("c", 0, "started", 0, None), ("c", 1, "processing", 0, None), ("c", 2, "processing", 1, None), ("c", 3, "processing", 1, None), ("c", 4, "processing", 2, "x"), ("c", 5, "completed", 2, None),
        ("f", 0, "started", 0, None), ("f", 5, "failed", 0, "boom"), ("n", 0, "started", 0, None), ("n", 3, "aborted", 0, None),
    ]
    assert progress.latest(made).where("status = 'completed'").count() == 1


def test_batches_that_are_split_or_aborted(spark):
    rows = spark.createDataFrame([("j", 1, True), ("j", 2, False), ("k", 3, None)], "job_id string, n int, success boolean").withColumn("created_at", F.timestamp_seconds("n"))
    ok, failed = batches.split(rows)
    assert [r.n for r in ok.collect()] == [1] and sorted(r.n for r in failed.collect()) == [2, 3]
    aborts = spark.createDataFrame([("j", 1)], "job_id string, s int").select("job_id", F.timestamp_seconds("s").alias("aborted_at"))
    assert sorted(r.n for r in batches.before_abort(rows, aborts).collect()) == [1, 3]


@pytest.mark.parametrize("n", [0, 1, 7, 50, 119, 120, 200])
def test_any_number_is_evicted(spark, n):
    rng = random.Random(n)
    rows = [(k, datetime.fromtimestamp(rng.choice([0, 5, 1e9, 1e9 + 1e-6 * rng.randrange(5)])) if k % 10 else None) for k in range(120)]
    df = spark.createDataFrame(rows, "video_id long, last_accessed_at timestamp")
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or NOW, r[0]))
    assert sorted(r.video_id for r in cache.evict_oldest(df, n).collect()) == sorted(k for k, _ in order[n:])


def test_long_videos_are_chunked_by_sentences(spark):
    segs = spark.range(3000).select(F.lit("v").alias("video_id"), F.col("id").alias("idx"), F.lit("0:01").alias("time"), F.when(F.col("id") % 3 == 2, "Done now.").otherwise("and so").alias("text"))
    made = chunking.chunk_by_sentence(segs, 10).orderBy("chunk_index").collect()
    assert len(made) == 1000 and {r.text for r in made} == {"and so and so Done now."}


def test_approximate_percentiles(spark):
    df = spark.range(1001).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    assert [round(x) for x in metrics.percentiles(df, "k", "v", 10_000).first()[1:]] == [500, 950, 990]
