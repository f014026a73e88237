"""Cache, jobs, batches and metrics on the scenarios of the survey."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cueline.operators import batches, cache, jobs, metrics, snapshots

NOW = datetime(2025, 6, 10, 12)
CACHE = "video_id string, transcript string, extracted_at timestamp, last_accessed_at timestamp, access_count int, error_code string"


def cached(spark, rows):
    return spark.createDataFrame([(i, t, x, a, n, None) for i, t, x, a, n in rows], CACHE)


def lru(spark, n, size=10):
    return cached(spark, [(f"v{k:03d}", "x" * size, NOW, NOW + timedelta(seconds=k), 1) for k in range(n)])


def test_oldest_are_evicted(spark):
    assert sorted(r.video_id for r in cache.evict_oldest(lru(spark, 10), 3).collect()) == [f"v{k:03d}" for k in range(3, 10)]
    assert cache.evict_oldest(lru(spark, 10), 20).count() == 0


@pytest.mark.parametrize("n", [1, 5, 37, 150, 399, 400, 401])
def test_many_are_evicted_by_a_bracket(spark, monkeypatch, n):
    """Beyond FEW rows quantiles bracket the cutoff, with ties and rows without a time; an estimate may be off."""
    monkeypatch.setattr(cache, "FEW", 0)
    rows = [(f"v{k:03d}", None if k % 10 == 0 else NOW + timedelta(seconds=k * 7919 % 60)) for k in range(400)]
    df = cached(spark, [(i, "x", NOW, at, 1) for i, at in rows])
    left = [i for i, at in sorted(rows, key=lambda r: (r[1] is not None, r[1] or NOW, r[0]))][n:]
    for slack in (0.001, 0.2):
        monkeypatch.setattr(cache, "SLACK", slack)
        assert sorted(r.video_id for r in cache.evict_oldest(df, n).collect()) == sorted(left)


def test_policies(spark):
    left, report = cache.run_eviction(lru(spark, 8), cache.EvictionPolicy("lru", max_entries=5), NOW)
    assert left.count() == 5 and report["evicted"] == 3 and report["entries_before"] == 8
    old = cached(spark, [("a", "t", NOW, NOW - timedelta(days=10), 1), ("b", "t", NOW, NOW - timedelta(days=2), 1), ("c", "t", NOW, NOW - timedelta(days=7), 1)])
    left, report = cache.run_eviction(old, cache.EvictionPolicy("ttl", ttl_days=7), NOW)
    assert sorted(r.video_id for r in left.collect()) == ["b", "c"] and report["evicted"] == 1
    assert cache.run_eviction(old, cache.EvictionPolicy("none"), NOW)[1]["evicted"] == 0
    with pytest.raises(ValueError):
        cache.run_eviction(old, cache.EvictionPolicy("other"), NOW)


def test_one_tenth_goes_for_size(spark):
    left, report = cache.run_eviction(lru(spark, 95, 2000), cache.EvictionPolicy("lru", max_megabytes=0.1), NOW)
    assert report["evicted"] == 10 and left.count() == 85


def test_touch_and_get(spark):
    c = lru(spark, 2)
    for _ in range(6):
        row, c = cache.get(c, "v001", NOW + timedelta(days=1))
    assert row.first().access_count == 7 and row.first().last_accessed_at == NOW + timedelta(days=1)
    assert cache.lookup(c, "v000").first().access_count == 1
    assert cache.exists(c, "v000") and not cache.exists(c, "none")
    assert cache.get(c, "none", NOW)[0].count() == 0


def test_cache_stats(spark):
    c = cached(spark, [("a", "abc", datetime(2025, 1, 1), NOW, 3), ("b", "ü😀", datetime(2025, 12, 1), NOW, 3)])
    r = cache.stats(c).first()
    assert (r.total_entries, r.oldest_entry, r.newest_entry, r.most_accessed, r.size_chars) == (2, datetime(2025, 1, 1), datetime(2025, 12, 1), "b", 5)
    r = cache.stats(c.limit(0)).first()
    assert (r.total_entries, r.oldest_entry, r.most_accessed, r.size_chars) == (0, None, None, 0)


def test_hit_rate(spark):
    asked = spark.createDataFrame([(f"v{k:03d}",) for k in range(10)], "video_id string")
    assert cache.hit_rate(asked, lru(spark, 7)).first().hit_rate == 70
    assert cache.hit_rate(asked.limit(0), lru(spark, 1)).first().hit_rate == 0


def test_upsert_insert_delete(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 0), (3, "y", 1), (2, "z", 2)], "k int, v string, ord int")
    assert sorted(map(tuple, snapshots.upsert(t, new, "k", "ord").collect())) == [(1, "a"), (2, "z"), (3, "y")]
    with pytest.raises(snapshots.DuplicateKey):
        snapshots.insert(t, new, "k")
    assert snapshots.insert(t, new.where("k = 3"), "k").count() == 3
    assert snapshots.append(t, new.limit(0)).count() == 2
    assert snapshots.delete(t, F.col("k") == 9).count() == 2 and snapshots.clear(t).count() == 0
    assert sorted(map(tuple, snapshots.replace_for(t, new, "k").select("k").collect())) == [(1,), (2,), (2,), (3,)]
    parents, children = snapshots.delete_with_children(t, t.withColumnRenamed("k", "p"), t.where("k = 1"), "k", "p")
    assert [r.k for r in parents.collect()] == [2] and [r.p for r in children.collect()] == [2]


def jobs_of(spark, statuses):
    rows = [(f"j{i}", "batch", s, NOW + timedelta(minutes=i), NOW - timedelta(days=i) if s == "completed" else None) for i, s in enumerate(statuses)]
    return spark.createDataFrame(rows, "job_id string, type string, status string, created_at timestamp, completed_at timestamp")


def test_job_summary(spark):
    j = jobs_of(spark, ["pending"] * 2 + ["processing"] * 3 + ["completed"] * 2 + ["failed"])
    assert tuple(jobs.summary(j).first()) == (8, 2, 3, 2, 1, 0)
    assert tuple(jobs.summary(j.limit(0)).first()) == (0,) * 6
    assert [r.job_id for r in jobs.recent(j, 2).collect()] == ["j7", "j6"]
    assert [r.job_id for r in jobs.by_status(j, "pending", "batch").collect()] == ["j1", "j0"]
    assert jobs.by_status(j, "pending", "playlist").count() == 0
    assert jobs.purge(j, 5, NOW).count() == 7  # j5 ended exactly five days ago and stays
    with pytest.raises(snapshots.DuplicateKey):
        jobs.create(j, j.limit(1))


def test_job_state(spark):
    log = [
        ("a", 1, "status", "processing", 0, None), ("a", 2, "status", "processing", 0, "slow"), ("a", 3, "progress", None, 4, None),
        ("a", 4, "status", "processing", 0, None), ("b", 1, "fail", "failed", 0, "broke"), ("c", 1, "complete", "completed", 9, None), ("d", 1, "abort", "aborted", 0, None),
    ]
    events = spark.createDataFrame([(j, s, NOW + timedelta(seconds=s), k, st, p, 0, 0, m) for j, s, k, st, p, m in log], "job_id string, seq long, at timestamp, kind string, status string, processed int, successful int, failed int, message string")
    got = {r.job_id: (r.status, r.processed, r.error_message, r.completed_at is not None) for r in jobs.current_state(events).collect()}
    assert got == {"a": ("processing", 4, None, False), "b": ("failed", 0, "broke", True), "c": ("completed", 9, None, True), "d": ("aborted", 0, None, True)}


def test_batches(spark):
    addresses = [f"https://youtu.be/{i:011d}" for i in (1, 2, 1, 3)] + ["bad"]
    asked = batches.requested(spark.createDataFrame(list(enumerate(addresses)), "ord int, url string"))
    assert [(r.ord, int(r.video_id)) for r in asked.collect()] == [(0, 1), (1, 2), (3, 3)]
    assert batches.requested(asked.select("ord", "url"), 2).count() == 2
    kind = "video_id string, success boolean, error_code string, plain_text string"
    old = spark.createDataFrame([(f"{1:011d}", True, None, "old")], kind)
    fresh = spark.createDataFrame([(f"{1:011d}", True, None, "new"), (f"{2:011d}", False, "TIMEOUT", None)], kind)
    assert batches.misses(asked, old).count() + batches.hits(asked, old.drop("success")).count() == 3
    got = [(r.result_source, r.success, r.error_code, r.plain_text) for r in batches.merge(asked, old, fresh, ["plain_text"]).orderBy("ord").collect()]
    assert got == [("cache", True, None, "old"), ("fresh", False, "TIMEOUT", None), ("none", False, "NOT_FOUND", None)]
    unparsed = spark.createDataFrame([(1, None)], "ord int, video_id string")
    assert batches.misses(unparsed, old).count() == 1
    counted = batches.counters(spark.createDataFrame([(True, 10), (False, 5)], "success boolean, elapsed_ms int")).first()
    assert tuple(counted) == (2, 1, 1, 15, 8)
    assert batches.counters(spark.createDataFrame([], "success boolean, elapsed_ms int")).first().avg_ms == 0


def test_latencies_use_floor_ranks_of_the_last_hundred(spark):
    rows = spark.range(150).select(F.lit("op").alias("op"), F.col("id").cast("double").alias("ms"), F.col("id").alias("at"))
    r = metrics.latency_summary(rows, "op", "ms", ["at"]).first()
    assert (r["count"], r.min, r.max, r.avg, r.p50, r.p95, r.p99) == (100, 50, 149, 99.5, 100, 145, 149)
    assert metrics.launch_summary(rows.limit(0), "ms", ["at"]).first().asDict() == {"count": 0, "min": None, "max": None, "avg": None, "p95": None}


def test_trials(spark):
    rows = [("a", True, 10.0, None), ("a", False, 99.0, "timeout"), ("b", False, 5.0, "blocked x"), ("b", False, 5.0, None)]
    trials = spark.createDataFrame(rows, "mode string, success boolean, duration double, message string")
    got = {r["mode"]: (r.total, r.success_rate, r.avg_duration) for r in metrics.trial_summary(trials).collect()}
    assert got == {"a": (2, 50.0, 10.0), "b": (2, 0.0, 0.0)}
    assert {r["mode"]: r.errors for r in metrics.error_map(trials).collect()} == {"a": {"TIMEOUT": 1}, "b": {"BLOCKED_BY_YOUTUBE": 1, "UNKNOWN": 1}}


@pytest.mark.parametrize("values, said", [((90, 90, 0, 6), "KEEP_MANDATORY"), ((70, 85, 0, 0), "DISABLE"), ((90, 80, 0, 5), "KEEP_RECOMMENDED"), ((90, 88, 3, 2), "NO_CLEAR_WINNER")])
def test_recommendation(spark, values, said):
    row = spark.range(1).select(metrics.recommendation(*[F.lit(v) for v in values]).alias("r")).first()
    assert row.r == said


def test_high_water_mark(spark):
    rows = spark.range(5)
    assert metrics.newer_than(rows, rows.where("id < 3"), "id").count() == 2
    assert metrics.newer_than(rows, rows.limit(0), "id").count() == 5
