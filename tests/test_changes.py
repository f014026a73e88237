"""Tables changed in place, sketches of days, reports, and answers that come in deltas."""

import os

import pytest
from pyspark.sql import functions as F

from cueline.operators import chat, metrics
from cueline.sources import files
from cueline.sources.keyed_table import KeyedTable


def parts(path):
    return {f"{os.path.basename(d)}/{n}" for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.range(400).select(F.col("id"), (F.col("id") % 10).alias("video"), F.lit("x").alias("text"))
    table = KeyedTable(spark, path, df.schema, "id", 16)
    assert table.read().count() == 0
    table.upsert(df)
    before = parts(path)
    assert len(before) == 16
    new = spark.createDataFrame([(7, -1, "a", 1), (7, -2, "b", 2), (1000, -3, None, 1)], "id long, video long, text string, ord int")
    table.upsert(new, "ord")
    after = parts(path)
    assert 0 < len(before - after) <= 2 and len(before & after) >= 14  # the others keep their names
    assert {tuple(r) for r in table.read().where("video < 0").collect()} == {(7, -2, "b"), (1000, -3, None)} and table.read().count() == 401
    table.delete(spark.createDataFrame([(1000,), (5000,)], "id long"))
    assert table.read().count() == 400 and not table.read().where("id = 1000").count()
    table.delete_where(F.col("video") == 4)
    assert table.read().count() == 360
    table.delete(table.read().select("id"))
    assert table.read().count() == 0 == len(parts(path))
    table.upsert(df.limit(3))
    assert table.read().count() == 3
    table.upsert(df.limit(0))
    assert table.read().count() == 3


def test_merged_sketches_are_near_the_exact_ranks(spark):
    n = 50_000
    df = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("op"), F.when(F.col("id") % 100 != 7, F.col("id") * 7919 % n).alias("ms"),
        F.timestamp_seconds(F.col("id") * 60).alias("at"),
    )
    sketches = metrics.daily_sketches(df, "op", "ms", "at")
    assert sketches.select("day").distinct().count() == 35 and sketches.agg(F.max(F.octet_length("sketch"))).first()[0] < 8192
    exact = {r.op: sorted(r.v) for r in df.where("ms is not null").groupBy("op").agg(F.collect_list("ms").alias("v")).collect()}
    for r in metrics.merged_percentiles(sketches, "op").collect():
        assert r.n == len(exact[r.op])
        for p in (50, 95, 99):
            rank = sum(v <= r[f"p{p}"] for v in exact[r.op]) / r.n
            assert abs(rank - p / 100) < 0.02
    few = metrics.merged_percentiles(metrics.daily_sketches(df.where("id < 60 and op = 'hot'"), "op", "ms", "at"), "op").first()
    assert few.p50 == sorted(exact_few(df))[len(exact_few(df)) // 2 - 1] or few.p50 in exact_few(df)
    assert metrics.merged_percentiles(metrics.daily_sketches(df.limit(0), "op", "ms", "at"), "op").count() == 0


def exact_few(df):
    return [r.ms for r in df.where("id < 60 and op = 'hot' and ms is not null").collect()]


def test_reports_are_written_twice(spark, tmp_path):
    summary = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "mode string, n int, rate double")
    files.write_report("Trials", summary, f"{tmp_path}/r")
    assert "\n".join(r.value for r in spark.read.text(f"{tmp_path}/r/markdown", wholetext=True).collect()) == "# Trials\n\n| mode | n | rate |\n|---|---|---|\n| a | 1 |  |\n| b | 2 | 0.5 |\n"
    assert [(r.mode, r.n) for r in spark.read.json(f"{tmp_path}/r/json").orderBy("n").collect()] == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_report("Trials", summary, f"{tmp_path}/r")


def test_answers_come_before_the_model_has_finished(spark):
    store = spark.createDataFrame([("c0", "A", "said", [1.0, 0.0])], "id string, video_id string, text string, embedding array<double>").withColumns(
        {"video_url": F.lit("u"), "video_title": F.lit("t"), "start_time": F.lit(0.0), "end_time": F.lit(1.0), "chunk_index": F.lit(0)}
    )
    said = []

    def model(messages, temperature):
        for part in ("One ", "twoand", ""):
            said.append(part)
            yield part

    def breaks(messages, temperature):
        yield "so far"
        raise TimeoutError("gone")

    parts_ = chat.stream(store, chat.ChatRequest("q", min_score=0.0), lambda q: [1.0, 0.0], model)
    first = next(p for p in parts_ if p["type"] == "answer")
    assert first == {"type": "answer", "content": "One ", "tokens": 1} and said == ["One "]
    rest = list(parts_)
    assert [p.get("tokens") for p in rest] == [3, 3, 3] and rest[-1] == {"type": "complete", "answer": "One twoand", "tokens": 3}
    broken = list(chat.stream(store, chat.ChatRequest("q", min_score=0.0), lambda q: [1.0, 0.0], breaks))
    assert [p["type"] for p in broken[-2:]] == ["answer", "error"] and "gone" in broken[-1]["message"]
