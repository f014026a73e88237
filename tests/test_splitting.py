"""Greedy groups, chunks by meaning, and recursive splitting, against plain versions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline.operators import chunking, grouping, splitting


def plain_cuts(lengths, ends, least):
    out, acc, g = [], 0, 0
    for n, e in zip(lengths, ends):
        acc = n if acc == 0 else acc + 1 + n
        out.append(g)
        if e and acc >= least:
            acc, g = 0, g + 1
    return out


def plain_fill(lengths, most):
    out, acc, g = [], None, 0
    for n in lengths:
        if acc is not None and acc + n > most:
            acc, g = None, g + 1
        acc = n if acc is None else acc + n
        out.append(g)
    return out


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_in_any_batches(spark, small_batches):
    rng = np.random.default_rng(6)
    rows = [(k, i, int(rng.choice([0, 0, 1, 5, 12, 40])), bool(rng.random() < 0.4)) for k in [*range(12), None] for i in range(int(rng.integers(1, 60)))]
    df = spark.createDataFrame(rows, "k long, i int, n int, e boolean").repartition(5)
    of = {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}
    for least in (0, 1, 20, 100):
        got = {(r.k, r.i): r.g for r in grouping.cut_after(df, "k", ["i"], "n", "e", least).collect()}
        assert got == {(k, r[1]): g for k, own in of.items() for r, g in zip(own, plain_cuts([r[2] for r in own], [r[3] for r in own], least))}
    for most in (1, 13, 100):
        got = {(r.k, r.i): r.g for r in grouping.fill_up(df, "k", ["i"], "n", most).collect()}
        assert got == {(k, r[1]): g for k, own in of.items() for r, g in zip(own, plain_fill([r[2] for r in own], most))}


def test_one_long_video_takes_linear_time(spark):
    took = []
    for n in (20_000, 200_000):
        segments = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("idx"), F.lit("0:01").alias("time"), F.lit("Some words.").alias("text"))
        began = time.perf_counter()
        assert chunking.chunk_by_sentence(segments, 1).count() == n
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * max(took[0], 0.5)


def test_null_texts_and_empty_tables_of_segments(spark):
    segments = spark.createDataFrame([("v", 0, "0:00", None), ("v", 1, "0:05", "One."), ("v", 2, "0:09", ""), ("v", 3, None, "Two. ")], "video_id string, idx int, time string, text string")
    got = chunking.chunk_by_sentence(segments, 3).orderBy("chunk_index").collect()
    assert [(r.text, r.segment_count) for r in got] == [("One.", 2), ("Two.", 2)]


def vector(*x):
    return [float(v) for v in x]


def test_meaning_breaks(spark):
    rows = [("v", 0, "a", vector(1, 0)), ("v", 1, "b", vector(1, 0.1)), ("v", 2, "c", vector(0, 1)), ("v", 3, "d", vector(0, 1)), ("v", 4, "e", vector(0.2, 1)), ("w", 0, "x", None), ("w", 1, "y", vector(0, 0)), ("w", 2, "z", vector(1, 2, 3))]
    df = spark.createDataFrame(rows, "video_id string, idx int, text string, embedding array<double>")
    assert [r.breaks for r in splitting.semantic_breaks(df, 0.5).orderBy("video_id", "idx").collect()] == [True, False, True, False, False, True, False, False]
    assert sorted(tuple(r) for r in splitting.chunk_by_meaning(df, 0.5).collect()) == [("v", 0, "a b", 2, 0), ("v", 1, "c d e", 3, 2), ("w", 0, "x y z", 3, 0)]
    assert splitting.chunk_by_meaning(df.limit(0)).count() == 0


def plain_split(text, most):
    pieces = [text]
    for separator in splitting.SEPARATORS:
        new = []
        for p in pieces:
            parts = p.split(separator) if len(p) > most else [p]
            new += [x for x in [x + separator for x in parts[:-1]] + parts[-1:] if x]
        pieces = new
    pieces = [p[k : k + most] for p in pieces for k in range(0, len(p), most)]
    groups = plain_fill([len(p) for p in pieces], most)
    return ["".join(p for p, g in zip(pieces, groups) if g == k) for k in range(max(groups) + 1)]


@pytest.mark.parametrize("most", [1, 9, 40])
def test_texts_are_split_and_lose_nothing(spark, small_batches, most):
    rng = np.random.default_rng(most)
    texts = ["".join(rng.choice(["a", "Ä𝄞", " ", ". ", "\n", "\n\n", "word", "."], int(rng.integers(1, 120)))) for _ in range(40)] + ["x" * 500, "\n\n\n\n", " ", "ends. "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "id long, text string").repartition(3)
    got = splitting.split_recursively(df, "id", "text", most).orderBy("id", "chunk_index").collect()
    for i, text in enumerate(texts):
        own = [r.chunk for r in got if r.id == i]
        assert own == plain_split(text, most) and "".join(own) == text and all(len(c) <= most for c in own)
    assert {r.id for r in got} == set(range(len(texts)))
    with pytest.raises(ValueError):
        splitting.split_recursively(df, "id", "text", 0)
