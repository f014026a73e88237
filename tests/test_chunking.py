import pytest
from pyspark.sql import functions as F

from cueline.operators import chunking, transcripts
from tests.fixtures import GOLDEN, TRANSCRIPT_A, TRANSCRIPT_B


@pytest.fixture(scope="module")
def segments(spark):
    rows = [(v, i, t, x) for v, s in (("A", TRANSCRIPT_A), ("B", TRANSCRIPT_B)) for i, (t, x) in enumerate(s)]
    return spark.createDataFrame(rows, "video_id string, idx int, time string, text string").repartition(3).cache()


@pytest.mark.parametrize("case", GOLDEN, ids=str)
def test_golden_chunks(segments, case):
    video, kind, a, b = case
    own = segments.where(F.col("video_id") == video)
    made = {"time": lambda: chunking.chunk_by_time(own, a, b), "sentence": lambda: chunking.chunk_by_sentence(own, a), "token": lambda: chunking.chunk_by_tokens(own, a, b)}[kind]()
    got = [(r.chunk_index, r.start_time, r.end_time, r.segment_count, len(r.text)) for r in made.orderBy("chunk_index").collect()]
    assert got == GOLDEN[case]


def test_sentences_of_b_stand_alone(segments):
    made = chunking.chunk_by_sentence(segments.where("video_id = 'B'"), 50).orderBy("chunk_index").collect()
    assert [(r.chunk_index, len(r.text)) for r in made] == list(enumerate([58, 60, 72, 72, 60, 68, 63, 66, 74, 60]))
    assert all(r.end_time == r.start_time + 3 for r in made)


def test_chunk_ids_and_metadata(segments):
    row = chunking.chunk(segments.where("video_id = 'A'"), chunking.ChunkingOptions("token-based", max_tokens=100, overlap_tokens=20)).where("chunk_index = 1").first()
    assert row.chunk_id == "A_1"
    assert row.metadata == {"strategy": "token-based", "maxTokens": "100", "overlapTokens": "20", "approximateTokens": "46"}


@pytest.mark.parametrize("options", [("time-based", 5, 5), ("time-based", 0, 0), ("none", 1, 0)])
def test_endless_and_unknown_options_are_refused(segments, options):
    with pytest.raises(ValueError):
        chunking.chunk(segments, chunking.ChunkingOptions(options[0], chunk_seconds=options[1], overlap_seconds=options[2]))
    with pytest.raises(ValueError):
        chunking.chunk_by_tokens(segments, 10, 10)


def test_empty_and_unreadable(spark):
    kind = "video_id string, idx int, time string, text string"
    empty = spark.createDataFrame([], kind)
    assert chunking.chunk_by_time(empty).count() == chunking.chunk_by_tokens(empty).count() == chunking.chunk_by_sentence(empty).count() == 0
    odd = spark.createDataFrame([("v", 0, "a:b", "x" * 60), ("v", 1, "0:05", "y" * 60), ("v", 2, "invalid", "z" * 60)], kind)
    times = transcripts.with_times(odd).orderBy("idx").select("start", "end").collect()
    assert [tuple(r) for r in times] == [(None, 5), (5, 0), (0, 3)]
    # the total is the last segment's end, 3: the second segment starts after it
    assert [r.text[0] for r in chunking.chunk_by_time(odd).collect()] == ["z"]


def test_blank_window_ends_the_tokens(spark):
    rows = [("v", 0, "0:00", "abcd"), ("v", 1, "0:05", " " * 30), ("v", 2, "0:10", "tail")]
    made = chunking.chunk_by_tokens(spark.createDataFrame(rows, "video_id string, idx int, time string, text string"), 2, 0)
    assert [(r.chunk_index, r.text) for r in made.collect()] == [(0, "abcd")]


def test_recommendation_and_preview(segments, spark):
    got = {r.video_id: (r.strategy, r.chunk_seconds, r.overlap_seconds) for r in chunking.recommend(segments).collect()}
    assert got == {"A": ("time-based", 20, 3), "B": ("time-based", 20, 3)}
    long = spark.createDataFrame([("v", i, f"{i}:00", "x" * 101) for i in range(6)], "video_id string, idx int, time string, text string")
    assert chunking.recommend(long).first().strategy == "sentence-based"
    assert chunking.chunk_recommended(segments).count() == 11
    shown = chunking.preview(chunking.chunk_by_time(segments, 30, 5)).where("video_id = 'A'").first()
    assert shown.chunk_count == 3 and len(shown.total_text) == 233 + 230 + 177 + 2 and shown.avg_chunk_length == 214


def test_every_segment_is_in_a_window(segments):
    made = chunking.chunk_by_time(segments, 20, 3, 0)
    texts = made.groupBy("video_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("all"))
    missed = segments.join(texts, "video_id").where(~F.contains(F.col("all"), F.col("text")))
    assert missed.count() == 0
