"""Overlapping chunks of transcripts by time, by sentences or by tokens.

Input: segments (video_id, idx, time, text).  Output: chunk_id, video_id,
chunk_index, text, start_time, end_time, segment_count, metadata.  Chunks are
numbered as they are emitted, without gaps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.text import CHARS_A_TOKEN, estimated_tokens, trim_all
from cueline.functions.timecode import LAST_CUE_SECONDS, parse_seconds
from cueline.operators import grouping
from cueline.operators.transcripts import by_video, joined, with_times

STRATEGIES = ("time-based", "sentence-based", "token-based")


@dataclass
class ChunkingOptions:
    """An option left out has its default; a zero is a zero."""

    strategy: str = "time-based"
    chunk_seconds: int = 30
    overlap_seconds: int = 5
    min_length: int = 50
    max_tokens: int = 400
    overlap_tokens: int = 50


def _numbered(chunks: DataFrame, order: str) -> DataFrame:
    index = F.row_number().over(Window.partitionBy("video_id").orderBy(order)) - 1
    return chunks.withColumn("chunk_index", index).select(
        F.concat_ws("_", F.col("video_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "video_id", "chunk_index", "text", "start_time", "end_time", "segment_count", "metadata",
    )


def _metadata(strategy: str, **values) -> F.Column:
    pairs = [F.lit("strategy"), F.lit(strategy)]
    for k, v in values.items():
        pairs += [F.lit(k), v.cast("string")]
    return F.create_map(*pairs)


def chunk_by_time(segments: DataFrame, seconds: int = 30, overlap: int = 5, min_length: int = 50) -> DataFrame:
    """Windows of ``seconds`` that start every ``seconds - overlap``, over the time of each video.

    A segment is in each window that it overlaps.  Windows without segments and
    texts under ``min_length`` are left out.  Each segment finds its windows by
    arithmetic, so there is one shuffle on the video and no range join.  A segment
    without a readable time is in no window.
    """
    hop = seconds - overlap
    if seconds <= 0 or hop <= 0:
        raise ValueError("the overlap must be shorter than the window")
    whole = Window.partitionBy("video_id")
    timed = with_times(segments).withColumn("total", F.max_by("end", "idx").over(whole))
    # window w covers [w * hop, min(w * hop + seconds, total)): it meets the segment if start < its end and end > its start
    low = F.greatest(F.lit(0), F.floor((F.col("start") - seconds) / hop) + 1)
    high = F.least(F.ceil(F.col("end") / hop) - 1, F.ceil(F.col("total") / hop) - 1)
    placed = (
        timed.where("start < total").withColumn("low", low.cast("long")).withColumn("high", high.cast("long"))
        .where("low <= high").withColumn("w", F.explode(F.sequence("low", "high")))
    )
    start = F.col("w") * hop
    return _numbered(
        placed.groupBy("video_id", "w")
        .agg(
            trim_all(joined(F.col("idx"), F.col("text"), " ")).alias("text"), F.count("*").alias("segment_count"),
            F.first("total").alias("total"),
        )
        .where(F.length("text") >= min_length)
        .select(
            "video_id", "w", "text", start.cast("double").alias("start_time"),
            F.least(start + seconds, F.col("total")).cast("double").alias("end_time"), "segment_count",
            _metadata("time-based", chunkDuration=F.lit(seconds), overlapDuration=F.lit(overlap)).alias("metadata"),
        ),
        "w",
    )


def chunk_by_sentence(segments: DataFrame, min_length: int = 50) -> DataFrame:
    """Segments are gathered until one ends a sentence and the text is long enough, or the last is reached.

    Ends of groups are found in one pass over the lengths of a video's segments; texts
    are put together by an aggregate.
    """
    rows = segments.select(
        "video_id", "idx", F.coalesce(parse_seconds(F.col("time")), F.lit(0)).alias("start"), "text",
        F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.coalesce(F.col("text").rlike(r"[.!?]\s*$"), F.lit(False)).alias("ends"),
    )
    rows = grouping.cut_after(rows, "video_id", ["idx"], "n", "ends", int(min_length))
    return _numbered(
        rows.groupBy("video_id", "g").agg(
            trim_all(joined(F.col("idx"), F.col("text"), " ")).alias("text"),
            F.min_by("start", "idx").cast("double").alias("start_time"),
            (F.max_by("start", "idx") + LAST_CUE_SECONDS).cast("double").alias("end_time"),
            F.count("*").alias("segment_count"),
        ).withColumn("metadata", _metadata("sentence-based", segmentCount=F.col("segment_count"))),
        "g",
    )


def chunk_by_tokens(segments: DataFrame, max_tokens: int = 400, overlap_tokens: int = 50) -> DataFrame:
    """Windows of ``4 * max_tokens`` characters over a video's text; the first blank window ends it.

    Times are those of the first and last segment that overlap the window; a
    segment's range includes the blank that joins it to the next.
    """
    size, hop = max_tokens * CHARS_A_TOKEN, (max_tokens - overlap_tokens) * CHARS_A_TOKEN
    if size <= 0 or hop <= 0:
        raise ValueError("the overlap must be smaller than the window")
    offset = F.coalesce(F.sum(F.length("text") + 1).over(by_video().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        segments.withColumn("start", F.coalesce(parse_seconds(F.col("time")), F.lit(0))).withColumn("from", offset)
        .withColumn("to", F.col("from") + F.length("text") + 1)
        .withColumn("total", F.sum(F.length("text") + 1).over(Window.partitionBy("video_id")) - 1)
    )
    # window w covers [w * hop, min(w * hop + size, total)): it meets the segment if from < its end and to > its start
    low = F.greatest(F.lit(0), F.floor((F.col("from") - size) / hop) + 1).cast("long")
    high = F.least(F.ceil(F.col("to") / hop) - 1, F.ceil(F.col("total") / hop) - 1).cast("long")
    met = (
        placed.withColumn("low", low).withColumn("high", high).where("low <= high and from < total")
        .withColumn("w", F.explode(F.sequence("low", "high")))
    )
    # the piece of the segment, with the blank after it, that lies in the window
    begin = F.greatest(F.col("w") * hop - F.col("from"), F.lit(0))
    until = F.least(F.col("w") * hop + size, F.col("total")) - F.col("from")
    piece = F.substring(F.concat("text", F.lit(" ")), (begin + 1).cast("int"), (until - begin).cast("int"))
    text = trim_all(joined(F.col("idx"), piece, ""))
    windows = met.groupBy("video_id", "w").agg(
        text.alias("text"), F.min_by("start", "idx").cast("double").alias("start_time"),
        (F.max_by("start", "idx") + LAST_CUE_SECONDS).cast("double").alias("end_time"), F.count("*").alias("segment_count"),
    )
    so_far = Window.partitionBy("video_id").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    return _numbered(
        windows.withColumn("all", F.min((F.length("text") > 0).cast("int")).over(so_far)).where("all = 1").withColumn(
            "metadata",
            _metadata(
                "token-based", maxTokens=F.lit(max_tokens), overlapTokens=F.lit(overlap_tokens),
                approximateTokens=estimated_tokens(F.col("text")),
            ),
        ),
        "w",
    )


def chunk(segments: DataFrame, options: ChunkingOptions | None = None) -> DataFrame:
    o = options or ChunkingOptions()
    if o.strategy == "time-based":
        return chunk_by_time(segments, o.chunk_seconds, o.overlap_seconds, o.min_length)
    if o.strategy == "sentence-based":
        return chunk_by_sentence(segments, o.min_length)
    if o.strategy == "token-based":
        return chunk_by_tokens(segments, o.max_tokens, o.overlap_tokens)
    raise ValueError(f"unknown chunking strategy: {o.strategy}")


def recommend(segments: DataFrame) -> DataFrame:
    """(video_id, avg_length, duration, strategy, chunk_seconds, overlap_seconds, min_length) for each video."""
    stats = segments.groupBy("video_id").agg(
        F.avg(F.length("text")).alias("avg_length"),
        (F.max_by(parse_seconds(F.col("time")), "idx") + LAST_CUE_SECONDS).alias("duration"),
    )
    sentence = (F.col("avg_length") > 100) & (F.col("duration") > 300)
    short = F.col("duration") < 180
    return stats.select(
        "*",
        F.when(sentence, F.lit("sentence-based")).otherwise(F.lit("time-based")).alias("strategy"),
        F.when(sentence, F.lit(None)).when(short, F.lit(20)).otherwise(F.lit(30)).alias("chunk_seconds"),
        F.when(sentence, F.lit(None)).when(short, F.lit(3)).otherwise(F.lit(5)).alias("overlap_seconds"),
        F.when(sentence, F.lit(100)).otherwise(F.lit(None)).alias("min_length"),
    )


def chunk_recommended(segments: DataFrame) -> DataFrame:
    """Each video by the strategy recommended for it."""
    chosen = segments.join(recommend(segments).select("video_id", "strategy", "chunk_seconds"), "video_id")
    columns = segments.columns
    return (
        chunk_by_sentence(chosen.where("strategy = 'sentence-based'").select(*columns), 100)
        .unionByName(chunk_by_time(chosen.where("strategy = 'time-based' and chunk_seconds = 20").select(*columns), 20, 3))
        .unionByName(chunk_by_time(chosen.where("strategy = 'time-based' and chunk_seconds = 30").select(*columns), 30, 5))
    )


def preview(chunks: DataFrame) -> DataFrame:
    """(video_id, chunk_count, avg_chunk_length, total_text) of each video's chunks; the average rounds halves up."""
    total = joined(F.col("chunk_index"), F.col("text"), " ")
    return chunks.groupBy("video_id").agg(F.count("*").alias("chunk_count"), total.alias("total_text")).select(
        "video_id", "chunk_count",
        F.floor(F.length("total_text") / F.col("chunk_count") + 0.5).cast("long").alias("avg_chunk_length"), "total_text",
    )
