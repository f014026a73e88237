"""Transcripts as rows of (video_id, idx, time, text): durations, SRT and plain text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.timecode import LAST_CUE_SECONDS, add_seconds, parse_seconds, srt_stamp


def by_video() -> Window:
    return Window.partitionBy("video_id").orderBy("idx")


def segments_of(transcripts: DataFrame, key: str = "video_id", segments: str = "transcript") -> DataFrame:
    """One row for each element of an ordered array of (time, text)."""
    return transcripts.select(F.col(key).alias("video_id"), F.posexplode(segments).alias("idx", "s")).select(
        "video_id", "idx", "s.time", "s.text"
    )


def joined(order: Column, value: Column, separator: str) -> Column:
    """Aggregate: values in their order as one text."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def with_times(segments: DataFrame) -> DataFrame:
    """Add start and end seconds; a segment ends where the next starts, the last after three seconds."""
    start = parse_seconds(F.col("time"))
    return segments.withColumn("start", start).withColumn(
        "end", F.coalesce(F.lead("start").over(by_video()), F.col("start") + LAST_CUE_SECONDS)
    )


def to_srt(segments: DataFrame, stamp: Callable[[Column], Column] = srt_stamp) -> DataFrame:
    """(video_id, srt): numbered cues; a cue ends where the next starts, or after three seconds. ``stamp`` writes the times."""
    following = F.coalesce(F.nullif(F.lead("time").over(by_video()), F.lit("")), add_seconds(F.col("time"), LAST_CUE_SECONDS))
    cues = segments.withColumn("number", F.row_number().over(by_video())).withColumn("next", following)
    cue = F.concat(
        F.col("number").cast("string"), F.lit("\n"), stamp(F.col("time")), F.lit(" --> "), stamp(F.col("next")),
        F.lit("\n"), F.col("text"), F.lit("\n"),
    )
    return cues.groupBy("video_id").agg(joined(F.col("idx"), cue, "\n").alias("srt"))


def to_text(segments: DataFrame) -> DataFrame:
    """(video_id, plain_text): one line ``time text`` for each segment."""
    line = F.concat(F.col("time"), F.lit(" "), F.col("text"))
    return segments.groupBy("video_id").agg(joined(F.col("idx"), line, "\n").alias("plain_text"))
