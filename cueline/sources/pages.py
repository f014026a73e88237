"""Snapshots of web pages as sources: transcripts, video lists and links, with built-in text functions where markup is flat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions.text import trim_all
from cueline.functions.urls import channel_handle, channel_id
from cueline.sources.markup import TranscriptRows

VIDEO_LINK = r"[?&]v=([a-zA-Z0-9_-]{11})"


def strip_tags(html: Column) -> Column:
    plain = F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", "")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    return trim_all(plain)


def _with_rows(pages: DataFrame, key: str, html: str, always: bool) -> DataFrame:
    # what marks a transcript has this word in it; other pages don't leave the JVM
    marked = F.when(F.contains(F.lower(F.col(html)), F.lit("transcript")), F.col(html))
    return pages.select(key, marked.alias("html")).lateralJoin(TranscriptRows(F.col("html").outer(), F.lit(always)))


def transcript_segments(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, idx, time, text) from the transcript elements of pages, each read by itself, nested and unclosed markup too.

    Pages without any are searched in other containers, the first with rows
    wins.  Rows without a time or a text are dropped, and idx counts the rest.
    """
    return _with_rows(pages, key, html, False).select(key, "idx", "time", "text")


def without_transcript(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Pages that yield no segment, with the code NO_TRANSCRIPT; found in the same pass over the pages."""
    return _with_rows(pages, key, html, True).where("idx is null").select(key, F.lit("NO_TRANSCRIPT").alias("error_code"))


def video_ids(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, title, channel_id, channel_handle, video_ids): distinct ids in order of first sight."""
    title = strip_tags(F.regexp_extract(F.col(html), r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    return pages.select(
        key, title.alias("title"), channel_id(F.col(key)).alias("channel_id"), channel_handle(F.col(key)).alias("channel_handle"),
        F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(VIDEO_LINK), F.lit(1))).alias("video_ids"),
    )


def links(html: Column) -> Column:
    """Distinct targets of a page's links, in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1)))
