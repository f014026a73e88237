"""Small text functions: trimming, sentence ends, token estimates, lookups and message classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_A_TOKEN = 4

# Error classes by what a message contains, the first that fits; matching minds the case.
ERROR_SIGNS = [
    ("NO_TRANSCRIPT", "NO_TRANSCRIPT"),
    ("timeout", "TIMEOUT"),
    ("navigation", "NAVIGATION_FAILED"),
    ("Target closed", "BROWSER_CRASH"),
    ("blocked", "BLOCKED_BY_YOUTUBE"),
]
# Dimensions of embedding models and context windows of chat models.
LOCAL_DIMENSIONS = {
    "Xenova/all-MiniLM-L6-v2": 384,
    "Xenova/all-mpnet-base-v2": 768,
    "Xenova/paraphrase-MiniLM-L6-v2": 384,
    "Xenova/multi-qa-MiniLM-L6-cos-v1": 384,
}
REMOTE_DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}
CONTEXT_WINDOWS = {
    "gpt-4o": 128000, "gpt-4o-mini": 128000, "gpt-4-turbo": 128000, "gpt-4": 8192,
    "gpt-3.5-turbo": 16385, "gpt-3.5-turbo-16k": 16385,
}
# Code, title, message, suggestion.
ERROR_MESSAGES = [
    ("INVALID_URL", "Invalid URL", "The YouTube URL format is incorrect.", "Use: https://www.youtube.com/watch?v=VIDEO_ID or https://youtu.be/VIDEO_ID"),
    ("NO_TRANSCRIPT", "No Transcript Available", "This video does not have transcripts/captions enabled.", "Try a different video with captions."),
    ("EXTRACTION_FAILED", "Extraction Failed", "Failed to extract transcript from this video.", "Please try again or use a different video."),
    ("RATE_LIMIT_EXCEEDED", "Rate Limit Exceeded", "Too many requests. Please slow down.", "Wait a few minutes before trying again."),
    ("QUEUE_FULL", "Service at Capacity", "The service is currently processing the maximum number of requests.", "Please try again in a few minutes."),
    ("QUEUE_TIMEOUT", "Request Timeout", "Your request timed out while waiting in queue.", "The service is busy. Please retry shortly."),
    ("NETWORK_ERROR", "Network Error", "Unable to connect to the API service.", "Please check your internet connection and ensure the backend is running."),
]


def trim_all(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.!?]\s*$")


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_A_TOKEN).cast("long")


def truncate_to_tokens(text: Column, tokens: int) -> Column:
    return F.substring(text, 1, tokens * CHARS_A_TOKEN)


def classify_error(message: Column) -> Column:
    kind = F.lit("UNKNOWN")
    for sign, name in reversed(ERROR_SIGNS):
        kind = F.when(F.contains(message, F.lit(sign)), F.lit(name)).otherwise(kind)
    return kind


def finish_reason(reason: Column) -> Column:
    """``stop`` stays, ``length`` and ``max_tokens`` are length, anything else an error."""
    return F.when(reason == "stop", F.lit("stop")).when(reason.isin("length", "max_tokens"), F.lit("length")).otherwise(F.lit("error"))


def _lookup(key: Column, table: dict[str, int], default: int) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def model_dimensions(model: Column, remote: bool = False) -> Column:
    return _lookup(model, REMOTE_DIMENSIONS, 1536) if remote else _lookup(model, LOCAL_DIMENSIONS, 384)


def context_window(model: Column) -> Column:
    return _lookup(model, CONTEXT_WINDOWS, 4096)


def error_info(code: Column) -> Column:
    """Struct of title, message and suggestion for an error code."""
    kinds = "struct<title:string,message:string,suggestion:string>"
    out = F.struct(F.lit("Error").alias("title"), F.lit("An unexpected error occurred.").alias("message"), F.lit(None).cast("string").alias("suggestion")).cast(kinds)
    for known, *texts in reversed(ERROR_MESSAGES):
        said = F.struct(*[F.lit(t).alias(n) for t, n in zip(texts, ("title", "message", "suggestion"))]).cast(kinds)
        out = F.when(code == known, said).otherwise(out)
    return out
