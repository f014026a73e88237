"""Stored rows as records: renamed, with JSON read and empty values made absent; and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<time:string,text:string>>"


def absent(value: Column, kind: str) -> Column:
    """Null where a value is empty, zero or false, as a missing one is."""
    nothing = {"string": F.lit(""), "boolean": F.lit(False)}.get(kind, F.lit(0))
    return F.nullif(value, nothing)


def _absent(rows: DataFrame, *names: str) -> dict[str, Column]:
    kinds = dict(rows.dtypes)
    return {n: absent(F.col(n), kinds[n]) for n in names if n in kinds}


def transcripts(rows: DataFrame) -> DataFrame:
    """Cached transcripts: transcript_json, srt_text and plain_text become transcript (segments), srt and text; a malformed transcript is null."""
    made = rows.withColumns(_absent(rows, "video_title", "srt_text", "plain_text", "extraction_time_ms", "error_code", "error_message"))
    return made.withColumn("transcript_json", F.from_json("transcript_json", SEGMENTS)).withColumnsRenamed(
        {"transcript_json": "transcript", "srt_text": "srt", "plain_text": "text"}
    )


def jobs(rows: DataFrame) -> DataFrame:
    """Jobs: metadata becomes a map, and an empty end, message or metadata is absent."""
    made = rows.withColumns(_absent(rows, "completed_at", "error_message"))
    return made.withColumn("metadata", F.from_json(absent(F.col("metadata"), "string"), "map<string,string>"))


def job_results(rows: DataFrame) -> DataFrame:
    """Results of jobs: success is 1 and nothing else; empty codes, messages and times are absent."""
    return rows.withColumns({**_absent(rows, "error_code", "error_message", "processing_time_ms"), "success": F.coalesce(F.col("success") == 1, F.lit(False))})


def encoded(rows: DataFrame, *names: str) -> DataFrame:
    """Columns as compact JSON; nulls stay null."""
    return rows.withColumns({n: F.to_json(n) for n in names})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of named tables."""
    counted = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionByName(one)
    return out


def health(tables: dict[str, DataFrame]) -> dict:
    """Whether all tables can be read, with their counts, or else the error."""
    try:
        return {"healthy": True, "tables": {r["table_name"]: r["n_rows"] for r in table_counts(tables).collect()}}
    except Exception as e:  # the report is the outcome
        return {"healthy": False, "error": str(e)}
