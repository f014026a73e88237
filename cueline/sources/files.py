"""Reading requests, addresses and event streams from files; writing tables, exports and reports."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Names of formats.
FORMATS = ["json", "srt", "text"]


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """(ord, url): one address a line, blank lines left out; ord grows with the place in the input."""
    return (
        spark.read.text(path).where("trim(value) <> ''")
        .select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("url"))
    )


def parse_event_stream(lines: DataFrame, schema: str, order: str, by: list[str], line: str = "line") -> DataFrame:
    """Server-sent events from lines: the data lines before ``[DONE]``, parsed; malformed ones are left out."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    data = F.when(F.startswith(F.col(line), F.lit("data: ")), F.trim(F.substring(F.col(line), 7, 1 << 30)))
    return (
        lines.withColumn("__data", data).withColumn("__done", F.max((F.col("__data") == "[DONE]").cast("int")).over(w))
        .where("__data is not null and coalesce(__done, 0) = 0")
        .withColumn("event", F.from_json("__data", schema, {"mode": "PERMISSIVE"}))
        .where(F.get_json_object("__data", "$").isNotNull())
        .select(*by, order, "event")
    )


def format_event_stream(events: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(*by, value): each row as a server-sent event."""
    return events.select(*(by or []), F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n")).alias("value"))


def replace(df: DataFrame, folder: str) -> str:
    """Write a snapshot beside earlier ones and return its path; nothing that is being read is overwritten."""
    path = f"{folder.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def export(texts: DataFrame, column: str, path: str) -> None:
    """Write one text a row, such as SRT or plain text."""
    texts.select(F.col(column).alias("value")).write.text(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def append_log(records: DataFrame, path: str, now: datetime) -> None:
    """Append log records as JSON lines, in a folder for each day, so that old days can be dropped whole."""
    records.withColumns({"timestamp": F.lit(now), "day": F.lit(now.strftime("%Y-%m-%d"))}).write.mode("append").partitionBy("day").json(path)


class InvalidFormat(ValueError):
    code = "INVALID_FORMAT"


def check_format(name: str | None) -> str:
    """The name of a transcript's format; none is json, an unknown one is refused."""
    if name and name not in FORMATS:
        raise InvalidFormat(f"{name} is not one of {', '.join(FORMATS)}")
    return name or FORMATS[0]


def report(title: str, summary: DataFrame, most: int = 1000) -> str:
    """A small summary as a Markdown table; summaries are figures, not data, and over ``most`` rows are refused."""
    rows = summary.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the summary has more than {most} rows")
    head = f"# {title}\n\n| {' | '.join(summary.columns)} |\n|{'---|' * len(summary.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)


def write_report(title: str, summary: DataFrame, folder: str, most: int = 1000) -> None:
    """A small summary as Markdown and as JSON lines, in two folders of a new one; an existing one is refused."""
    made = summary.sparkSession.createDataFrame([(report(title, summary, most).removesuffix("\n"),)], "value string")
    made.coalesce(1).write.text(f"{folder.rstrip('/')}/markdown")
    summary.coalesce(1).write.json(f"{folder.rstrip('/')}/json")


def pending_versions(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Versions that are not applied yet, in order."""
    return files.join(applied, "version", "left_anti").orderBy("version")
