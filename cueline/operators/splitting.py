"""Chunks by meaning, and by a list of separators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.operators import grouping
from cueline.operators.search import cosine
from cueline.operators.transcripts import joined

#: From the coarsest separator to the finest; what is still too long then is cut by length.
SEPARATORS = ("\n\n", "\n", ". ", " ")


def semantic_breaks(segments: DataFrame, quantile: float = 0.2, accuracy: int = 10_000) -> DataFrame:
    """``segments`` (video_id, idx, embedding) with similarity, to the segment before, and breaks: whether a chunk begins here.

    One does where the cosine to the segment before is below the video's ``quantile`` of them,
    which is exact up to ``accuracy`` segments and then off by that share of the ranks at most.
    The first segment of a video begins one; a segment whose cosine isn't defined (null or zero vectors,
    or of different lengths) doesn't.
    """
    order = Window.partitionBy("video_id").orderBy("idx")
    before = F.lag("embedding").over(order)
    near = segments.withColumn("__before", before).withColumn("first", F.row_number().over(order) == 1).withColumn(
        "similarity", F.when(F.size("embedding") == F.size("__before"), F.round(cosine(F.col("embedding"), F.col("__before")), 9))
    ).drop("__before")
    limits = near.groupBy("video_id").agg(F.percentile_approx("similarity", quantile, accuracy).alias("__limit"))
    below = F.coalesce(F.col("similarity") < F.col("__limit"), F.lit(False))
    return near.join(limits, "video_id").withColumn("breaks", F.col("first") | below).drop("first", "__limit")


def chunk_by_meaning(segments: DataFrame, quantile: float = 0.2) -> DataFrame:
    """(video_id, chunk_index, text, segment_count, first_idx) of segments (video_id, idx, text, embedding)."""
    upto = Window.partitionBy("video_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    numbered = semantic_breaks(segments, quantile).withColumn("chunk_index", F.sum(F.col("breaks").cast("long")).over(upto) - 1)
    return numbered.groupBy("video_id", "chunk_index").agg(
        joined(F.col("idx"), F.col("text"), " ").alias("text"), F.count("*").alias("segment_count"), F.min("idx").alias("first_idx")
    )


def split_recursively(docs: DataFrame, key: str, text: str, most: int = 1000, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """(key, chunk_index, chunk): whole texts in chunks of at most ``most`` characters, which put together are the text.

    What is too long is split at the first separator, what still is at the next, and at last by length; a
    separator stays with what it ends.  Neighbouring pieces are then put together as far as they fit.  Null and
    empty texts have no chunk.  ``key`` names a text; rows with the same key are one text, in any order.
    """
    if most < 1:
        raise ValueError("a chunk holds at least one character")
    place = F.col("place")
    pieces = docs.select(F.col(key).alias("key"), F.array(F.lit(0)).alias("place"), F.col(text).alias("piece")).where("piece <> ''")
    for separator in separators:
        # one projection for short and long pieces, so that the texts are read once; and each is split once
        parts = F.when(F.length("piece") > most, F.split("piece", f"\\Q{separator}\\E", -1)).otherwise(F.array("piece"))
        ended = F.when(F.col("k") < F.col("last"), F.concat("part", F.lit(separator))).otherwise(F.col("part"))
        pieces = pieces.select("key", "place", parts.alias("parts")).select(
            "key", "place", (F.size("parts") - 1).alias("last"), F.posexplode("parts").alias("k", "part")
        ).select("key", F.concat(place, F.array("k")).alias("place"), ended.alias("piece")).where("piece <> ''")
    cuts = F.sequence(F.lit(0), F.floor((F.length("piece") - 1) / most).cast("int"))
    pieces = pieces.select("key", "place", "piece", F.explode(cuts).alias("k")).select(
        "key", F.concat(place, F.array("k")).alias("place"), F.expr(f"substring(piece, k * {most} + 1, {most})").alias("piece")
    ).withColumn("n", F.length("piece"))
    filled = grouping.fill_up(pieces, "key", ["place"], "n", most)
    return filled.groupBy("key", "g").agg(joined(F.col("place"), F.col("piece"), "").alias("chunk")).select(
        F.col("key").alias(key), F.col("g").alias("chunk_index"), "chunk"
    )
