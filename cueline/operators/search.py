"""Filtered cosine search over a table of vectors, and the projections and figures made of its hits.

Vectors are rows of (id, video_id, start_time, embedding) with any further
columns, such as chunks after ``embed_chunks``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.timecode import deep_link, label
from cueline.operators import snapshots

HIGH, MEDIUM = 0.85, 0.7


class InvalidInput(ValueError):
    code = "INVALID_INPUT"


@dataclass
class Filters:
    """Conditions on a vector's metadata; those given must all hold.

    With ``list_replaces_id`` a list of videos takes the place of a single one, where both are given.
    """

    video_id: object = None
    video_ids: list | None = None
    start_between: tuple[float | None, float | None] = (None, None)
    list_replaces_id: bool = False

    def condition(self, video: str = "video_id", start: str = "start_time") -> Column:
        out = F.lit(True)
        if self.video_id is not None and not (self.list_replaces_id and self.video_ids is not None):
            out = out & (F.col(video) == F.lit(self.video_id))
        if self.video_ids is not None:
            out = out & F.col(video).isin(*self.video_ids)
        low, high = self.start_between
        if low is not None:
            out = out & (F.col(start) >= low)
        if high is not None:
            out = out & (F.col(start) <= high)
        return out


@dataclass
class SearchRequest:
    query: str
    limit: int = 10
    min_score: float | None = 0.7
    start_between: tuple[float | None, float | None] = (None, None)

    def validate(self) -> None:
        if not self.query or not self.query.strip():
            raise InvalidInput("the query is empty")
        if len(self.query) > 1000:
            raise InvalidInput("the query is longer than 1000 characters")
        if not 1 <= self.limit <= 100:
            raise InvalidInput("the limit is from 1 to 100")
        if self.min_score is not None and not 0 <= self.min_score <= 1:
            raise InvalidInput("the least score is from 0 to 1")
        low, high = self.start_between
        if any(x is not None and x < 0 for x in (low, high)) or (low is not None and high is not None and low >= high):
            raise InvalidInput("the range of times is empty or below zero")


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(_doubles(a), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where either vector is zero or null."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, min_score: float | None = None, filters: Filters | None = None, id_col: str = "id") -> DataFrame:
    """The ``k`` vectors of largest cosine with one query vector, best first, ties to the smaller id.

    Filters reach the scan; the query is a constant of the plan, so nothing is
    joined or shuffled, and only ``k`` rows of each partition leave it.
    """
    given = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where((filters or Filters()).condition()).withColumn("score", cosine(F.col("embedding"), given))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", query_block: int = 4096, vector_block: int = 65_536) -> DataFrame:
    """As ``nearest`` for each row of ``queries`` (query_id, query), however many: query_id, rank, id, score.

    Queries and vectors are dealt into blocks by a hash, and each pair of blocks
    meets in one task, as one product of matrices, which lets out ``k`` rows for
    each query.  Ids and query ids occur once.
    """
    usable = lambda df, name: df.where(F.col(name).isNotNull() & ~F.exists(name, lambda x: x.isNull()) & (norm(F.col(name)) > 0))
    vectors = usable(vectors.select(F.col(id_col).alias("id"), F.col("embedding").alias("v")), "v")
    queries = usable(queries.select("query_id", F.col("query").alias("q")), "q")
    n_v, n_q = -(-vectors.count() // vector_block) or 1, -(-queries.count() // query_block) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(n_v)).cast("int")).withColumn("qb", every(n_q))
    right = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int")).withColumn("vb", every(n_v))
    kinds = {**dict(left.dtypes), **dict(right.dtypes)}

    def meet(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        asked, ids, scored = [], [], []
        if len(v) and len(q):
            v = v.sort_values("id", ignore_index=True)
            x, y = (np.stack(c.to_numpy()).astype(np.float64) for c in (v["v"], q["q"]))
            x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
            for at in range(0, len(y), 256):
                for row, scores in enumerate(y[at : at + 256] @ x.T, at):
                    near = np.arange(len(x))
                    if len(x) > k:
                        near = np.flatnonzero(scores >= np.partition(scores, -k)[-k] - 1e-12)
                    # equal vectors must score equally, which a product of matrices does not promise
                    exact = (x[near] * y[row]).sum(axis=1)
                    top = np.argsort(-exact, kind="stable")[:k]
                    asked.extend([q["query_id"].iloc[row]] * len(top))
                    ids.extend(v["id"].iloc[near[top]])
                    scored.extend(exact[top])
        return pd.DataFrame({"query_id": pd.Series(asked, dtype=object), "id": pd.Series(ids, dtype=object), "score": pd.Series(scored, dtype=float)})

    met = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(meet, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def with_rank(hits: DataFrame, id_col: str = "id") -> DataFrame:
    """Number hits from 1, best first.  Hits are a bounded top list."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))


def items(hits: DataFrame, stamp: Callable[[Column], Column] = label) -> DataFrame:
    """Hits as search items, with the label of their time, which ``stamp`` makes, and a link to it."""
    return hits.select(
        "video_id", "video_url", "video_title", "chunk_index", "text", "start_time", "end_time", "score",
        stamp(F.col("start_time")).alias("timestamp"), deep_link(F.col("video_url"), F.col("start_time")).alias("video_url_with_timestamp"),
    )


def citations(hits: DataFrame, stamp: Callable[[Column], Column] = label) -> DataFrame:
    return items(hits, stamp).select("video_id", "video_url", "video_title", "text", "score", "timestamp", "video_url_with_timestamp")


def result_stats(hits: DataFrame) -> DataFrame:
    """One row: total_results, unique_videos, avg_score (0 if none), and hits of high, medium and low score."""
    s = F.col("score")
    return hits.agg(
        F.count("*").alias("total_results"), F.countDistinct("video_id").alias("unique_videos"),
        F.coalesce(F.avg(s), F.lit(0.0)).alias("avg_score"), F.count_if(s >= HIGH).alias("high"),
        F.count_if((s >= MEDIUM) & (s < HIGH)).alias("medium"), F.count_if(s < MEDIUM).alias("low"),
    )


def group_by_video(ranked: DataFrame, id_col: str = "id") -> DataFrame:
    """(video_id, first_rank, ids): ids in rank order; videos rank by their best hit."""
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(id_col).alias("id"))))
    return ranked.groupBy("video_id").agg(F.min("rank").alias("first_rank"), F.transform(rows, lambda r: r["id"]).alias("ids"))


def store_stats(vectors: DataFrame) -> DataFrame:
    """One row: total_chunks and total_videos; only the video column is read."""
    return vectors.select("video_id").agg(F.count("*").alias("total_chunks"), F.countDistinct("video_id").alias("total_videos"))


STORED = ["chunk_id", "video_id", "video_url", "video_title", "chunk_index", "start_time", "end_time", "segment_count", "text", "embedding"]


def as_stored(chunks: DataFrame) -> DataFrame:
    """Chunks as a store keeps them: their segments become a count, a missing title is empty."""
    if "segments" in chunks.columns:
        chunks = chunks.withColumn("segment_count", F.size("segments").cast("long"))
    return chunks.withColumn("video_title", F.coalesce("video_title", F.lit(""))).select(*STORED)


class VectorStore:
    """Vectors behind one interface; each change replaces the table that the store holds."""

    def __init__(self, rows: DataFrame, id_col: str = "id") -> None:
        self.rows, self.id_col = rows, id_col

    def add(self, rows: DataFrame) -> None:
        self.rows = snapshots.append(self.rows, rows)

    def upsert(self, rows: DataFrame) -> None:
        self.rows = snapshots.upsert(self.rows, rows, self.id_col)

    def delete_video(self, video_id: object) -> None:
        self.rows = snapshots.delete(self.rows, F.col("video_id") == F.lit(video_id))

    def clear(self) -> None:
        self.rows = snapshots.clear(self.rows)

    def search(self, query: list[float], k: int = 10, min_score: float | None = None, filters: Filters | None = None) -> DataFrame:
        return nearest(self.rows, query, k, min_score, filters, self.id_col)

    def stats(self) -> DataFrame:
        return store_stats(self.rows)
