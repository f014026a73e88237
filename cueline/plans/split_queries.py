"""Queries of chunking by meaning and by separators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueline.operators import splitting
from cueline.plans import tables as t
from cueline.plans.queries import query

_VECTOR = "(conv_id * 7 + turn * 13) % {n}"
_MEANING_SQL = f"""e AS (
  SELECT conv_id AS video_id, turn AS idx, text, embedding::DOUBLE[] AS v FROM conversations
  JOIN embeddings ON vec_id = {_VECTOR.format(n="(SELECT count(*) FROM embeddings)")}
), near AS (
  SELECT video_id, idx, text, row_number() OVER w AS rn, round(list_cosine_similarity(v, lag(v) OVER w), 9) AS similarity
  FROM e WINDOW w AS (PARTITION BY video_id ORDER BY idx)
), lim AS (SELECT video_id, quantile_disc(similarity, 0.2) AS lowest FROM near GROUP BY video_id), broken AS (
  SELECT near.*, rn = 1 OR coalesce(similarity < lowest, false) AS breaks FROM near JOIN lim USING (video_id)
)"""


def _embedded(spark, sf_dir):
    """Turns of conversations, each with one of the given vectors."""
    vectors = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = max(1, vectors.count())
    said = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("idx"), "text", F.expr(_VECTOR.format(n=n)).alias("vec_id"))
    return said.join(vectors, "vec_id").drop("vec_id")


@query(f"WITH {_MEANING_SQL} SELECT video_id, idx, round(similarity, 6) AS similarity, breaks FROM broken")
def semantic_breaks(spark, sf_dir):
    found = splitting.semantic_breaks(_embedded(spark, sf_dir), 0.2)
    return found.select("video_id", "idx", F.round("similarity", 6).alias("similarity"), "breaks")


@query(f"""WITH {_MEANING_SQL}, numbered AS (
  SELECT *, sum(breaks::BIGINT) OVER (PARTITION BY video_id ORDER BY idx)::BIGINT - 1 AS chunk_index FROM broken
)
SELECT video_id, chunk_index, string_agg(text, ' ' ORDER BY idx) AS text, count(*) AS segment_count, min(idx) AS first_idx FROM numbered GROUP BY video_id, chunk_index""")
def chunk_semantic(spark, sf_dir):
    return splitting.chunk_by_meaning(_embedded(spark, sf_dir), 0.2)


_MOST = 800


def _level(k: int, separator: str) -> str:
    parts, mark = f"string_split(piece, {separator})", f"|| {separator}"
    return f"""l{k} AS (
  SELECT key, list_append(place, k) AS place, p AS piece FROM (
    SELECT key, place, unnest(parts) AS p, generate_subscripts(parts, 1) AS k FROM (
      SELECT key, place, CASE WHEN length(piece) > {_MOST} THEN list_transform({parts}, lambda x, i: CASE WHEN i < len({parts}) THEN x {mark} ELSE x END) ELSE [piece] END AS parts
      FROM l{k - 1})) WHERE p <> ''
)"""


@query(f"""WITH RECURSIVE l0 AS (SELECT doc_id AS key, [0]::BIGINT[] AS place, text AS piece FROM documents WHERE text <> ''),
{_level(1, "chr(10) || chr(10)")}, {_level(2, "chr(10)")}, {_level(3, "'. '")}, {_level(4, "' '")}, slices AS (
  SELECT key, list_append(place, k) AS place, substr(piece, k * {_MOST} + 1, {_MOST}) AS piece FROM l4, unnest(range(0, (length(piece) - 1) // {_MOST} + 1)) AS r(k)
), n AS (
  SELECT key, piece, length(piece) AS len, row_number() OVER (PARTITION BY key ORDER BY place) AS i FROM slices
), f AS (
  SELECT key, i, 0::BIGINT AS g, len AS used FROM n WHERE i = 1
  UNION ALL
  SELECT n.key, n.i, if(f.used + n.len > {_MOST}, f.g + 1, f.g), if(f.used + n.len > {_MOST}, n.len, f.used + n.len) FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1
)
SELECT f.key AS doc_id, g AS chunk_index, string_agg(piece, '' ORDER BY f.i) AS chunk FROM f JOIN n ON n.key = f.key AND n.i = f.i GROUP BY f.key, g""")
def chunk_recursive(spark, sf_dir):
    return splitting.split_recursively(t.table(spark, sf_dir, "documents"), "doc_id", "text", _MOST)
