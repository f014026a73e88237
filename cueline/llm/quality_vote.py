"""Quality by nearest-neighbour voting among latent-semantic vectors.

A document's terms are its words, their shapes and lengths, how often they
recur, and its lines.  A truncated singular value decomposition of a labelled
sample gives every document a short latent vector.  The labelled vectors are
broadcast; each document is compared with all of them by cosine, block by
block, and its nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.llm._common import MEMO, col, slices
from cueline.llm.toxicity import sampled

#: Bound on the labelled rows: the decomposition and the voters come from these.
LABELLED_ROWS = 6_000
DIMENSIONS = 48
NEIGHBOURS = 25
THRESHOLD = 0.7
#: Buckets: structure, then shapes, then words.
_STRUCTURE, _SHAPES, _WORDS = 128, 1024, 1 << 14
BUCKETS = _STRUCTURE + _SHAPES + _WORDS
_LENGTHS, _SHARES, _LINES, _VARIETY = 0, 24, 48, 80
_ADJACENT, _EMPTY = 120, 121
_WORD_WEIGHT = 0.3
#: What features are made of: the shape of a word is told by its first so many signs, and lengths are told up to so many characters.
SHAPE_SIGNS, LENGTHS = 12, 23
#: Texts that are compared with the voters at once.
TOGETHER = 512
_RUNS = [(re.compile(p), r) for p, r in (("[^\\W\\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a" if m[0].islower() else "Aa"), (r"\d+", "0"), (r"([^\w])\1+", r"\1+"))]


def _hash(s: str) -> int:
    return xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass"))


def shape_of(word: str) -> str:
    """Letters become a, A or Aa by their case, digits 0, and repeated signs are marked once."""
    for pattern, by in _RUNS:
        word = pattern.sub(by, word)
    return word[:SHAPE_SIGNS]


class Features:
    """Sparse terms of a text: bucket numbers and values."""

    def __init__(self) -> None:
        self._memo: dict[str, tuple[int, int, int]] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.array([_EMPTY]), np.array([1.0])
        memo, n = self._memo, len(words)
        if len(memo) > MEMO:
            memo.clear()
        counts = Counter(words)
        found = []
        for w in counts:
            three = memo.get(w)
            if three is None:
                three = memo[w] = (
                    _STRUCTURE + _SHAPES + _hash(w.lower()) % _WORDS,
                    _STRUCTURE + _hash(shape_of(w)) % _SHAPES,
                    _LENGTHS + min(len(w), LENGTHS),
                )
            found.append(three)
        at = np.array(found)
        c = np.fromiter(counts.values(), float, len(counts))
        values = np.bincount(at.ravel(), np.repeat(c, 3), BUCKETS)
        share = np.where(c > 1, np.clip(np.log2(n / c), 0, 22), 23).astype(int)
        values += np.bincount(_SHARES + share, c, BUCKETS)
        lines = Counter(filter(None, text.split("\n")))
        for line, times in lines.items():
            size = min(len(line).bit_length(), 15)
            values[_LINES + size] += len(line) * n / len(text)
            values[_LINES + 16 + size] += len(line) * n / len(text) * (times - 1)
        values[_VARIETY + int(20 * len(counts) / n)] += n
        values[_ADJACENT] += sum(map(eq, words, words[1:]))
        bucket = np.flatnonzero(values)
        value = np.sqrt(values[bucket] / n)
        value[bucket >= _STRUCTURE + _SHAPES] *= _WORD_WEIGHT
        return bucket, value


def _product(rows: list[tuple[np.ndarray, np.ndarray]], by: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix."""
    return np.stack([v.astype(by.dtype) @ by[b] for b, v in rows]) if rows else np.zeros((0, by.shape[1]), by.dtype)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Term weights, projection (bucket x dimension), and the voters' vectors and labels."""

    weight: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return _normal(_product([_weighted(r, self.weight) for r in rows], self.projection))

    def vote(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS, block: int = 2048) -> np.ndarray:
        """Exact cosines with all voters by blocks; the nearest vote, weighted by their similarity."""
        if not len(self.labels):
            return np.full(len(vectors), 0.5)
        near, says = np.zeros((len(vectors), 0), np.float32), np.zeros((len(vectors), 0), np.float32)
        for at in range(0, len(self.labels), block):
            cosine = vectors @ self.vectors[at : at + block].T
            near = np.hstack((near, cosine))
            says = np.hstack((says, np.broadcast_to(self.labels[at : at + block], cosine.shape)))
            if near.shape[1] > neighbours:
                top = np.argpartition(-near, neighbours - 1, axis=1)[:, :neighbours]
                near, says = np.take_along_axis(near, top, 1), np.take_along_axis(says, top, 1)
        weight = np.maximum(near, 1e-3) ** 4
        return np.clip((weight * says).sum(axis=1) / weight.sum(axis=1), 0, 1).astype(float)


def _weighted(row: tuple[np.ndarray, np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bucket, value = row
    value = value * weight[bucket]
    return bucket, value / max(float(np.sqrt((value**2).sum())), 1e-12)


def decompose(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> Model:
    """Inverse document frequencies and a randomised truncated decomposition of the sample."""
    df = np.zeros(BUCKETS)
    for bucket, _ in rows:
        df[bucket] += 1
    weight = np.log((1 + len(rows)) / (1 + df)) + 1
    rows = [_weighted(r, weight) for r in rows]
    width = dimensions + 8
    right = np.random.default_rng(seed).normal(size=(BUCKETS, width)).astype(np.float32)
    for _ in range(4):
        left = np.linalg.qr(_product(rows, right))[0] if rows else np.zeros((0, width), np.float32)
        right = np.zeros((BUCKETS, left.shape[1]), np.float32)
        for (bucket, value), q in zip(rows, left):
            right[bucket] += value[:, None].astype(np.float32) * q
    u, s, _ = np.linalg.svd(right, full_matrices=False)
    projection = np.ascontiguousarray(u[:, :dimensions], np.float32)
    model = Model(weight, projection, np.zeros((0, projection.shape[1]), np.float32), labels.astype(np.float32))
    vectors = _normal(_product(rows, projection)) if rows else model.vectors
    return Model(weight, projection, vectors.astype(np.float32), model.labels)


def ordered(rows: Iterable[tuple]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Terms and labels of rows (bucket, value, y), by the hash of all three; only the hashes are kept beside the arrays."""
    rows = sorted(rows, key=lambda r: hash((tuple(r[0]), tuple(r[1]), r[2])))
    return [(b, v) for b, v, _ in rows], np.array([y for *_, y in rows], float)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = LABELLED_ROWS) -> Model:
    """Fit on at most ``rows`` of the labelled documents; labels hold doc_id and ``label`` (0 or 1).

    Null labels are left out and repeated ones count once.  Without any, every
    text scores 0.5.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for texts, y in (some for batch in batches for some in slices(*batch.columns)):
            found = [features(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32())), y],
                names=["bucket", "value", "y"],
            )

    # bounded: ``rows`` sparse vectors of at most BUCKETS terms; in a stated order
    sample = sampled(docs, labels, label, rows).mapInArrow(of, "bucket array<int>, value array<float>, y int").toPandas()
    return decompose(*ordered(zip(sample["bucket"], sample["value"], sample["y"])))


def score(model: Model, text: Column) -> Column:
    """The share of the vote for label 1 at each whole text, 0 to 1."""

    @F.arrow_udf("double")
    def of(batch: pa.Array) -> pa.Array:
        features, out = Features(), [np.zeros(0)]
        for texts, in slices(batch, rows=TOGETHER):
            out.append(model.vote(model.latent([features(t) for t in texts.to_pylist()])))
        return pa.array(np.concatenate(out), pa.float64())

    return of(text)


def with_quality(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Add score and predicted (1 where score >= threshold) to whole documents; all rows and other columns stay.

    Input: ``doc_id``, ``text``, and further columns of any names; score and
    predicted are replaced.  Null and empty texts are compared as texts without
    words.  A text of any length is read whole; features are shares of it.  Rows
    are scored by themselves, so repeated ones get equal scores; null doc_ids are
    scored too, but never learned from.  Of voters at one distance any may be among
    the nearest.  An empty table gives an empty table.
    """
    model = fit(docs, labels, rows=rows)
    return docs.withColumn("score", score(model, col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
