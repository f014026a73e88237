"""Best-fit packing by patterns of few documents and non-negative least squares.

Pieces are known to the driver only as a histogram of their lengths, at most
``capacity`` numbers.  All patterns of two or three lengths that fill a sequence
are enumerated and their repeat counts fitted to the histogram by non-negative
least squares.  Counts are rounded down, and where the histogram is too thin for
whole counts, the largest remainders are rounded up, until patterns hold
``PATTERN_SHARE`` of the pieces; the rest, of all lengths, is packed best fit.
The plan is a bounded table of places; each piece finds its own by its length
and its rank among pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm._common import checkpoint, columns, slices, spare
from cueline.llm.bpe import Encoder, default_path

CAPACITY = 2048
#: Share of the pieces shorter than a sequence that patterns pack.  Best fit needs pieces of all lengths for the rest.
PATTERN_SHARE = 0.75
#: A rank is counted within a length and one of so many salts, one at least for each ROWS_A_SALT pieces.
SALTS, ROWS_A_SALT = 16, 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, added: dict[str, int] | None = None) -> DataFrame:
    """Tokenise whole texts, end each with ``end_id``, and cut those longer than ``capacity``."""
    path = tokenizer or default_path()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path, added), end_id.to_bytes(4, "little")
        for ids_, texts in (some for batch in batches for some in slices(*batch.columns)):
            rows: list[tuple] = []
            for doc_id, text in zip(ids_.to_pylist(), texts.to_pylist()):
                ids = encoder.encode(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, PIECES)


def _patterns(present: np.ndarray, capacity: int) -> list[np.ndarray]:
    """All patterns of 1, 2 and 3 of the lengths present, longest first; those of several lengths fill a sequence."""
    there = np.zeros(capacity + 1, bool)
    there[present] = True
    a, b = (x.ravel() for x in np.meshgrid(present, present, indexing="ij"))
    a, b = a[b <= a], b[b <= a]
    last = capacity - a - b
    third = (last > 0) & (last <= b)
    third[third] = there[last[third]]
    out = [present[:, None], np.column_stack((a[last == 0], b[last == 0])), np.column_stack((a[third], b[third], last[third]))]
    return [p.astype(np.int32) for p in out if len(p)]


def _fit(groups: list[np.ndarray], histogram: np.ndarray, rounds: int = 60) -> list[np.ndarray]:
    """Repeat counts x >= 0 that minimise the weighted |A x - histogram|, by multiplicative updates."""
    weight = np.arange(len(histogram)) / len(histogram)
    target = weight * histogram
    pull = [target[g].sum(axis=1) for g in groups]
    x = [np.full(len(g), histogram.sum() / (4.0 * sum(map(len, groups)) + 1)) for g in groups]
    for _ in range(rounds):
        made = np.zeros(len(histogram))
        for g, v in zip(groups, x):
            for column in g.T:
                made += np.bincount(column, v, len(histogram))
        made *= weight
        x = [v * p / (made[g].sum(axis=1) + 1e-12) for g, v, p in zip(groups, x, pull)]
    return x


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pack what is left: the longest first, then the pair (or single) that leaves the least room, again and again."""
    out = []
    while left.any():
        lengths = np.flatnonzero(left)
        used: dict[int, int] = {}
        pattern, room = [], capacity

        def take(length: int) -> None:
            nonlocal room
            pattern.append(length)
            used[length] = used.get(length, 0) + 1
            room -= length

        take(int(lengths[-1]))
        while room > 0:
            free = lengths[[left[v] > used.get(int(v), 0) for v in lengths]] if len(used) else lengths
            free = free[free <= room]
            if not len(free):
                break
            second = np.searchsorted(free, room - free, side="right") - 1
            partner = np.where(second >= 0, free[second], 0)
            twice = (partner == free) & (left[free] - np.array([used.get(int(v), 0) for v in free]) < 2)
            partner[twice] = 0
            best = int(np.argmax((free + partner) * (capacity + 1) + free))
            take(int(free[best]))
        times = min(int(left[v]) // n for v, n in used.items())
        for v, n in used.items():
            left[v] -= n * times
        out.append((tuple(pattern), times))
    return out


def _rounded(groups: list[np.ndarray], counts: list[np.ndarray], left: np.ndarray, share: float) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts within what is ``left``, which is used up: rounded down, then the largest remainders up."""
    wanted, out = share * left.sum(), []
    for up in (False, True):
        for g, x in zip(groups, counts):
            x = x * share
            order = np.argsort(np.floor(x) - x if up else -x, kind="stable")
            for at in range(0, len(order), 8192):
                some = order[at : at + 8192]
                for k in some[(left[g[some]] > 0).all(axis=1)].tolist():
                    if up and wanted <= 0:
                        return out
                    lengths = g[k].tolist()
                    times = 1 if up else int(x[k])
                    for v in set(lengths):
                        times = min(times, int(left[v]) // lengths.count(v))
                    if times:
                        for v in lengths:
                            left[v] -= times
                        wanted -= times * len(lengths)
                        out.append((tuple(lengths), times))
    return out


def plan(histogram: np.ndarray, capacity: int = CAPACITY, share: float = PATTERN_SHARE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often to make each, so that every length is used up."""
    left = histogram.astype(np.int64).copy()
    out = []
    present = np.flatnonzero(left[:capacity])
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    if len(present):
        groups = _patterns(present, capacity)
        out += _rounded(groups[1:], _fit(groups, left.astype(float))[1:], left, share)
    return out + _best_fit(left, capacity)


def _places(made: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (length, first rank): that key, the sequence of the first rank, and the offset.

    At most three rows for each pattern there is: some 20 MB at the largest.
    """
    n = np.fromiter((len(p) for p, _ in made), np.int64, len(made))
    times = np.fromiter((t for _, t in made), np.int64, len(made))
    length = np.fromiter((v for p, _ in made for v in p), np.int64, int(n.sum()))
    each = np.repeat(times, n)
    before = lambda x: np.cumsum(x) - x
    offset = before(length) - np.repeat(before(length)[before(n)], n)
    order = np.argsort(length, kind="stable")
    rank = before(each[order])
    starts = np.flatnonzero(np.diff(length[order], prepend=-1))
    rank -= np.repeat(rank[starts], np.diff(np.append(starts, len(order))))
    return (length[order] << 48) + rank, np.repeat(before(times), n)[order], offset[order].astype(np.int32)


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (``PIECES``) a sequence_id and an offset; sequences are gapless from offset 0.

    Further columns are kept, whatever their names, but for those two, which are
    replaced; an empty table gives an empty table.  Which of several pieces of one
    length takes which place follows their salt, doc_id and piece number; repeated
    rows are packed as pieces of their own.  A null length, or one that isn't from
    1 to ``capacity``, is refused.  The pieces are kept in the checkpoint folder.
    """
    parts = checkpoint(parts)
    salt_, base_, rank_, place_ = spare(parts, "salt", "base", "rank", "place")
    # at most ``capacity`` rows, one a length
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if length is None or not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit")
        histogram[length] = n
    key, first, offset = _places(plan(histogram, capacity))
    salts = max(SALTS, int(histogram.sum()) // ROWS_A_SALT)
    salted = parts.withColumn(salt_, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy(salt_).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        salted.groupBy("length", salt_).agg(F.count("*").alias("n"))
        .select("length", salt_, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base_))
    )
    among = Window.partitionBy("length", salt_).orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn(rank_, F.row_number().over(among) - 1).join(bases, ["length", salt_])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        wanted = (length.to_numpy(np.int64) << 48) + rank.to_numpy(np.int64)
        at = np.searchsorted(key, wanted, side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + wanted - key[at], "offset": offset[at].astype(np.int64)})

    return ranked.withColumn(place_, place("length", F.col(base_) + F.col(rank_))).select(
        *columns(parts, {"sequence_id", "offset"}), F.col(place_)["sequence_id"].alias("sequence_id"), F.col(place_)["offset"].alias("offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0, added: dict[str, int] | None = None) -> DataFrame:
    """Tokenise, cut and pack whole documents.

    Input: doc_id (long) and text; further columns are ignored, whatever their
    names.  A null or empty text is the end identifier alone.  A null doc_id and
    repeated rows are packed like any other row.  A text of any length is tokenised
    whole, in one task, and cut into pieces.  Strings of ``added`` tokens become
    their ids; without any, they are ordinary text.  An empty table gives an empty
    table.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, added), capacity)
