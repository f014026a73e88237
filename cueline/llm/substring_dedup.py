"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is factored against an index of reference blocks taken from the
documents before it (those with smaller doc_ids).

*Reference blocks.*  A window is ``WINDOW`` consecutive words.  Each window has
an anchor: the least hash among the ``GRAM``-word sequences in it.  A block is
a maximal run of windows with one anchor, together with the words they cover.
Block limits depend on the words alone, so two documents that share a long run
of words share all the blocks inside that run, wherever it stands in either.

*Index.*  Each block is indexed with the first document that has it and its place there.  A document's
own blocks are looked up there by a join.  Where a shared run starts or ends
inside a block, the blocks of the two documents differ but have the same anchor:
blocks whose anchor stands in several different blocks are also indexed window by
window, so that a run's boundaries are found to the word.

*Parse.*  ``parse`` walks a document from its first word.  Blocks that follow one
another in it as in their source, and the windows at their boundaries, join to one
match; at each word the match that reaches furthest becomes a factor, up to its
boundary; a word in no match is a literal.  Matches are of ``WINDOW`` words at
least, which the boundary check ensures, so each word of a factor lies in a window
that an earlier document has: factors are the duplicate spans, and exactly those.

Hashes are of 64 bits; blocks and windows are compared by two of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm._common import checkpoint, col, columns, spare

WINDOW = 50
#: Rows that a worker holds before it hands them on.
ROWS = 1 << 18
#: Words in an anchor; a window holds WINDOW - GRAM + 1 of them.
GRAM = 25
_BASE = 0x9E3779B97F4A7C15


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Parsed:
    """The blocks and windows of one document's words (bytes)."""

    def __init__(self, words: list[bytes]) -> None:
        n = len(words)
        self.n_windows = max(0, n - WINDOW + 1)
        if not self.n_windows:
            return
        own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own * _power(_BASE, n), dtype=np.uint64)))
        self._back = _power(pow(_BASE, -1, 1 << 64), n)
        low = self._sequences(np.arange(n - GRAM + 1), GRAM)
        reach, width = 1, WINDOW - GRAM + 1
        while 2 * reach <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: reach - width], low[width - reach :])
        self.anchor = low
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        self.first, self.runs = first, np.diff(np.concatenate((first, [self.n_windows])))
        self.block_anchor = low[first]
        self.block = self._sequences(first, self.runs + WINDOW - 1)

    def _sequences(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mixed((self._sums[start + length] - self._sums[start]) * self._back[start] + np.asarray(length, np.uint64))

    def windows(self, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every window, or of those in the chosen blocks (mask)."""
        start = np.arange(self.n_windows)
        if blocks is not None:
            start = start[np.repeat(blocks, self.runs)]
        return start, self._sequences(start, WINDOW)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _rows(names: list[str], parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Batches of long columns from arrays of them, a document at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*held)], names=names)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                p = Parsed(words_of(text.as_py()))
                if p.n_windows:
                    block, at = np.unique(p.block, return_index=True)
                    yield _signed(p.block_anchor[at]), _signed(block), np.full(len(at), doc_id, np.int64), p.first[at]

    return _rows(["anchor", "block", "doc_id", "at"], parts())


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, blocks): the windows of those blocks."""

    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for doc_id, text, blocks in zip(*(batch.column(c) for c in range(3))):
                p = Parsed(words_of(text.as_py()))
                if p.n_windows:
                    start, window = p.windows(np.isin(_signed(p.block), blocks.values.to_numpy()))
                    window, at = np.unique(window, return_index=True)
                    yield _signed(p.anchor[start[at]]), _signed(window), np.full(len(at), doc_id.as_py(), np.int64), start[at]

    return _rows(["anchor", "window", "doc_id", "at"], parts())


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lo, at): hashes of the document's blocks and windows that an earlier document has, the first such document, and their place there."""
    blocks_, = spare(docs, "blocks")
    docs = docs.where("doc_id is not null")
    rows = checkpoint(docs.select("doc_id", "text").mapInArrow(_block_rows, "anchor long, block long, doc_id long, at long"))
    # Anchors that only one document has are most of them, and of no further use.
    shared = (
        rows.groupBy("anchor")
        .agg(
            F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
            (F.min("block") < F.max("block")).alias("contested"),
        )
        .where("lo < hi")
        .select("anchor", "contested")
    )
    rows = checkpoint(rows.join(shared, "anchor"))
    index = rows.groupBy("anchor", "block").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("at", "doc_id").alias("lo_at"), F.first("contested").alias("contested")
    )
    index = checkpoint(index)
    whole = rows.join(index.where("lo < hi").select("anchor", "block", "lo", "lo_at"), ["anchor", "block"]).where("doc_id > lo")
    # A block's windows need comparing only in the first document that has it: later ones match it whole.
    compare = index.where("contested").groupBy(F.col("lo").alias("doc_id")).agg(F.collect_list("block").alias(blocks_))
    # All columns of docs go in, so that the caller's join on doc_id can use the same exchange of the texts;
    # the windows are cheap to compute twice, an exchange more of the texts is not.
    windows = docs.join(compare, "doc_id").select("doc_id", "text", blocks_).mapInArrow(_window_rows, "anchor long, window long, doc_id long, at long")
    first = windows.groupBy("anchor", "window").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min_by("at", "doc_id").alias("lo_at")
    ).where("lo < hi")
    single = windows.join(first, ["anchor", "window"]).where("doc_id > lo")
    return whole.select("doc_id", F.col("block").alias("key"), "lo", F.col("lo_at").alias("at")).union(
        single.select("doc_id", F.col("window").alias("key"), "lo", F.col("lo_at").alias("at"))
    )


def _sources(p: Parsed, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window whether an earlier document has it, the first such document, and its place there."""
    found = found[np.argsort(found[:, 0], kind="stable")]

    def look(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(found[:, 0], hashes), len(found) - 1)
        return found[at, 0] == hashes, at

    start, window = p.windows()
    whole, block = (np.repeat(x, p.runs) for x in look(_signed(p.block)))
    single, own = look(_signed(window))
    row = np.where(whole, block, own)
    into = np.where(whole, start - np.repeat(p.first, p.runs), 0)  # windows before this one in its block
    return whole | single, found[row, 1], found[row, 2] + into


def parse(words: list[bytes], found: np.ndarray) -> list[tuple[int, int, int | None, int | None]]:
    """Factors (first word, words, source document, first word there) from the first word to the last, without gaps.

    ``found`` holds rows of (key, document, place) of ``matches``.  A literal run has no source.
    """
    p, n = Parsed(words), len(words)
    if not p.n_windows or not len(found):
        return [(0, n, None, None)] if n else []
    known, source, place = _sources(p, found)
    # matches: runs of windows that follow one another here as in the source
    change = np.flatnonzero((known[1:] != known[:-1]) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    first = np.concatenate(([0], change))
    last = np.concatenate((change, [p.n_windows])) - 1
    first, last = first[known[first]], last[known[first]]
    reach = last + WINDOW
    out, at = [], 0
    while at < n:
        # matches are in order of their starts and of their ends: the last one that starts here or before reaches furthest
        m = int(np.searchsorted(first, at, side="right")) - 1
        if m >= 0 and reach[m] > at:
            out.append((at, int(reach[m]) - at, int(source[first[m]]), int(place[first[m]]) + at - int(first[m])))
            at = int(reach[m])
        else:
            end = int(first[m + 1]) if m + 1 < len(first) else n
            out.append((at, end - at, None, None))
            at = end
    return out


_PIECES = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")


def remove_repeats(docs: DataFrame, layout: str = "source", prefix: str = "", spans: bool = False) -> DataFrame:
    """Remove each word covered by a 50-word window that also starts in a document with a smaller doc_id.

    Input: ``doc_id`` (long), ``text``, and any further columns, which are kept
    whatever their names, unless they have the name of an added one.
    Adds n_words, n_removed, n_factors (long) and kept (string), their names after
    ``prefix``: what is left, with the white space of the source, or with
    ``layout="words"`` joined by one space; and with ``spans`` also spans, an array
    of the removed (start, length, source, source_start): the factors, by words.
    Windows are judged on the input, not on what is left.  Null and empty texts
    have no words; kept is then empty.  Rows with a null doc_id are neither
    reference nor changed.  Repeated rows (one doc_id) never remove each other.
    Of several earlier documents with the same words, the one with the smallest
    doc_id is the source.  A text of any length is parsed whole, in memory in
    proportion to it.  An empty table gives an empty table.
    """
    if layout not in ("source", "words"):
        raise ValueError("layout is 'source' or 'words'")
    keys_, left_ = spare(docs, "keys", "left")
    # key, document and place in turn; a document has a few for each run of words that it shares
    found = matches(docs).groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("key", "lo", "at"))).alias(keys_))
    kind = "n_words long, n_removed long, n_factors long, kept string" + ", spans array<struct<start:long,length:long,source:long,source_start:long>>" * spans
    names = [c.split()[0] for c in kind.split(", ")]
    span = pa.struct([(k, pa.int64()) for k in ("start", "length", "source", "source_start")])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.list_(span)] * spans

    @F.arrow_udf(kind)
    def left(texts: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for text, k in zip(texts, keys):
            text, k = text.as_py(), k.values
            words = words_of(text)
            gone = [f for f in parse(words, k.to_numpy(zero_copy_only=False).reshape(-1, 3)) if f[2] is not None] if k is not None and len(k) else []
            stay = np.ones(len(words), bool)
            for start, length, *_ in gone:
                stay[start : start + length] = False
            if layout == "source" and not gone:
                kept = (text or "").encode("utf-8", "surrogatepass")
            elif layout == "source":
                pieces = _PIECES.findall((text or "").encode("utf-8", "surrogatepass"))
                kept = b"".join(p for p, s in zip(pieces, stay.tolist()) if s).lstrip()
            else:
                kept = b" ".join(words if not gone else [w for w, s in zip(words, stay.tolist()) if s])
            row = (len(words), len(words) - int(stay.sum()), len(gone), kept.decode("utf-8", "surrogatepass"))
            out.append((*row, [dict(zip(("start", "length", "source", "source_start"), f)) for f in gone]) if spans else row)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=names)

    added = {c: f"{prefix}{c}" for c in names}
    rest = columns(docs)
    named = docs.where("doc_id is not null").join(found, "doc_id", "left").select(*rest, keys_)
    unnamed = docs.where("doc_id is null").select(*rest, F.lit(None).cast("array<bigint>").alias(keys_))
    return (
        named.unionByName(unnamed)
        .withColumn(left_, left("text", keys_))
        .select(*columns(docs, set(added.values())), *[F.col(left_)[k].alias(v) for k, v in added.items()])
    )
