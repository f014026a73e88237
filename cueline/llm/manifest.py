"""A Merkle manifest of a table: a digest of each row, of each source and of the whole, with proofs.

Rows of a source are put in order and dealt out in aligned blocks of 16 x 16 x 16
leaves.  A block's digests are one contiguous matrix of 64 bytes a row; reshaped by
the fanout, each of its rows is one run, and hashing them gives the next level.  A
node's siblings are the other rows of its run, found by index arithmetic.  The
blocks' own digests are the leaves of further blocks, so a table of N rows takes
one stage for each factor of 4096 in the rows of its largest source, and no task holds more than
a block of rows with the path above it.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm._common import checkpoint, col

FANOUT = 16
#: Levels that one block covers.
DEEP = 3
BLOCK = FANOUT**DEEP
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def matrix(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode("ascii"), np.uint8).reshape(-1, 64)


def block_levels(leaves: np.ndarray, levels: int) -> list[np.ndarray]:
    """The digest matrices of a block, from its leaves up."""
    out = [leaves]
    for _ in range(levels):
        m = out[-1]
        full = len(m) // FANOUT
        runs = [sha256(run).hexdigest() for run in np.ascontiguousarray(m[: full * FANOUT]).reshape(full, FANOUT * 64)]
        if full * FANOUT < len(m):
            runs.append(sha256(m[full * FANOUT :].tobytes()).hexdigest())
        out.append(matrix(runs))
    return out


def siblings(levels: list[np.ndarray], leaf: int) -> list[tuple[bytes, bytes]]:
    """For each level of a block, the digests of a leaf's run before and after the leaf's own node."""
    out, at = [], leaf
    for m in levels[:-1]:
        run = at // FANOUT * FANOUT
        out.append((m[run:at].tobytes(), m[at + 1 : run + FANOUT].tobytes()))
        at //= FANOUT
    return out


def fold(digest: str, path: list[tuple[bytes, bytes]]) -> str:
    """The root that a leaf's digest leads to."""
    for before, after in path:
        digest = sha256(before + digest.encode("ascii") + after).hexdigest()
    return digest


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def indexed(nodes: DataFrame, *order: str) -> DataFrame:
    """Add i, the place of each row in its ``part``, and n, the rows of the part.

    Rows are exchanged by range of (part, *order), so that a large part is dealt to many tasks; a row's place is its
    place among the task's rows of the part, after the rows of that part in the tasks before.
    """
    ordered = checkpoint(
        nodes.repartitionByRange("part", *order).sortWithinPartitions("part", *order).withColumn("at", F.monotonically_increasing_id())
    ).withColumn("task", F.shiftright("at", 33))
    marks = ordered.groupBy("part", "task").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy("part")
    before = F.coalesce(F.sum("held").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = marks.select("part", "task", (before - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("n"))
    return checkpoint(ordered.join(marks, ["part", "task"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "task", "shift"))


def _block(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    table = table.sort_by("i")
    n = table.column("n")[0].as_py()
    return table, block_levels(matrix(table.column("digest").to_pylist()), min(DEEP, height(n)))


def _upwards(nodes: DataFrame) -> DataFrame:
    """The blocks' own digests, as nodes of the next stage."""

    def up(key: tuple, table: pa.Table) -> pa.Table:
        table, levels = _block(table)
        n = -(-table.column("n")[0].as_py() // BLOCK)
        return pa.table({"part": [key[0].as_py()], "i": [key[1].as_py()], "n": [n], "digest": [levels[-1].tobytes().decode("ascii")]})

    return nodes.select("part", "i", "n", "digest", F.expr(f"i div {BLOCK}").alias("block")).groupBy("part", "block").applyInArrow(
        up, "part string, i long, n long, digest string"
    )


_PATH = "befores array<string>, afters array<string>"


def _text(parts: list[bytes]) -> list[str]:
    return [p.decode("ascii") for p in parts]


def paths(nodes: DataFrame, most: int) -> DataFrame:
    """For each node (part, i, n, digest) its path (befores, afters, level by level) and the ``top`` digest of its part.

    ``most`` is the largest n.
    """
    if most <= 1:
        none = F.array().cast("array<string>")
        return nodes.select("part", "i", none.alias("befores"), none.alias("afters"), F.col("digest").alias("top"))
    above = paths(checkpoint(_upwards(nodes)), -(-most // BLOCK))

    def down(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, levels = _block(table)
        befores, afters, top = (upper.column(c)[0].as_py() for c in ("befores", "afters", "top"))
        found = [siblings(levels, j) for j in range(len(table))]
        return pa.table({
            "part": table.column("part"), "i": table.column("i"),
            "befores": pa.array([_text([p[0] for p in f]) + befores for f in found], pa.list_(pa.string())),
            "afters": pa.array([_text([p[1] for p in f]) + afters for f in found], pa.list_(pa.string())),
            "top": [top] * len(found),
        })

    blocks = nodes.select("part", "i", "n", "digest", F.expr(f"i div {BLOCK}").alias("block")).groupBy("part", "block")
    return checkpoint(blocks.cogroup(above.withColumnRenamed("i", "block").groupBy("part", "block")).applyInArrow(
        down, f"part string, i long, {_PATH}, top string"
    ))


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def build(leaves: DataFrame, id_type: str) -> DataFrame:
    """Roots, proofs and verification of leaves (part, doc_id, digest, now).

    ``part`` orders the sources; ``now`` is the digest of the row as it is found now, null where that is the same.
    """
    nodes = indexed(leaves, "doc_id", "digest", "tie").drop("tie")
    within = paths(checkpoint(_upwards(nodes)), -(-_largest(nodes) // BLOCK))
    # a row for each source; their tree is built in the same way
    tops = indexed(within.where("i = 0").select(F.lit("").alias("part"), F.col("part").alias("of"), F.col("top").alias("digest")), "of")
    over = paths(tops.drop("of"), _largest(tops)).join(tops.select("i", "of"), "i").select(
        F.col("of").alias("part"), F.col("befores").alias("more_b"), F.col("afters").alias("more_a"), F.col("top").alias("root")
    )
    above = within.join(over, "part").select(
        "part", F.col("i").alias("block"), F.concat("befores", "more_b").alias("befores"), F.concat("afters", "more_a").alias("afters"), "top", "root"
    )

    def prove(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, levels = _block(table)
        befores, afters, top, root = (upper.column(c)[0].as_py() for c in ("befores", "afters", "top", "root"))
        higher = [(b.encode("ascii"), a.encode("ascii")) for b, a in zip(befores, afters)]
        rest = b"".join(b + a for b, a in higher)
        leaf, now = table.column("digest").to_pylist(), table.column("now").to_pylist()
        proofs, folded = [], []
        for j in range(len(leaf)):
            path = siblings(levels, j)
            proofs.append(sha256(b"".join([x for pair in path for x in pair]) + rest).hexdigest())
            folded.append(fold(now[j] or leaf[j], path + higher))
        n = len(leaf)
        return pa.table({
            "doc_id": table.column("doc_id"), "leaf": leaf, "subroot": [top] * n, "root": [root] * n, "proof_sha256": proofs,
            "folded_root": folded, "verified": [f == root for f in folded],
        })

    blocks = nodes.select("part", "i", "n", "digest", "doc_id", "now", F.expr(f"i div {BLOCK}").alias("block")).groupBy("part", "block")
    return blocks.cogroup(above.groupBy("part", "block")).applyInArrow(
        prove, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def manifest(docs: DataFrame, every: int = 5) -> DataFrame:
    """The manifest of documents, checked against a copy of which some rows were tampered with.

    Input: doc_id, source, lang, n_chars, text; further columns are ignored, whatever their names.  Returns, for each
    row: doc_id, leaf, subroot (of its source), root (of the table), proof_sha256, folded_root, verified.  Where ``every`` divides
    the crc32 of the decimal doc_id, the copy's text is in lower case (A to Z only), which a text without capitals doesn't show.

    Any of the columns may be null; a null source is a source of its own and comes first.  Empty and very long texts are hashed
    whole.  Rows with a null doc_id come first in their source and aren't tampered with.  Rows that share a doc_id are put in
    order of their leaves; repeated rows are leaves of their own, and any order of theirs gives the same result.  A
    table of one row has that leaf as its root and an empty proof.  An empty table gives no rows.
    """
    doc_id, source, lang, n_chars, text = (col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    touched = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % every == 0, F.lit(False))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("/"), source.cast("string")), F.lit("")).alias("part"), doc_id.alias("doc_id"),
        leaf_of(doc_id, source, lang, n_chars, text).alias("digest"),
        F.when(touched, leaf_of(doc_id, source, lang, n_chars, F.translate(text, _UPPER, _LOWER))).alias("now"),
        F.monotonically_increasing_id().alias("tie"),  # so that repeated rows can be dealt to several tasks
    )
    return build(checkpoint(leaves), leaves.schema["doc_id"].dataType.simpleString())
