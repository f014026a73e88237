"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into four blocks of 16 bits.  Two fingerprints that differ
in at most two bits agree on at least two whole blocks, so they meet under one
of the six pairs of blocks.  Fingerprints are joined on these 32-bit keys and
every pair that meets is verified by its Hamming distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm._common import checkpoint, col, columns
from cueline.llm.components import connected_components

BLOCK_PAIRS = list(combinations(range(4), 2))
#: Largest bucket that is joined with itself; larger ones go by masks (below).
PAIRED_BUCKET = 512


def simhash64(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of a whole text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    h = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    packed = np.packbits(2 * ones > len(h), bitorder="little")
    return int(packed.view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = 3) -> DataFrame:
    """Add the fingerprint of each whole text as a long."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash64(t.as_py(), shingle) for t in texts], pa.int64())

    return docs.withColumn(name, of(col(text)))


def _block_keys(fp):
    """Six (pair of blocks, 32 bits) keys of a fingerprint, each packed into a long."""
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return F.array(
        *[
            F.lit(t << 32).cast("long") + F.shiftleft(block[i], 16) + block[j]
            for t, (i, j) in enumerate(BLOCK_PAIRS)
        ]
    )


def _masks(spark: SparkSession) -> DataFrame:
    """For each pair of shared blocks, all two-bit masks of the other 32 bits: 6 x 496 rows.

    An Arrow table becomes a local relation; a list of rows would start further Python workers on every executor, which stay.
    """
    rows = []
    for t, pair in enumerate(BLOCK_PAIRS):
        free = [b for b in range(64) if b // 16 not in pair]
        for a, b in combinations(free, 2):
            keep = ~((1 << a) | (1 << b)) & (2**64 - 1)
            rows.append((t, keep - 2**64 if keep >= 2**63 else keep))
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=["t", "keep"]))


def near_links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps.fp`` at most ``distance`` (0 to 2) bits apart.

    A bucket of up to ``PAIRED_BUCKET`` fingerprints is joined with itself and
    each pair verified.  In a larger bucket every fingerprint is instead keyed
    by each way to blank two of the 32 bits outside the shared blocks: at most
    four fingerprints share such a key, all of them within two bits, and those
    that are not the smallest are linked to it.  The work per fingerprint is
    thus bounded, and the connected components are the same either way.
    """
    if not 0 <= distance <= 2:
        raise ValueError("four blocks find differences of at most two bits")
    keyed = fps.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = checkpoint(keyed.join(sizes, "key"))
    few = met.where(F.col("n") <= PAIRED_BUCKET)
    a = few.select("key", F.col("fp").alias("a"))
    b = few.select("key", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & close).select("a", "b")
    many = met.where(F.col("n") > PAIRED_BUCKET).withColumn("t", F.shiftright("key", 32))
    blanked = (
        many.join(F.broadcast(_masks(fps.sparkSession)), "t")
        .select("key", "keep", F.col("fp").bitwiseAND(F.col("keep")).alias("rest"), "fp")
    )
    tied = blanked.groupBy("key", "keep", "rest").agg(F.collect_set("fp").alias("set")).where(F.size("set") > 1)
    stars = tied.select(F.array_min("set").alias("a"), F.explode("set").alias("b")).where(
        (F.col("a") != F.col("b")) & close
    )
    if distance < 2:  # members of a key can be two bits apart: compare all of at most four
        stars = (
            tied.select(F.explode("set").alias("a"), "set")
            .select("a", F.explode("set").alias("b"))
            .where((F.col("a") < F.col("b")) & close)
        )
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """Group whole documents whose fingerprints are linked, directly or through others.

    Input: ``doc_id`` (long) and ``text``; further columns are ignored.  Output,
    one row per input row: doc_id, fp (long), component_id, the smallest doc_id
    of the group.  A null or empty text has fingerprint zero and is linked like
    any other.  Rows with a null doc_id link to nothing and get a null
    component_id.  Repeated rows give repeated rows.  A text of any length is
    read whole.  An empty table gives an empty table.  Equal fingerprints are
    collapsed before anything is joined, so a group of copies is one node.
    """
    prints = checkpoint(with_fingerprint(docs.select("doc_id", "text"), shingle=shingle).select("doc_id", "fp"))
    fps = checkpoint(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = near_links(fps, distance)
    named = (
        links.join(fps.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a")
        .join(fps.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b")
        .select("u", "v")
    )
    roots = connected_components(named)
    groups = fps.join(roots, fps["first"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "first").alias("group_id")
    )
    return prints.join(groups, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("group_id")).alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """Keep one row of each group of near-duplicates: the one with the smallest doc_id.

    Input: ``doc_id`` (long), ``text``, and any further columns, whatever their
    names; columns stay as they are.  Repeated rows of that doc_id count as one
    document, of which any one row stays.  Null and empty texts are one group, very
    long ones are read whole, rows with a null doc_id are kept.  An empty table
    gives an empty table.

    Texts are exchanged once, by doc_id: the join that picks them and the choice of
    one row for each doc_id have the same partitioning.
    """
    groups = near_duplicates(docs, shingle, distance)
    keep = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*columns(docs))
    return kept.unionByName(docs.where("doc_id is null"))
