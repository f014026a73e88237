"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that, written as
Parquet and read again, is the next one's docs.  All but the last return the
columns of ``docs``, which may be more than those of ``documents`` and have any
names.  All stages read whole texts of any length, take rows with null doc_ids or
texts, repeated rows, and empty tables, which give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm import bpe, packing, quality_vote, simhash, substring_dedup, toxicity
from cueline.llm._common import col, discard, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labels, calls toxic go.

    Null and empty texts score the share of toxic labels; repeated rows go or stay together.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(model, col("text")) < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose labelled neighbours do not vote for good quality go.

    Null and empty texts are judged as texts without words; repeated rows go or stay together.
    """
    model = quality_vote.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_vote.score(model, col("text")) >= quality_vote.THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the one with the smallest doc_id, once.

    Null and empty texts are one group; rows with a null doc_id stay.
    """
    return simhash.drop_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words and more that an earlier document has are cut out of the text; all rows stay.

    Rows with a null doc_id, and null texts, stay as they are, but a null text becomes an empty one.
    """
    prefix = "cut_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    left = substring_dedup.remove_repeats(docs, layout="source", prefix=prefix)
    kept = F.col(f"{prefix}kept")
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return left.select(*[new[c].alias(c) if c in new else col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place.

    Null and empty texts are one token; repeated rows and rows with a null doc_id are packed like any other.
    """
    return packing.pack_documents(docs, added=bpe.added_tokens())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

#: The stages learn models, link fingerprints and tokenise: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again.

    A stage's result is deleted once the next is written, and the last one once the
    pieces are in the checkpoint folder, where packing keeps them.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                discard(spark, f"{folder}/{before}")
            before = name
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        discard(spark, folder)
