"""Token counts from flat token files without an index, by a separator scan.

A file is unsigned little-endian identifiers one after another, each document ended
by a separator; nothing else says where documents are.  Files are read in blocks of
a fixed number of tokens, which take no notice of documents, by whichever task comes
first; each block is searched at once with a vectorised comparison and reports where
its separators are.  A prefix scan over the blocks' reports, within groups of blocks
and over the groups, numbers the documents and carries open ones across boundaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueline.llm._common import checkpoint, discard, shared_folder
from cueline.llm.bpe import Encoder, default_path

END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 20
#: Blocks that one step of the prefix scan looks at together.
GROUP_BLOCKS = 4096
#: Blocks that one task reads, one after another, and the most tasks that a very large table is dealt to.
TASK_BLOCKS, TASKS = 32, 100_000
WIDTH = 2


def _store(path: str) -> tuple:
    """File system and path, for a path as Spark names it.

    Hadoop's names of object stores stand for those that pyarrow has (s3a and s3n are s3); hdfs and viewfs
    need Hadoop's own library on the workers, as they have on a Hadoop cluster.
    """
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    rest = rest.lstrip("/")
    if scheme in ("s3", "s3a", "s3n"):
        return fs.S3FileSystem(), rest
    return fs.FileSystem.from_uri(f"{scheme}://{rest}")


def write_flat_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_OF_DOCUMENT, width: int = WIDTH) -> DataFrame:
    """Tokenise whole texts into flat files of ``width``-byte identifiers, one a task, in a shared folder.

    Returns what the files do not hold, (file, ordinal, doc_id): which document was
    written when.  A file is named after the attempt that wrote it, so what a lost
    or a second attempt leaves behind is named by no row.  Identifiers that don't
    fit ``width`` bytes are refused.
    """
    path, kind = tokenizer or default_path(), np.dtype(f"<u{width}")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = Encoder(path), TaskContext.get().taskAttemptId()
        end, most = np.array([end_id], kind).tobytes(), np.iinfo(kind).max
        store, where = _store(folder)
        out, ordinal = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                out = store.open_output_stream(f"{where}/{file}.bin", buffer_size=1 << 20)
            for text in batch.column(1):
                ids = np.frombuffer(encoder.encode(text.as_py()), "<u4")
                if len(ids) and ids.max() > most:
                    raise ValueError(f"identifier {ids.max()} doesn't fit {width} bytes")
                out.write(ids.astype(kind).tobytes())
                out.write(end)
            n = batch.num_rows
            places = np.arange(ordinal, ordinal + n)
            ordinal += n
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, file), pa.int64()), pa.array(places, pa.int64()), batch.column(0)], names=["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    if end_id > np.iinfo(kind).max:
        raise ValueError(f"identifier {end_id} doesn't fit {width} bytes")
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "file long, ordinal long, doc_id long")
    where = made.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(made.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return checkpoint(made)


def blocks_of(spark: SparkSession, path: str, width: int = WIDTH, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, last): the ranges of flat files, from their lengths alone; empty files have none."""
    # the content isn't selected, so it isn't read
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "length")
    last = F.floor((F.col("length") - 1) / F.lit(block * width)).cast("long")
    return files.select(F.col("path").alias("file"), last.alias("last")).select("file", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("block"), "last")


def scan(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, width: int = WIDTH, block: int = BLOCK_TOKENS, group: int = GROUP_BLOCKS) -> DataFrame:
    """Count the tokens of each document of flat files, given their blocks (``blocks_of`` with the same ``width`` and ``block``).

    Returns file, ordinal (from 0 in its file), start (its first token's place in
    the file), n_tokens (without the separator) and ended (false for tokens after a
    file's last separator).  Documents may span any number of blocks, files may be
    of any length: a task holds one block and one block's separators at a time.
    Repeated blocks are read once.  Empty files and no files give no rows.  Files
    whose length is no multiple of ``width`` are refused.
    """
    kind = np.dtype(f"<u{width}")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number, last in zip(*(c.to_pylist() for c in batch.columns)):
                store, where = _store(file)
                with store.open_input_file(where) as f:
                    f.seek(number * block * width)
                    data = f.read(block * width)
                if len(data) % width:
                    raise ValueError(f"{file} doesn't hold whole identifiers")
                at = np.flatnonzero(np.frombuffer(data, kind) == end_id) + number * block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([number]), pa.array([number * block + len(data) // width]), pa.array([number == last]), pa.array([at], pa.list_(pa.int64()))],
                    names=["file", "block", "stop", "is_last", "ends"],
                )

    # the ranges are a small table, which would else be read by one task
    tasks = max(1, min(TASKS, -(-blocks.count() // TASK_BLOCKS)))
    spread = blocks.dropDuplicates(["file", "block"]).select("file", "block", "last").repartition(tasks, "file", "block")
    found = checkpoint(spread.mapInArrow(of, "file string, block long, stop long, is_last boolean, ends array<long>"))
    reports = found.select(
        "file", F.floor(F.col("block") / group).alias("group"), "block", F.size("ends").cast("long").alias("n"),
        (F.element_at("ends", F.when(F.size("ends") > 0, -1)) + 1).alias("opened"),
    )
    # prefix scan: over groups of blocks, then over the blocks of each group
    past = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = reports.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("opened").alias("opened")).select(
        "file", "group", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n_before"), F.coalesce(F.max("opened").over(past), F.lit(0)).alias("open_before")
    )
    within = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = reports.withColumns({"n_here": F.coalesce(F.sum("n").over(within), F.lit(0)), "open_here": F.max("opened").over(within)}).join(groups, ["file", "group"])
    placed = found.join(
        stitched.select("file", "block", (F.col("n_before") + F.col("n_here")).alias("before"), F.coalesce("open_here", "open_before").alias("open")), ["file", "block"]
    ).withColumn("starts", F.concat(F.array("open"), F.transform("ends", lambda e: e + 1)))
    ended = placed.select("file", "before", "starts", F.posexplode("ends").alias("k", "end")).select(
        "file", (F.col("before") + F.col("k")).alias("ordinal"), F.expr("starts[k]").alias("start"), F.expr("end - starts[k]").alias("n_tokens"), F.lit(True).alias("ended")
    )
    tail = placed.where("is_last and stop > element_at(starts, -1)").select(
        "file", (F.col("before") + F.size("ends")).alias("ordinal"), F.expr("element_at(starts, -1)").alias("start"),
        F.expr("stop - element_at(starts, -1)").alias("n_tokens"), F.lit(False).alias("ended"),
    )
    return ended.union(tail)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id and n_tokens of whole documents, through flat files and their scan; one row for each input row.

    Input: doc_id (long) and text; further columns are ignored, whatever their
    names.  A null or empty text has 0 tokens; a null doc_id stays null; repeated
    rows give repeated rows.  A text of any length is tokenised whole and may span
    any number of blocks.  Strings of added tokens are ordinary text, so that only
    separators end a document.  An empty table gives an empty table.  The files are
    in the shared folder that Spark's checkpoints are in, and deleted once they are scanned.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/flat-{uuid.uuid4().hex}"
    try:
        named = write_flat_files(docs, folder, tokenizer)
        counted = scan(blocks_of(spark, folder, block=block), block=block).select(
            F.regexp_extract("file", r"(\d+)\.bin$", 1).cast("long").alias("file"), "ordinal", "n_tokens"
        )
        return checkpoint(named.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens"))
    finally:
        discard(spark, folder)
