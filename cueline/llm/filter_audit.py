"""Audit of how filters interact: what each removes, at each step of every order.

The five filters' verdicts on a document do not depend on the order; which filter
removes it does.  Each document's flags are crossed with the 120 orders (a table of
fixed size, broadcast), each pair is exploded to its five steps, and the steps are
counted per part with conditional aggregates, which Spark combines before the
shuffle: what is exchanged is at most 600 rows for each part and task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueline.llm._common import checkpoint, col, spare

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
#: A: fewer words than this; B: a smaller share of distinct words; C: a larger share of capitals; both in percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10


def with_flags(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with a boolean for each filter that fails: A to E, under these names or, where taken, with underscores.

    Null texts count as empty.  E fails where any smaller doc_id, anywhere in the table, has the same text; a null doc_id
    is neither smaller nor larger than another.
    """
    names = spare(docs, *FILTERS, "digest", "first", "digest_of")
    a, b, c, d, e, digest, first, of = names
    t = F.coalesce(col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    flagged = checkpoint(docs.select(
        *[col(x) for x in docs.columns if x != text],
        (F.size(words) < LEAST_WORDS).alias(a),
        (100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words)).alias(b),
        (100 * F.regexp_count(t, F.lit("[A-Z]")).cast("long") > MOST_CAPITALS * F.length(t).cast("long")).alias(c),
        t.rlike("[#$%&*|]").alias(d),
        F.sha2(t, 256).alias(digest),
    ))
    # texts that more than one doc_id has; minima are combined before the shuffle.  They are written, so that the join reads
    # two plain exchanges: adaptive execution can then split the documents of one text that has a large share of them
    copied = checkpoint(flagged.groupBy(F.col(digest).alias(of)).agg(F.min(col(doc_id)).alias(first), F.max(col(doc_id)).alias("last")).where(
        F.col("last") > F.col(first)
    ).drop("last"))
    copy = F.coalesce(col(doc_id) > F.col(first), F.lit(False))
    return flagged.join(copied, F.col(digest) == F.col(of), "left").withColumn(e, copy).drop(digest, first, of)


def orders(spark: SparkSession) -> DataFrame:
    """The 120 orders, each with the step of every filter."""
    rows = [("".join(p), *[p.index(f) + 1 for f in FILTERS]) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, " + ", ".join(f"at_{f} int" for f in FILTERS))


def replay(flagged: DataFrame, part: str, flags: list[str], good: Column, toxic: Column) -> DataFrame:
    """Counts of each part, order and step for documents with a flag for each of the filters A to E.

    Returns part, filter_order, step, and the longs kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley; 600 rows for each value of ``part``, zeros included.
    """
    fails = {f: col(x) for f, x in zip(FILTERS, flags)}
    docs = flagged.select(
        col(part).alias("part"), *[fails[f].alias(f"fails_{f}") for f in FILTERS],
        sum(fails[f].cast("int") for f in FILTERS).alias("n_fails"), good.alias("good"), toxic.alias("toxic"),
    )
    crossed = docs.crossJoin(F.broadcast(orders(flagged.sparkSession)))
    # least() skips nulls: a filter that a document passes has no step
    first = F.coalesce(F.least(*[F.when(F.col(f"fails_{f}"), F.col(f"at_{f}")) for f in FILTERS]), F.lit(len(FILTERS) + 1))
    steps = crossed.withColumn("first", first).withColumn("step", F.explode(F.array(*[F.lit(s) for s in range(1, len(FILTERS) + 1)])))
    here = F.lit(False)
    for f in FILTERS:
        here = here | (F.col(f"fails_{f}") & (F.col(f"at_{f}") == F.col("step")))
    removed = F.col("first") == F.col("step")
    counted = steps.withColumn("fails", here).groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(F.col("fails") & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("fails") & (F.col("n_fails") == 1)).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return counted.select("*", F.sum("removed").over(Window.partitionBy("part", letter)).alias("shapley"))  # of 120 rows each


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the filters remove in each part (``lang``) of ``docs``, at each step of every order.

    Input: doc_id, lang, text; labels: doc_id, quality, toxic; further columns of either are ignored, whatever their
    names.  Returns the columns of ``replay``.

    A null lang is the part of the empty string, with those whose lang is empty.  Null and empty texts have no words:
    they fail A alone, and E from the second doc_id on.  Texts of any length are read whole.  Rows that are repeated, or
    share a doc_id, count each for itself, and none of them is the other's copy.  A null doc_id has no label and is no
    copy.  A document is good, or toxic, if any of its labels says so.  An empty table gives no rows.
    """
    known = labels.select(col("doc_id").alias("labelled"), col("quality").alias("q"), col("toxic").alias("x")).groupBy("labelled").agg(
        (F.max("q") == 1).alias("good"), (F.max("x") == 1).alias("toxic")
    )
    flagged = with_flags(docs.select(col("doc_id").alias("doc_id"), F.coalesce(col("lang"), F.lit("")).alias("lang"), col("text").alias("text")))
    marked = flagged.join(known, F.col("doc_id") == F.col("labelled"), "left")
    says = lambda c: F.coalesce(F.col(c), F.lit(False))
    return replay(marked, "lang", list(FILTERS), says("good"), says("toxic"))
