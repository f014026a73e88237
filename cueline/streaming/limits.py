"""Rate limits whose windows begin with a client's first request.

A client's window begins with its first request and lasts ``seconds``; its next
window begins with the first request after that, and so on: a chain, in which each
window depends on the one before.  It is found without walking it: time is cut in
buckets as long as a window, of which each holds one beginning at most, every
request points to the one that would begin the next window, and the chain is
reached by doubling these pointers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.sources.folders import checkpoint


def _bucket(t: str, micros: int) -> Column:
    return F.expr(f"({t} - pmod({t}, {micros}L)) div {micros}L")


def _pointers(times: DataFrame, micros: int) -> DataFrame:
    """(client, t, b, to, root): where the window after one that begins at t begins, and whether t begins one in any case.

    ``times``: distinct (client, t), t in microseconds.  Rows of a client meet only
    within one bucket and the next, so that a busy client is dealt to many tasks.
    """
    times = times.withColumn("b", _bucket("t", micros))
    own = Window.partitionBy("client").orderBy("b")
    # a row for each client and bucket that has requests
    buckets = times.groupBy("client", "b").agg(F.min("t").alias("first"), F.max("t").alias("last")).select(
        "client", "b", F.when(F.lag("b").over(own) == F.col("b") - 1, F.lag("last").over(own)).alias("last_before"),
        F.when(F.lead("b").over(own) > F.col("b") + 1, F.lead("first").over(own)).otherwise(F.lead("first", 2).over(own)).alias("later"),
    )
    # ends of windows fall into the next bucket: of the requests there the first at or after each end
    marks = times.select("client", (F.col("b") + 1).alias("b"), (F.col("t") + micros).alias("t"), F.col("t").alias("of"))
    both = marks.unionByName(times.withColumn("of", F.lit(None).cast("long")))
    back = Window.partitionBy("client", "b").orderBy(F.desc("t"), F.col("of").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("next", F.last(F.when(F.col("of").isNull(), F.col("t")), ignorenulls=True).over(back)).where("of is not null").select(
        "client", (F.col("b") - 1).alias("b"), F.col("of").alias("t"), "next"
    )
    front = Window.partitionBy("client", "b").orderBy("t")
    before = F.coalesce(F.lag("t").over(front), F.col("last_before"))
    return near.join(buckets, ["client", "b"]).select(
        "client", "b", "t", F.coalesce("next", "later").alias("to"), (before.isNull() | (F.col("t") - before >= micros)).alias("root")
    )


def window_starts(times: DataFrame, seconds: int) -> DataFrame:
    """(client, t) of the requests that begin a window, of distinct (client, t) in microseconds."""
    jump = checkpoint(_pointers(times, seconds * 1_000_000))
    reached = checkpoint(jump.where("root").select("client", "t"))
    jump = checkpoint(jump.where("to is not null").select("client", "t", "to"))
    n, before = reached.count(), -1
    # each round doubles the part of every chain that is reached
    while n > before:
        stepped = reached.join(jump, ["client", "t"]).select("client", F.col("to").alias("t"))
        reached = checkpoint(reached.union(stepped).distinct())
        after = jump.select("client", F.col("t").alias("to"), F.col("to").alias("then"))
        jump = checkpoint(jump.join(after, ["client", "to"]).select("client", "t", F.col("then").alias("to")))
        n, before = reached.count(), n
    return reached


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def limited(requests: DataFrame, client: str, at: str, order: str, limit: int, seconds: int) -> DataFrame:
    """``requests`` with window_start, place (of the request in its window, up to ``limit``, else null) and rejected.

    The first ``limit`` requests of a window pass, ties by ``order``; rejected ones count too, but don't
    prolong it.  Requests without a client or a time are left out.  Requests at one time and of one order are all
    counted, in any order.
    """
    base = checkpoint(requests.where(F.col(client).isNotNull() & F.col(at).isNotNull()).withColumn("__t", _micros(at)))
    micros = seconds * 1_000_000
    starts = window_starts(base.select(F.col(client).alias("client"), F.col("__t").alias("t")).distinct(), seconds)
    # a window's requests are in the bucket that it begins in, or the next
    begun = starts.withColumn("b", F.explode(F.array(_bucket("t", micros), _bucket("t", micros) + 1)))
    along = base.select(F.col(client).alias("__client"), _bucket("__t", micros).alias("__b"), "*", F.lit(None).cast("long").alias("__start"))
    both = along.unionByName(
        begun.select(F.col("client").alias("__client"), F.col("b").alias("__b"), F.col("t").alias("__t"), F.col("t").alias("__start")), allowMissingColumns=True
    )
    upto = Window.partitionBy("__client", "__b").orderBy("__t", F.col("__start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("__begins", F.last("__start", ignorenulls=True).over(upto)).where("__start is null").drop("__start", "__b")
    own = checkpoint(own.withColumn("__row", F.monotonically_increasing_id()))
    # the first few of each window; how many more there are doesn't matter
    place = F.row_number().over(Window.partitionBy("__client", "__begins").orderBy("__t", order, "__row"))
    passed = own.withColumn("place", place).where(F.col("place") <= limit).select("__row", "place")
    return own.join(passed, "__row", "left").select(
        *requests.columns, F.timestamp_micros("__begins").alias("window_start"), "place", F.col("place").isNull().alias("rejected")
    )
