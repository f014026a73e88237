"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.llm._common import checkpoint


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger node to the smaller one."""
    return (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Edges (u, v) of several pairs of columns of each row, made in one pass: a union would do what lies below once for each pair."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Map each node of ``edges`` (u, v: long) to its component's smallest node.

    Returns (node, root) for every node that has an edge to another node, roots
    excluded.  Each round costs two grouped minima and two equi-joins, in few
    stages, as the driver keeps account of every task of them; the number of
    rounds grows with the logarithm of the longest path.  No group is ever
    gathered in one task: minima are combined before the shuffle, and a hub's
    edges are ordinary rows of a join that adaptive execution can split.
    Edges with a null end are dropped; no edges give no rows.
    """
    e = checkpoint(_oriented(edges.select("u", "v").where("u is not null and v is not null")))
    state = _state(e)
    while state[0]:
        both = _each(e, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # distinct: a node whose neighbours share their minimum has one edge left, not one for each of them
        large = _oriented(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = checkpoint(_oriented(_each(large.join(low, "u"), ("v", "m"), ("u", "m"))))
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
