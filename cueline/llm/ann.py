"""Approximate nearest neighbours by learned partitions.

On a bounded sample, a neighbour graph is cut into balanced parts by recursive
spectral bisection, and a small network learns, from each vector, in which parts
its neighbours are.  Every row is indexed under its most probable part; a query is
compared with all rows of its several most probable parts and reranked exactly.
There are about as many parts as the square root of the number of rows, so what a
query is compared with grows more slowly than the table, as long as the sample has
``ROWS_A_PART`` rows for each part: up to ``SAMPLE_ROWS / ROWS_A_PART`` parts, the
square root of a million rows.  Beyond, parts grow with the table; raise both the
sample and its parts there.  How many parts are probed is set on the sample, for a
stated recall.  Vectors without any neighbourhoods,
such as random ones, need most parts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm._common import checkpoint, col

#: Bounds on the rows that the partition and the router are fitted on: so many, but at least the second where the table
#: has them, and no more than are needed for ``ROWS_A_PART`` in each part.
SAMPLE_ROWS, LEAST_SAMPLE = 32_768, 8_192
ROWS_A_PART = 32
#: Recall aimed at on rows of the sample that the router hasn't seen.
RECALL = 0.94
GRAPH_NEIGHBOURS = 16
#: Rows and queries that meet in one task.
INDEX_BLOCK, QUERY_BLOCK = 32_768, 16_384
HIDDEN, EPOCHS = 128, 20


def parts_for(rows: int) -> int:
    """About the square root of the number of rows, a power of two, with enough sampled rows in each part."""
    parts = 1 << max(0, round(np.log2(max(rows, 1)) / 2))
    while parts > 1 and parts * ROWS_A_PART > min(rows, SAMPLE_ROWS):
        parts //= 2
    return parts


def sample_for(rows: int) -> int:
    return min(SAMPLE_ROWS, max(LEAST_SAMPLE, parts_for(rows) * ROWS_A_PART))


def neighbour_graph(x: np.ndarray, k: int = GRAPH_NEIGHBOURS) -> np.ndarray:
    """For each row its ``k`` rows of largest inner product, itself excluded."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, seed: int = 7, rounds: int = 40) -> np.ndarray:
    """Cut a neighbour graph into ``parts`` (a power of two) equal parts by recursive spectral bisection."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(graph), np.int64)
    n, k = graph.shape
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    for _ in range(parts.bit_length() - 1):
        within = part[a] == part[b]  # edges that are still whole
        s, t = a[within], b[within]
        degree = np.maximum(np.bincount(s, minlength=n), 1)
        root = np.sqrt(degree)
        size = np.bincount(part)
        v = rng.normal(size=n)
        for _ in range(rounds):
            # the constant direction of each part is taken out; what remains tends to its second eigenvector
            v -= root * (np.bincount(part, v * root) / np.maximum(np.bincount(part, root**2), 1e-12))[part]
            v = 0.5 * (v + np.bincount(s, v[t] / (root[s] * root[t]), n))
            v /= np.sqrt(np.bincount(part, v**2) + 1e-300)[part]
        order = np.lexsort((v / root, part))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
        part = 2 * part + (place >= (size // 2)[part])
    return part


@dataclass
class Router:
    """A network with one hidden layer from vectors to parts, and how many parts to probe."""

    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def routes(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        """Parts from the most to the less probable."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : probes or self.probes]


def train_router(x: np.ndarray, targets: np.ndarray, parts: int, epochs: int = EPOCHS, seed: int = 7) -> Router:
    """Cross-entropy by Adam; ``targets`` holds, for each row, the parts of its neighbours.  Fixed seed and order."""
    rng = np.random.default_rng(seed)
    d, k = x.shape[1], targets.shape[1]
    scale = float(np.sqrt((x**2).mean())) or 1.0
    p = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            inp = x[some] / scale
            hidden = np.maximum(inp @ p[0] + p[1], 0)
            out = hidden @ p[2] + p[3]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            cells = np.repeat(np.arange(len(some)), k) * parts + targets[some].ravel()
            out -= np.bincount(cells, minlength=out.size).reshape(out.shape) / k
            out /= len(some)
            back = (out @ p[2].T) * (hidden > 0)
            grads = [inp.T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ out + 1e-4 * p[2], out.sum(axis=0)]
            step += 1
            for q, g, mm, vv in zip(p, grads, m, v):
                mm *= 0.9
                mm += 0.1 * g
                vv *= 0.999
                vv += 0.001 * g**2
                q -= 0.003 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return Router(scale, *p, parts)


def fit(sample: np.ndarray, parts: int, recall: float = RECALL, neighbours: int = 20, rows: int | None = None) -> Router:
    """Partition the sample's neighbour graph, learn to route, and set the number of parts to probe.

    One row in eight is kept out of the graph and of training and used to measure the
    recall.  Where the sample stands for a table of ``rows`` rows, a query's nearest
    ``neighbours`` there are as near as a share of them here, rounded up.
    """
    held = np.arange(len(sample)) % 8 == 0
    inside = sample[~held]
    if parts < 2 or len(inside) <= 2 * neighbours:
        d = sample.shape[1]
        return Router(1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(inside)
    part = balanced_parts(graph, parts)
    router = train_router(inside, np.concatenate((part[:, None], part[graph]), axis=1), parts)
    home = router.routes(inside, 1)[:, 0]
    near_here = -(-neighbours * len(inside) // max(rows or 0, len(sample)))
    needed = []
    for at in range(0, held.sum(), 512):
        q = sample[held][at : at + 512]
        near = np.argpartition(-(q @ inside.T), near_here - 1, axis=1)[:, :near_here]
        rank = np.argsort(router.routes(q, parts), axis=1)  # rank of each part for each query
        needed.append(np.take_along_axis(rank, home[near], axis=1))
    needed = np.concatenate(needed)
    router.probes = next(n for n in range(1, parts + 1) if (needed < n).mean() >= recall)
    return router


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[list, list, list]:
    """Exact top ``k`` of a block for each query: largest inner product, ties to the smaller id."""
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(q), 512):
        s = q[at : at + 512] @ x.T
        for row, scores in enumerate(s):
            scores[ids == query_ids[at + row]] = -np.inf
            if len(ids) > k:
                least = -np.partition(-scores, k - 1)[k - 1]
                near = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
            else:
                near = np.flatnonzero(scores > -np.inf)
            # equal vectors must score equally, which a blocked product does not promise
            exact = (x[near] * q[at + row]).sum(axis=1)
            top = np.lexsort((ids[near], -exact))[:k]
            out[0].extend([query_ids[at + row]] * len(top))
            out[1].extend(ids[near][top])
            out[2].extend(exact[top])
    return out


def search(vectors: DataFrame, every: int, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score.  Further columns are ignored,
    whatever their names.

    Nearness is the largest inner product in double precision, ties to the smaller
    id; a row is no candidate of its own id.  Rows with a null id, and vectors that
    are null, empty, zero, or hold null or non-finite components, take no part.
    Repeated rows (one id) are one row: the smallest vector.  Vectors of different
    lengths have no inner product; those of the commonest length go by parts, those
    of any other are compared with all of their length.  Where the parts to probe
    hold fewer than ``k`` rows besides the query, further ones are probed, in order
    of their probability, until they do.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(vector_col).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = checkpoint(rows.groupBy("id").agg(F.min("v").alias("v")))
    # one row: the commonest length
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes[0]["d"], sizes[0]["n"]
    common = F.size("v") == d
    # bounded: ``sample_for`` vectors
    sample = rows.where(common).orderBy(F.xxhash64("id"), "id").limit(sample_for(n)).collect()
    router = fit(np.array([r["v"] for r in sample], np.float64), parts_for(n), recall, k, n)
    n_parts = len(router.b2)

    def ranked(v: pd.Series, probes: int) -> np.ndarray:
        return router.routes(np.stack(v.to_numpy()).astype(np.float64), probes).astype(np.int32)

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        out = np.empty(len(v), np.int32)
        of = v.str.len().to_numpy() == d
        out[~of] = n_parts + v.str.len().to_numpy()[~of]  # a part for each other length
        if of.any():
            out[of] = ranked(v[of], 1)[:, 0]
        return pd.Series(out)

    index = checkpoint(rows.select("id", "v", home("v").alias("part")))
    # at most one row for each part, and for each length there is
    n_index = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    held = np.array([n_index.get(p, 0) for p in range(n_parts)], np.int64)

    @F.pandas_udf("array<int>")
    def routes(v: pd.Series, part: pd.Series) -> pd.Series:
        out = [np.array([p], np.int32) for p in part]
        of = np.flatnonzero(part.to_numpy() < n_parts)
        if len(of):
            for i, own in zip(of.tolist(), ranked(v.iloc[of], n_parts)):
                enough = np.searchsorted(np.cumsum(held[own]), k + 1) + 1
                out[i] = own[: max(router.probes, enough)]
        return pd.Series(out, dtype=object)

    asked = index.where(F.col("id") % every == 0)
    queries = checkpoint(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.explode(routes("v", "part")).alias("part")))
    n_query = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count("*").alias("n")).collect()}
    # (part, blocks of its index, blocks of its queries): a row for each part
    grid = spark.createDataFrame(
        [(p, -(-n_index[p] // INDEX_BLOCK), -(-m // QUERY_BLOCK)) for p, m in n_query.items() if p in n_index], "part int, n_ib int, n_qb int"
    )
    index = index.join(F.broadcast(grid), "part").withColumn("ib", F.pmod(F.xxhash64("id"), "n_ib").cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.col("n_qb") - 1))
    )
    queries = queries.join(F.broadcast(grid), "part").withColumn("qb", F.pmod(F.xxhash64("query_id"), "n_qb").cast("int")).withColumn(
        "ib", F.explode(F.sequence(F.lit(0), F.col("n_ib") - 1))
    )

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = best(
            x["id"].to_numpy(), np.stack(x["v"].to_numpy()).astype(np.float64),
            q["query_id"].to_numpy(), np.stack(q["q"].to_numpy()).astype(np.float64), k,
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    keys = ["part", "ib", "qb"]
    found = queries.select(*keys, "query_id", "q").groupBy(*keys).cogroup(index.select(*keys, "id", "v").groupBy(*keys)).applyInPandas(
        meet, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
