"""Exact search for the largest integer inner products, by branch and bound in ball trees.

The top of one ball tree is grown on a bounded sample and cuts the rows into cells;
a cell's rows are dealt out in shards, each with a ball tree of its own.  A query's
inner product with any row of a ball is at most that with its centre, plus the
query's length times the radius.  Blocks of near queries first meet the cell whose
bound is largest, then, in rounds that grow fourfold, those whose bound still
reaches a query's k-th score; that score is shared with every shard of the next
round, which searches its nodes from the largest bound down and leaves those that
cannot reach it.  Vectors without any neighbourhoods, such as random ones, leave
little to cut; results are exact either way.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm._common import checkpoint, col

#: Rows of a shard, of a leaf, and queries of a block, about.
SHARD_ROWS, LEAF_ROWS, QUERY_BLOCK = 8_192, 64, 512
#: Bounds of what the top of the tree is grown on, and of its cells, which every task holds.
SAMPLE_ROWS, MOST_CELLS = 32_768, 1_024
#: Cells that a block meets in the first round, and by how much each round has more.
FIRST, FASTER = 1, 4


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def cut(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A direction between two far rows, and the rows' places along it."""
    a = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
    b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
    return b - a, x @ (b - a)


@dataclass
class Top:
    """The upper levels of the tree, as a complete binary tree of cuts, and the cells' centres."""

    directions: np.ndarray
    at: np.ndarray
    centres: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(len(self.centres).bit_length() - 1):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.directions[node]) >= self.at[node])
        return node - len(self.at)


def grow_top(sample: np.ndarray, cells: int) -> Top:
    """``cells`` is a power of two; a cell without sampled rows gets its parent's rows for a centre."""
    d = sample.shape[1]
    top = Top(np.zeros((cells - 1, d)), np.zeros(cells - 1), np.zeros((cells, d)))
    members = {0: sample}
    for node in range(2 * cells - 1):
        x = members.pop(node)
        if node >= cells - 1:
            top.centres[node - cells + 1] = x.mean(axis=0)
            continue
        w, place = cut(x)
        top.directions[node], top.at[node] = w, np.median(place)
        right = place >= top.at[node]
        for child, of in ((2 * node + 1, x[~right]), (2 * node + 2, x[right])):
            members[child] = of if len(of) else x
    return top


def grow(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """A ball tree of a shard: rows in the order of its leaves, and for each node its ball, rows, smallest id and children."""
    order, nodes = np.argsort(ids, kind="stable"), []
    stack = [(0, len(ids), -1, 0)]
    while stack:
        lo, hi, parent, side = stack.pop()
        of = x[order[lo:hi]]
        centre = of.mean(axis=0)
        radius = float(np.sqrt(((of - centre) ** 2).sum(axis=1).max()))
        here = len(nodes)
        nodes.append([centre, radius, lo, hi, ids[order[lo:hi]].min(), -1, -1])
        if parent >= 0:
            nodes[parent][5 + side] = here
        if hi - lo > LEAF_ROWS:
            # stable: equal rows stay in the order of their ids, so that a tie is settled in the first leaf that has it
            along = cut(of)[1]
            by = np.argsort(along, kind="stable")
            order[lo:hi], along = order[lo:hi][by], along[by]
            # at the widest gap of the middle half, so that fewer groups of near rows are cut
            least, most = (hi - lo) // 4, 3 * (hi - lo) // 4
            gaps = np.diff(along[least : most + 1])
            mid = lo + (least + 1 + int(np.argmax(gaps)) if gaps.max() > 0 else (hi - lo) // 2)
            stack += [(mid, hi, here, 1), (lo, mid, here, 0)]
    centre, radius, lo, hi, least, left, right = (np.array(c) for c in zip(*nodes))
    return {"ids": ids[order], "x": x[order], "centre": centre, "radius": radius, "lo": lo, "hi": hi, "least": least, "left": left, "right": right}


def bounds(q: np.ndarray, lengths: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest integer that an inner product of a query with a row of a ball can be; a row for each query."""
    far = lengths[:, None] * radius
    room = 1e-9 * (lengths[:, None] * np.sqrt((centre**2).sum(axis=1)) + far) + 1e-6  # for rounding
    return np.floor(q @ centre.T + far + room)


class Best:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def may(self, bound: np.ndarray, least: np.ndarray, floor: np.ndarray, floor_id: np.ndarray) -> np.ndarray:
        """Whether something of that bound and smallest id could be among the best, here or where the floor comes from."""
        score, at = self.scores[:, -1], self.ids[:, -1]
        return ((bound > score) | ((bound == score) & (least < at))) & ((bound > floor) | ((bound == floor) & (least <= floor_id)))

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows of scores for some queries, against the same ids."""
        near = scores >= self.scores[queries, -1][:, None]
        some = np.flatnonzero(near.any(axis=1))
        for r in some:
            q, of = queries[r], np.flatnonzero(near[r])
            s, i = np.concatenate((self.scores[q], scores[r, of])), np.concatenate((self.ids[q], ids[of]))
            top = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.ids[q] = s[top], i[top]


def search_tree(tree: dict[str, np.ndarray], query_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, k: int) -> Best:
    """Branch and bound for a block of queries; only what reaches their ``floor`` (score, id) is looked for."""
    best, lengths = Best(len(q), k), np.sqrt((q**2).sum(axis=1))
    x = tree["x"].astype(np.float64)
    bound = bounds(q, lengths, tree["centre"], tree["radius"])

    def look(leaf: int, queries: np.ndarray) -> None:
        of = slice(tree["lo"][leaf], tree["hi"][leaf])
        scores, ids = q[queries] @ x[of].T, tree["ids"][of]
        scores[(ids[None, :] == query_ids[queries][:, None]) | (scores < floor[queries][:, None])] = np.nan
        best.add(queries, ids, scores)

    # each query first dives to the leaf of its largest bound, so that the search begins with a good k-th score
    leaves = np.flatnonzero(tree["left"] < 0)
    dive = leaves[np.argmax(bound[:, leaves], axis=1)]
    for leaf in np.unique(dive).tolist():
        of = np.flatnonzero(dive == leaf)
        look(leaf, of[best.may(bound[:, leaf], tree["least"][leaf], floor, floor_id)[of]])
    heap = [(-bound[:, 0].max(), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        active = np.flatnonzero(best.may(bound[:, node], tree["least"][node], floor, floor_id) & (dive != node))
        if not len(active):
            continue
        if tree["left"][node] < 0:
            look(node, active)
        else:
            for child in (tree["left"][node], tree["right"][node]):
                heapq.heappush(heap, (-bound[active, child].max(), int(child)))
    return best


def _stack(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest integer inner product for each row whose id is divisible by ``every``.

    Components count as floor(scale * x).  Returns query_id, rank (from 1), vec_id, score (long); ties go to the
    smaller id, and a row is no candidate of its own id.  Further columns are ignored, whatever their names.

    Rows with a null id, and vectors that are null or hold null components or such as aren't finite after scaling,
    take no part; zero vectors do.  Repeated rows (one id) are one row: the smallest vector.  Vectors of different lengths have no
    inner product: those of the commonest length go by cells, those of any other are compared with all of their
    length, and so are empty vectors, whose score is 0.  Scores are exact where no sum of products exceeds 2^53 (components of up to a million for 64
    dimensions); larger ones are rounded to doubles, and end at the range of a long.  A query of fewer than ``k`` candidates gets all.
    An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(vector_col).alias("v")).where("id is not null and v is not null")
    whole = F.transform(F.col("v"), lambda c: c.cast("double") * F.lit(scale))
    rows = rows.select("id", whole.alias("v")).where(
        F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    )
    rows = checkpoint(rows.groupBy("id").agg(F.min("v").alias("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d, n = sizes[0]["d"], sizes[0]["n"]
    cells = 1
    while cells < MOST_CELLS and cells * SHARD_ROWS < n and d:
        cells *= 2
    # bounded: SAMPLE_ROWS vectors
    sample = rows.where(F.size("v") == d).orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE_ROWS, 64 * cells)).collect()
    top = grow_top(np.floor(np.array([r["v"] for r in sample], np.float64).reshape(len(sample), d)), cells)

    @F.pandas_udf("struct<cell: int, off: double>")
    def placed(v: pd.Series) -> pd.DataFrame:
        size = v.str.len().to_numpy()
        cell, off, of = cells + size, np.zeros(len(v)), size == d  # a cell for each other length
        if of.any():
            x = np.floor(_stack(v[of]))
            cell[of] = top.cells(x)
            off[of] = np.sqrt(((x - top.centres[cell[of]]) ** 2).sum(axis=1))
        return pd.DataFrame({"cell": cell.astype(np.int32), "off": off})

    index = checkpoint(rows.select("id", "v", placed("v").alias("p")).select("id", "v", "p.cell", "p.off"))
    asked = (F.col("id") % every == 0).cast("int")
    # at most a row for each cell, and for each length there is
    held = {
        r["cell"]: r for r in index.groupBy("cell").agg(
            F.count("*").alias("n"), F.max("off").alias("radius"), F.min("id").alias("least"), F.sum(asked).alias("asked")
        ).collect()
    }
    deal = F.broadcast(spark.createDataFrame(
        [(c, -(-r["n"] // SHARD_ROWS), max(1, -(-r["asked"] // QUERY_BLOCK))) for c, r in held.items()], "cell int, shards int, blocks int"
    ))
    dealt = index.join(deal, "cell")

    def planted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.floor(_stack(rows["v"]))
        if np.abs(x).max(initial=0) < 2**24:
            x = x.astype(np.float32)  # holds them exactly
        tree = grow(rows["id"].to_numpy(), x.astype(np.float64))
        return pd.DataFrame({"cell": [key[0]], "shard": [key[1]], "tree": [pack(**tree | {"x": tree["x"].astype(x.dtype)})]})

    trees = checkpoint(dealt.withColumn("shard", F.pmod(F.xxhash64("id"), "shards").cast("int")).groupBy("cell", "shard").applyInPandas(
        planted, "cell int, shard int, tree binary"
    ))

    def gathered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame({"cell": [key[0]], "block": [key[1]], "asks": [pack(ids=rows["id"].to_numpy(), q=np.floor(_stack(rows["v"])))]})

    blocks = checkpoint(dealt.where(asked == 1).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int")).groupBy("cell", "block").applyInPandas(
        gathered, "cell int, block int, asks binary"
    ))

    common = np.array(sorted(c for c in held if c < cells), np.int32)
    radius = np.array([held[c]["radius"] for c in common.tolist()])
    least = np.array([held[c]["least"] for c in common.tolist()], np.int64)
    no_id = np.iinfo(np.int64).max

    def floors(asks: dict[str, np.ndarray], known: list | None) -> tuple[np.ndarray, np.ndarray]:
        score, at = np.full(len(asks["ids"]), -np.inf), np.full(len(asks["ids"]), no_id)
        if known is not None:
            place = {r["query_id"]: j for j, r in enumerate(known)}
            for j, i in enumerate(asks["ids"].tolist()):
                if i in place:
                    r = known[place[i]]
                    score[j], at[j] = r["score"], r["vec_id"]
        return score, at

    def next_cells(take: int):
        """The cells that a block meets now, by bound, and those that it may meet later."""

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                now, later = [], []
                for cell, asks, rest, known in zip(batch["cell"], batch["asks"], batch["rest"], batch["known"]):
                    if cell >= cells:
                        now.append([cell] if rest is None else [])
                        later.append([])
                        continue
                    a = unpack(asks)
                    score, at = floors(a, known)
                    left = np.arange(len(common)) if rest is None else np.searchsorted(common, np.array(rest, np.int32))
                    b = bounds(a["q"], np.sqrt((a["q"] ** 2).sum(axis=1)), top.centres[common[left]], radius[left])
                    may = ((b > score[:, None]) | ((b == score[:, None]) & (least[left] < at[:, None]))).any(axis=0)
                    order = np.argsort(-b.max(axis=0, initial=-np.inf), kind="stable")
                    order = common[left][order[may[order]]].tolist()
                    now.append(order[:take])
                    later.append(order[take:])
                yield pd.DataFrame({"cell": batch["cell"], "block": batch["block"], "now": now, "rest": later})

        return step

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, tree = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if of != (r.at_cell, r.shard):
                    of, tree = (r.at_cell, r.shard), unpack(r.tree)
                a = unpack(r.asks)
                score, at = floors(a, r.known)
                best = search_tree(tree, a["ids"], a["q"], score, at, k)
                found = best.scores > -np.inf
                yield pd.DataFrame({
                    "cell": r.cell, "block": r.block, "query_id": np.repeat(a["ids"], k)[found.ravel()],
                    "vec_id": best.ids[found], "score": best.scores[found],
                })

    place = Window.partitionBy("cell", "block", "query_id").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], "cell int, block int, query_id long, vec_id long, score double, rank int")
    state = blocks.select("cell", "block", F.lit(None).cast("array<int>").alias("rest"))
    take = FIRST
    while True:
        kth = best.where(F.col("rank") == k).groupBy("cell", "block").agg(F.collect_list(F.struct("query_id", "score", "vec_id")).alias("known"))
        asking = blocks.join(kth, ["cell", "block"], "left")
        state = checkpoint(state.where("rest is null or size(rest) > 0").select("cell", "block", "rest").join(asking, ["cell", "block"]).select(
            "cell", "block", "asks", "rest", "known"
        ).mapInPandas(next_cells(take), "cell int, block int, now array<int>, rest array<int>"))
        n_met = state.agg(F.sum(F.size("now"))).first()[0] or 0
        if not n_met:
            break
        # so many partitions that few blocks meet in a task, however few bytes they are
        tasks = int(min(n_met, max(spark.sparkContext.defaultParallelism, n_met // 16, 1)))
        shards = trees.withColumnRenamed("cell", "at_cell")
        meets = state.select("cell", "block", F.explode("now").alias("at_cell")).join(shards.select("at_cell", "shard"), "at_cell").join(asking, ["cell", "block"])
        found = meets.repartition(tasks, "at_cell", "shard").join(shards.repartition(tasks, "at_cell", "shard"), ["at_cell", "shard"]).select(
            "cell", "block", "asks", "known", "at_cell", "shard", "tree"
        ).mapInPandas(visit, "cell int, block int, query_id long, vec_id long, score double")
        best = checkpoint(best.drop("rank").unionByName(found).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k))
        take *= FASTER
    score = F.when(F.col("score") >= 2.0**63, F.lit(2**63 - 1)).when(F.col("score") <= -(2.0**63), F.lit(-(2**63))).otherwise(F.col("score").try_cast("long"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
