"""Exact top-k search by inner product with dual cover trees.

Vectors are quantised to floor(256 * x). Queries and data are both indexed: farthest-first traversal gives a node's children, centres
that cover the node at some scale and are at least that scale apart, and every node knows its covering radius. For a query node
(centre q, radius s) and a data node (centre p, radius r) no inner product exceeds q.p + s|p| + r|q| + s r; the pair is pruned if
that is below the worst k-th score of the query group.

On Spark: the first level is a set of pivots from a bounded sample, which deal all vectors into cells; cells are cut into blocks of
about ``block_rows`` by a hash of the id, so one crowded cell (a third of all vectors may be equal) becomes many blocks. The sample
also gives each query a lower bound of its k-th score, and a query is sent only to the cells that it can't rule out. A block and
its queries, in chunks of about ``chunk_queries``, are indexed and searched together in one task; the k best per block meet in a window.

Bounds: the sample (``sample`` vectors) and the cells (``cells`` rows) reach the driver; nothing else does.

Defined results
---------------
* Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Only vectors of one length
  are compared. Empty vectors score 0.
* Scores are exact; beyond the range of a long they are clipped to it. Ties go to the smaller id.
* Repeated candidates are ranked as separate rows. A query id that stands on several rows is one query, with its least vector; rows
  with the query's own id are never its candidates. Fewer than k candidates give fewer rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NONE = np.iinfo(np.int64).min


def quantised(df: DataFrame, is_query: Column, id_col: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v, dim, asks): the vectors that take part, as arrays of long; asks holds for queries."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull() & ~bad)
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), F.size(vector).alias("dim"), is_query.alias("asks"))


def matrix(vectors, dim: int) -> np.ndarray:
    return np.array(list(vectors), np.int64).reshape(len(vectors), dim)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


class CoverTree:
    """Points in an order in which every node is a range; node k has centre, radius, range and children."""

    def __init__(self, points: np.ndarray, leaf: int = 64, fan: int = 12):
        x = points.astype(np.float64)
        order, self.center, self.radius, self.start, self.end, self.children = [], [], [], [], [], []
        todo = [(np.arange(len(x)), 0, -1)] if len(x) else []
        at = 0
        while todo:
            own, center, parent = todo.pop()
            node = len(self.center)
            near = np.sqrt(((x[own] - x[center]) ** 2).sum(axis=1))
            self.center.append(center)
            self.radius.append(float(near.max()) * (1 + 1e-9))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            # Nodes come in depth-first order, so a node's range begins where the leaves before it end.
            self.start.append(at)
            self.end.append(at + len(own))
            if len(own) <= leaf or near.max() == 0:
                order.append(own)
                at += len(own)
                continue
            centers, of = [center], np.zeros(len(own), np.int64)
            while len(centers) < fan and near.max() > 0.5 * self.radius[node]:
                new = int(own[near.argmax()])
                far = np.sqrt(((x[own] - x[new]) ** 2).sum(axis=1))
                closer = far < near
                near, of = np.where(closer, far, near), np.where(closer, len(centers), of)
                centers.append(new)
            todo += [(own[of == k], c, node) for k, c in enumerate(centers)]
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.radius = np.array(self.radius)
        self.points = x[self.center] if len(x) else x
        self.norm = np.sqrt((self.points**2).sum(axis=1))


class Search:
    """The k best of a block's vectors for each query of a chunk."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.k, self.data, self.tree = k, CoverTree(vectors), CoverTree(queries)
        self.ids, self.vectors = ids[self.data.order], vectors[self.data.order]
        self.query_ids, self.queries = query_ids[self.tree.order], queries[self.tree.order]
        self.worst = floor[self.tree.order].copy()
        self.score = np.full((len(queries), k), NONE, np.int64)
        self.best = np.zeros((len(queries), k), np.int64)

    def bounds(self, q: int, nodes: list[int]) -> np.ndarray:
        t, d = self.tree, self.data
        s, r = t.radius[q], d.radius[nodes]
        top = d.points[nodes] @ t.points[q] + s * d.norm[nodes] + r * t.norm[q] + s * r
        return top + 1e-6 * (1 + np.abs(top))

    def leaves(self, q: int, r: int) -> None:
        a, b = slice(self.tree.start[q], self.tree.end[q]), slice(self.data.start[r], self.data.end[r])
        scores = inner(self.queries[a], self.vectors[b])
        scores[self.query_ids[a][:, None] == self.ids[b][None, :]] = NONE
        if not (scores >= self.worst[a][:, None]).any():
            return
        both = np.concatenate([self.score[a], scores], axis=1)
        ids = np.concatenate([self.best[a], np.broadcast_to(self.ids[b], scores.shape)], axis=1)
        first = np.lexsort((ids, -both.astype(np.float64)), axis=1) if np.abs(both[both != NONE]).max(initial=0) < 2**53 else np.array([sorted(range(both.shape[1]), key=lambda j: (-int(s[j]), i[j])) for s, i in zip(both, ids)])
        first = first[:, : self.k]
        self.score[a] = np.take_along_axis(both, first, axis=1)
        self.best[a] = np.take_along_axis(ids, first, axis=1)
        self.worst[a] = np.maximum(self.worst[a], self.score[a][:, -1])

    def run(self) -> None:
        if not len(self.queries) or not len(self.vectors):
            return
        todo = [(0, 0, float("inf"))]
        while todo:
            q, r, bound = todo.pop()
            if bound < self.worst[self.tree.start[q] : self.tree.end[q]].min():
                continue
            q_children, r_children = self.tree.children[q], self.data.children[r]
            if not q_children and not r_children:
                self.leaves(q, r)
            elif r_children and (not q_children or self.data.radius[r] >= self.tree.radius[q]):
                top = self.bounds(q, r_children)
                todo += [(q, r_children[j], top[j]) for j in np.argsort(top)]  # the most promising is on top
            else:
                todo += [(c, r, float(self.bounds(c, [r])[0])) for c in q_children]

    def rows(self) -> pd.DataFrame:
        found = self.score != NONE
        query = np.broadcast_to(self.query_ids[:, None], found.shape)
        return pd.DataFrame({"query_id": query[found], "vec_id": self.best[found], "score": self.score[found]})


def pivots_of(points: np.ndarray, cells: int) -> np.ndarray:
    """Farthest-first pivots: each new one is the farthest from those before."""
    x = points.astype(np.float64)
    chosen, near = [0], np.full(len(x), np.inf)
    while True:
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        if len(chosen) >= cells or near.max() == 0:
            return x[chosen]
        chosen.append(int(near.argmax()))


def top_k_search(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    sample: int = 2048,
    cells: int = 32,
    block_rows: int = 8192,
    chunk_queries: int = 16384,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query, the k rows with the highest inner products, itself aside."""
    rows = quantised(df, is_query, id_col, vector)
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = [_search(rows.where(F.col("dim") == d), d, k, sample, cells, block_rows, chunk_queries) for (d,) in rows.select("dim").distinct().collect()]
    for part in parts:
        empty = empty.unionByName(part)
    return empty if len(parts) != 1 else parts[0]


def _search(rows: DataFrame, dim: int, k: int, sample: int, cells: int, block_rows: int, chunk_queries: int) -> DataFrame:
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "v").limit(sample).toPandas()
    seen_ids, seen = taken["vec_id"].to_numpy(np.int64), matrix(taken["v"], dim)
    pivots = pivots_of(seen, cells)

    def near(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = vectors.astype(np.float64)
        d = np.stack([((x - p) ** 2).sum(axis=1) for p in pivots], axis=1)
        cell = d.argmin(axis=1)
        return cell, np.sqrt(d[np.arange(len(x)), cell])

    def assign(frames):
        for f in frames:
            cell, dist = near(matrix(f["v"], dim)) if len(f) else (np.zeros(0, int), np.zeros(0))
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "cell": cell.astype(np.int32), "dist": dist})

    placed = rows.select("vec_id", "v").mapInPandas(assign, "vec_id long, v array<long>, cell int, dist double")
    stats = {r["cell"]: (r["n"], r["r"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()}
    blocks = np.array([max(1, -(-stats.get(c, (0, 0))[0] // block_rows)) for c in range(len(pivots))])
    radii = np.array([stats[c][1] if c in stats else -1.0 for c in range(len(pivots))]) * (1 + 1e-9)
    norms = np.sqrt((pivots**2).sum(axis=1))

    queries = rows.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    chunks = max(1, -(-queries.count() // chunk_queries))

    def send(frames):
        """Each query to the blocks of the cells that may hold one of its k best; floor is a lower bound of its k-th score."""
        for f in frames:
            v, ids = matrix(f["v"], dim), f["vec_id"].to_numpy(np.int64)
            scores = inner(v, seen)
            scores[ids[:, None] == seen_ids[None, :]] = NONE
            floor = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(v), NONE)
            x = v.astype(np.float64)
            top = x @ pivots.T + np.sqrt((x**2).sum(axis=1))[:, None] * np.maximum(radii, 0)
            q, c = np.nonzero((top + 1e-6 * (1 + np.abs(top)) >= floor[:, None]) & (radii >= 0))
            times = blocks[c]
            q, c = np.repeat(q, times), np.repeat(c, times)
            block = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
            yield pd.DataFrame({"cell": c.astype(np.int32), "block": block.astype(np.int32), "query_id": ids[q], "v": [v[j] for j in q], "floor": floor[q]})

    sent = queries.mapInPandas(send, "cell int, block int, query_id long, v array<long>, floor long")
    sent = sent.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    count = F.array(*[F.lit(int(b)) for b in blocks])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.get(count, F.col("cell"))).cast("int"))
    placed = placed.drop("dist").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = Search(data["vec_id"].to_numpy(np.int64), matrix(data["v"], dim), asked["query_id"].to_numpy(np.int64), matrix(asked["v"], dim), asked["floor"].to_numpy(np.int64), k)
        found.run()
        return found.rows()

    keys = ["cell", "block", "chunk"]
    found = placed.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
