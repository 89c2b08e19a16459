"""Exact top-k inner-product search: ball trees per shard, branch and bound, a shared kth score.

Vectors are dealt by a hash of their id into shards of about ``SHARD`` candidates and blocks of about
``BLOCK`` queries. Every (block, shard) pair is one task group of bounded size: a ball tree over the
shard is walked level by level, (query, node) pairs whose upper bound q.c + |q| r is below the
query's kth score are cut off, and leaves are visited in the order of their bounds. Each block first
searches one shard; the kth scores found there are shared with the searches of all other shards,
which so start with a bound. A last ranking per query joins the shards' survivors.

Scores are whole numbers and exact: products run in float64 while they stay below 2 ** 53, else in
Python integers; a score beyond 64 bits raises an error.

Defined results: rows with a null id, a null or empty vector, or null or non-finite components take
no part; only vectors of the same length are compared; rows with the same id and vector are one, an
id with several vectors is several candidates and queries are never matched with their own id; ties
go to the smaller id; an empty table gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

SHARD, BLOCK, LEAF = 4096, 4096, 64
#: below every score
LOWEST = -(1 << 62)
FOUND = "query_id long, version long, vec_id long, score long"


def integer_vector(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Neither null nor empty, without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


class BallTree:
    """Nodes in breadth-first order with centre, radius and the range of their vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(vectors))
        x = vectors.astype(np.float64)
        self.low, self.high, self.child, centres, radii = [], [], [], [], []
        todo = [(0, len(x))]
        while len(self.low) < len(todo):
            a, b = todo[len(self.low)]
            own = x[self.order[a:b]]
            centre = own.mean(0)
            far = own - centre
            radius = np.sqrt((far * far).sum(1).max())
            self.low.append(a), self.high.append(b), centres.append(centre), radii.append(radius)
            if b - a <= leaf or radius == 0:
                self.child.append(-1)
                continue
            one = own[np.argmax((far * far).sum(1))]  # the farthest vector and the one farthest from it
            two = own[np.argmax(((own - one) ** 2).sum(1))]
            mid = a + (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argsort(own @ (two - one), kind="stable")]
            self.child.append(len(todo))
            todo += [(a, mid), (mid, b)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.vectors, self.ids = vectors[self.order], ids[self.order]
        self.smallest = np.array([self.ids[a:b].min() for a, b in zip(self.low, self.high, strict=True)])


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (a @ b.T).astype(np.int64)
    return np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a], dtype=np.int64).reshape(len(a), len(b))


def search(tree: BallTree, queries: np.ndarray, own_ids: np.ndarray, kth: np.ndarray, k: int):
    """(query row, id, score) of the k best candidates per query that reach ``kth`` (the score known
    to be reached by k candidates elsewhere), other than the query's own id."""
    n = len(queries)
    big = max(float(np.abs(queries).max(initial=0)), float(np.abs(tree.vectors).max(initial=0)))
    exact = big * big * queries.shape[1] < 2.0**53
    q = queries.astype(np.float64)
    norms = np.sqrt((q * q).sum(1))
    slack = 1e-9 * (1 + big * big * queries.shape[1])
    lowest = LOWEST
    scores, ids = np.full((n, k), lowest), np.full((n, k), np.iinfo(np.int64).max)
    bar = kth.copy()  # a candidate must reach this score
    rows, nodes = np.arange(n), np.zeros(n, np.int64)
    leaves: list[tuple] = []
    child = np.array(tree.child)
    while len(rows):
        bound = np.einsum("ij,ij->i", q[rows], tree.centres[nodes]) + norms[rows] * tree.radii[nodes] + slack
        alive = bound >= bar[rows]
        rows, nodes, bound = rows[alive], nodes[alive], bound[alive]
        at = child[nodes] < 0
        leaves.append((rows[at], nodes[at], bound[at]))
        rows, nodes = np.repeat(rows[~at], 2), (child[nodes[~at]][:, None] + np.arange(2)).ravel()
    rows, nodes, bound = (np.concatenate(x) for x in zip(*leaves, strict=True))
    order = np.lexsort((-bound, rows))
    rows, nodes, bound = rows[order], nodes[order], bound[order]
    turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
    for step in range(int(turn.max(initial=-1)) + 1):
        now = turn == step
        r, v, u = rows[now], nodes[now], bound[now]
        # at the kth score itself only a smaller id can still get in
        worst = ids[r, -1]
        open_ = (u >= bar[r]) & ((u >= scores[r, -1] + 1) | (tree.smallest[v] < worst) | (scores[r, -1] == lowest))
        r, v = r[open_], v[open_]
        for node in np.unique(v):
            who = r[v == node]
            a, b = tree.low[node], tree.high[node]
            for part in range(a, b, 4 * LEAF):  # a leaf of equal vectors may be large
                stop = min(b, part + 4 * LEAF)
                left, right = (q, tree.vectors[part:stop].astype(np.float64)) if exact else (queries, tree.vectors[part:stop])
                got = _products(left[who], right, exact)
                got = np.where(tree.ids[None, part:stop] == own_ids[who][:, None], lowest, got)
                better = got.max(1) >= np.maximum(bar[who], scores[who, -1])
                if better.any():
                    w, g = who[better], got[better]
                    g = np.where(g < bar[w][:, None], lowest, g)
                    all_s = np.concatenate([scores[w], g], 1)
                    all_i = np.concatenate([ids[w], np.where(g == lowest, np.iinfo(np.int64).max, tree.ids[None, part:stop])], 1)
                    top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                    scores[w], ids[w] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
                    bar[w] = np.maximum(bar[w], scores[w, -1])
    at = np.nonzero(scores > lowest)
    return at[0], ids[at], scores[at]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _group_search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": [], "version": [], "vec_id": [], "score": []}
        kind = pa.schema([(c, pa.int64()) for c in empty])
        if not left.num_rows or not right.num_rows:
            return pa.table(empty, kind)
        tree = BallTree(_matrix(right["v"]), right["vec_id"].to_numpy())
        own, version = left["query_id"].to_numpy(), left["version"].to_numpy()
        row, ids, scores = search(tree, _matrix(left["v"]), own, left["kth"].to_numpy(), k)
        return pa.table({"query_id": own[row], "version": version[row], "vec_id": ids, "score": scores}, kind)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, version, rank, vec_id, score): for each row for which ``is_query`` (over the id) holds,
    its k best other rows. version numbers the vectors of an id that has several."""
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), integer_vector(F.col(vector_col), scale).alias("v")).distinct()
    rows = written(rows.withColumn("dim", F.size("v")), "topk-vectors")
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("version"), "v", "dim")
    lowest = LOWEST
    sizes = rows.agg(F.count("*"), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-sizes[0] // SHARD)), max(1, -(-sizes[1] // BLOCK))
    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("query_id", "version"), F.lit(blocks)).alias("block")
    asked = asked.select("query_id", "version", "v", "dim", block)
    held = rows.select("vec_id", "v", "dim", shard)
    keys = ["dim", "block", "shard"]

    def searched(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        own = candidates.select(*[F.col(c).alias(c) for c in candidates.columns])  # both sides come from one table
        return queries.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(_group_search(k), FOUND)

    home = F.pmod(F.col("block"), F.lit(shards))
    # the first shard of each block
    blocks_of = F.sequence(F.col("shard"), F.lit(blocks - 1).cast("long"), F.lit(shards).cast("long"))
    first_side = held.filter(F.col("shard") < blocks).withColumn("block", F.explode(blocks_of))
    first = written(searched(asked.withColumn("shard", home).withColumn("kth", F.lit(lowest)), first_side), "topk-first")
    reached = first.groupBy("query_id", "version").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    reached = reached.select("query_id", "version", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(lowest)).alias("kth"))
    known = asked.join(reached, ["query_id", "version"], "left").withColumn("kth", F.coalesce("kth", F.lit(lowest)))
    # all other shards
    every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    rest = known.withColumn("shard", F.explode(every)).filter(F.col("shard") != home)
    sides = held.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).filter(F.col("shard") != home)
    both = first.unionByName(searched(rest, sides)) if shards > 1 else first
    rank = F.row_number().over(Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "version", "rank", "vec_id", "score")
