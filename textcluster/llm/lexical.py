"""Ranked lexical search: exact inner-product search over sparse documents with ball trees.

A document is a sparse vector of saturated term counts, an item (the query) one of term weights, and
the score is their inner product in integers. Items are taken in blocks of bounded size; for a block
the documents are reduced to the block's terms once, written, and searched by shards of a few
thousand documents. Each shard is split into a ball tree: a node holds the centroid of its documents
and, for each group of terms, the largest distance of a document from the centroid in these terms. A
document's score is then at most ``sum over groups (q.c + |q| r)``, by Cauchy-Schwarz in each group.
The bounds are rounded up safely: squared radii get 1e-9 of the squared lengths that they are
differences of, and bounds 1e-9 of themselves plus 1, while the sums (up to 1e6 terms) err by less than
1e-10. Subtrees are visited best first and pruned when their bound is below the item's current kth
score; leaves are scored exactly in 64-bit integers. Terms are grouped by the items that use them (a
small k-means of the block's items), so that documents without a group's terms, those of another language
for instance, have no radius there.

kth scores are shared: the best scores among 1/64 of the documents, drawn by hash, are a floor for
every shard, and a task carries its own best scores from shard to shard. All documents are searched.

Terms are compared as 64-bit hashes. Defined results: a null or empty text has no terms and takes no
part; every row is a document of its own, also rows that repeat an id or text; a null id sorts before
all ids and is returned as null; equal (item id, text) rows are one item; an item without terms, or
with terms that no document holds, gives no rows; empty tables give no rows. Only the id and text
columns are read.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .common import MIN_LONG, ship, total, unpack, written

#: bytes of item text in a block (an item beyond that is a block of its own); documents and terms of a shard; of a leaf
BLOCK, SHARD_DOCS, SHARD_TERMS, LEAF = 1 << 20, 8192, 1 << 21, 256
GROUPS, PILOT = 8, 64
SLACK = 1e-9


def _terms(column: pa.Array):
    """(first row, terms per text, text of every term, hash of every term) of slices of texts."""
    for i, data, offsets in scan.texts(column, 1 << 20):
        starts, ends, first = scan.runs(data, offsets, scan.ALNUM[data])
        n = np.diff(first)
        yield i, n, np.repeat(np.arange(len(n)), n), scan.run_hashes(data, starts, ends)


@dataclass
class Items:
    """A block of items: sorted term hashes, and each item's terms (places among them) with their counts."""

    hashes: np.ndarray
    at: np.ndarray
    term: np.ndarray
    count: np.ndarray
    group: np.ndarray
    weight: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.at) - 1


def read_items(texts: pa.Array) -> Items:
    owner, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, _, text, found in _terms(texts):
        owner.append(i + text), hashes.append(found)
    known, place = np.unique(np.concatenate(hashes), return_inverse=True)
    pairs, count = np.unique(np.concatenate(owner) * max(len(known), 1) + place, return_counts=True)
    own, term = np.divmod(pairs, max(len(known), 1))
    at = np.searchsorted(own, np.arange(len(texts) + 1))
    return Items(known, at, term, count.astype(np.int64), _term_groups(at, term, count, len(known)))


def _term_groups(at: np.ndarray, term: np.ndarray, count: np.ndarray, n_terms: int) -> np.ndarray:
    """A group for every term: of the item cluster that uses it most. Any grouping gives right bounds."""
    n = len(at) - 1
    group = np.zeros(n_terms, np.int64)
    if n < 2:
        return group
    item = np.repeat(np.arange(n), np.diff(at))
    value = np.sqrt(count)
    norm = np.sqrt(np.maximum(np.bincount(item, count, n), 1))
    k = min(GROUPS, n)
    # spread starting points: each next one is the item least like those before
    centre, like = np.zeros((k, n_terms)), np.full(n, -1.0)
    seed = 0
    for g in range(k):
        centre[g, term[at[seed] : at[seed + 1]]] = value[at[seed] : at[seed + 1]]
        centre[g] /= max(np.linalg.norm(centre[g]), 1e-12)
        like = np.maximum(like, np.bincount(item, value * centre[g][term], n) / norm)
        seed = int(np.argmin(like))
    for _ in range(6):
        of = np.argmax(np.stack([np.bincount(item, value * c[term], n) for c in centre]), 0)
        centre = np.bincount(of[item] * n_terms + term, value, k * n_terms).reshape(k, n_terms)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return np.argmax(centre, 0)


def _matched(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, tfs) of every document with a term: its number of terms and those of the block."""
    shared = ship(docs.sparkSession, items)

    def run(batches):
        own = unpack(shared)
        size = max(len(own.hashes), 1)
        for batch in batches:
            for i, n, text, found in _terms(batch.column("text")):
                place = np.minimum(np.searchsorted(own.hashes, found), size - 1)
                hit = own.hashes[place] == found if len(own.hashes) else np.zeros(len(found), bool)
                pairs, tf = np.unique(text[hit] * size + place[hit], return_counts=True)
                of, term = np.divmod(pairs, size)
                stop = np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(stop), pa.array(x, pa.int32())) for x in (term, tf)]
                rows = pa.RecordBatch.from_arrays([batch.column("doc").slice(i, len(n)), pa.array(n), *lists], ["doc", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))

    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(MIN_LONG)).alias("doc")
    rows = docs.select(doc, F.col(text_col).alias("text")).mapInArrow(run, "doc long, n long, terms array<int>, tfs array<int>")
    return written(rows, "lexical-docs")


def _weights(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(N, L, weight of each term); of the corpus, two numbers and one count per term reach the driver."""
    n_docs, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[np.asarray(held.column("term"))] = np.asarray(held.column("df"))
    return n_docs, length, np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


@dataclass
class Ball:
    lo: int
    hi: int
    centre: np.ndarray
    radius: np.ndarray
    below: tuple[int, ...]


class Shard:
    """Documents with their ball tree; ``doc``, and in tree order ``at``, ``term``, ``value``."""

    def __init__(self, doc: np.ndarray, at: np.ndarray, term: np.ndarray, value: np.ndarray, weight: np.ndarray, group: np.ndarray):
        # the terms that stand here are numbered anew, so that centroids are as long as the shard needs
        self.terms, term = np.unique(term, return_inverse=True)
        self.group = group[self.terms]
        self.doc, self.at, self.term, self.value = doc, at, term, value
        self.y = value * weight[self.terms][term].astype(np.float64)
        self.balls: list[Ball] = []
        order = np.arange(len(doc))
        self._grow(order, 0)
        size = np.diff(at)[order]
        flat = np.repeat(at[:-1][order], size) + _ramp(size)
        self.doc, self.at, self.term, self.value = doc[order], np.concatenate([[0], np.cumsum(size)]), term[flat], value[flat]

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.diff(self.at)[rows]
        flat = np.repeat(self.at[:-1][rows], size) + _ramp(size)
        return np.repeat(np.arange(len(rows)), size), self.term[flat], self.y[flat]

    def _grow(self, order: np.ndarray, lo: int) -> int:
        """Adds the subtree over ``order`` (a view, put in tree order here) and returns its place."""
        n, width = len(order), len(self.terms)
        row, term, y = self._entries(order)
        centre = np.bincount(term, y, width) / n
        groups = GROUPS
        key = row * groups + self.group[term]
        own = np.bincount(key, y * y, n * groups).reshape(n, groups)
        cross = np.bincount(key, y * centre[term], n * groups).reshape(n, groups)
        base = np.bincount(self.group, centre * centre, groups)
        square = np.maximum(own - 2 * cross + base, 0) + SLACK * (own + base)
        place = len(self.balls)
        ball = Ball(lo, lo + n, centre, np.sqrt(square.max(0)), ())
        self.balls.append(ball)
        if n > LEAF:
            far = int(np.argmax(square.sum(1)))
            one = np.bincount(term[row == far], y[row == far], width)
            away = own.sum(1) - 2 * np.bincount(row, y * one[term], n)
            two = row == int(np.argmax(away))
            line = one - np.bincount(term[two], y[two], width)
            order[:] = order[np.argsort(np.bincount(row, y * line[term], n), kind="stable")]
            half = n // 2
            ball.below = (self._grow(order[:half], lo), self._grow(order[half:], lo + half))
        return place

    def bounds(self, items: Items, weight_free: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Upper bound of the score of each item (rows) in each ball."""
        centres = np.stack([b.centre for b in self.balls])
        radii = np.stack([b.radius for b in self.balls])
        out = np.zeros((len(weight_free), len(self.balls)))
        for i, (term, count) in enumerate(weight_free):
            length = np.sqrt(np.bincount(items.group[term], (count * count).astype(np.float64), GROUPS))
            place = np.minimum(np.searchsorted(self.terms, term), max(len(self.terms) - 1, 0))
            here = self.terms[place] == term
            out[i] = centres[:, place[here]] @ count[here].astype(np.float64) + radii @ length
        return out * (1 + SLACK) + 1


def _ramp(sizes: np.ndarray) -> np.ndarray:
    stop = np.cumsum(sizes)
    return np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - sizes, sizes)


class Best:
    """The k best (score, document) of every item so far, and a score below which nothing counts."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, np.maximum(floor, 1)
        self.score, self.doc = [np.zeros(0, np.int64) for _ in range(n)], [np.zeros(0, np.int64) for _ in range(n)]

    def least(self, i: int) -> int:
        return int(self.score[i][-1]) if len(self.score[i]) == self.k else int(self.floor[i])

    def add(self, i: int, score: np.ndarray, doc: np.ndarray) -> None:
        near = score >= self.least(i)
        if near.any():
            score, doc = np.concatenate([self.score[i], score[near]]), np.concatenate([self.doc[i], doc[near]])
            top = np.lexsort((doc, -score))[: self.k]
            self.score[i], self.doc[i] = score[top], doc[top]


def search_shard(shard: Shard, items: Items, best: Best) -> int:
    """Searches the shard for every item; the number of documents scored."""
    own = [(items.term[a:b], items.count[a:b]) for a, b in zip(items.at[:-1], items.at[1:], strict=True)]
    limits, scored = shard.bounds(items, own), 0
    lookup = np.zeros(len(items.hashes), np.int64)
    for i, (term, count) in enumerate(own):
        if not len(term):
            continue
        lookup[term] = count * items.weight[term]
        factor = lookup[shard.terms]
        lookup[term] = 0
        queue = [(-limits[i, 0], 0)]
        while queue:
            limit, place = heapq.heappop(queue)
            if -limit < best.least(i):
                break
            ball = shard.balls[place]
            if ball.below:
                for x in ball.below:
                    heapq.heappush(queue, (-limits[i, x], x))
                continue
            a, b = shard.at[ball.lo], shard.at[ball.hi]
            sums = np.concatenate([[0], np.cumsum(factor[shard.term[a:b]] * shard.value[a:b])])
            edge = shard.at[ball.lo : ball.hi + 1] - a
            best.add(i, sums[edge[1:]] - sums[edge[:-1]], shard.doc[ball.lo : ball.hi])
            scored += ball.hi - ball.lo
    return scored


def _shards(batches, n_docs: int, length: int, items: Items):
    """Shards of the rows that hold a term of the block."""
    held: list = []

    def made():
        doc, n, size, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        m = np.repeat(25 + (75 * n * n_docs) // length, size)
        value = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
        return Shard(doc, np.concatenate([[0], np.cumsum(size)]), term, value, items.weight, items.group)

    for batch in batches:
        size = np.asarray(batch.column("terms").value_lengths()).astype(np.int64)
        doc, n = np.asarray(batch.column("doc")), np.asarray(batch.column("n"))
        term, tf = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("terms", "tfs"))
        stop, a = np.concatenate([[0], np.cumsum(size)]), 0
        while a < len(size):
            b = min(a + SHARD_DOCS, max(a + 1, int(np.searchsorted(stop, stop[a] + SHARD_TERMS, "right")) - 1))
            full = size[a:b] > 0
            if full.any():
                held.append((doc[a:b][full], n[a:b][full], size[a:b][full], term[stop[a] : stop[b]], tf[stop[a] : stop[b]]))
            if sum(len(x[0]) for x in held) >= SHARD_DOCS or sum(len(x[3]) for x in held) >= SHARD_TERMS:
                yield made()
            a = b
    if held:
        yield made()


def _found(rows: DataFrame, items: Items, k: int, n_docs: int, length: int, floor: np.ndarray) -> DataFrame:
    """(item, score, doc): the best of every task that reach the floor."""
    shared = ship(rows.sparkSession, (items, floor))

    def run(batches):
        own, least = unpack(shared)
        best = Best(len(own), k, least)
        for shard in _shards(batches, n_docs, length, own):
            search_shard(shard, own, best)
        item = np.repeat(np.arange(len(own)), [len(x) for x in best.score])
        columns = [pa.array(item), pa.array(np.concatenate([np.zeros(0, np.int64), *best.score])), pa.array(np.concatenate([np.zeros(0, np.int64), *best.doc]))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "score", "doc"])

    return rows.mapInArrow(run, "item long, score long, doc long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: pa.Table, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, rank, doc, score) for the items of one block; item is the row number in the block."""
    items = read_items(block.column("text"))
    rows = _matched(docs, items, id_col, text_col)
    n_docs, length, items.weight = _weights(rows, len(items.hashes))
    floor = np.zeros(len(items), np.int64)
    pilot = rows.filter(F.pmod(F.xxhash64("doc", "n"), F.lit(PILOT)) == 0)
    for item, least, n in _ranked(_found(pilot, items, k, n_docs, length, floor), k).groupBy("item").agg(F.min("score"), F.count("*")).collect():
        if n == k:
            floor[item] = least
    return _ranked(_found(rows, items, k, n_docs, length, floor), k).select("item", "rank", "doc", "score")


def top_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK
) -> DataFrame:
    """(item_id, rank, doc, score): the k documents with the highest scores above 0 for every item."""
    spark = docs.sparkSession
    own = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    own = written(own.withColumn("size", F.octet_length("text").cast("long")), "lexical-items")
    own = own.withColumn("block", F.pmod(F.xxhash64("text", "item_id"), F.lit(-(-total(own, "size") // block_bytes))))
    found = []
    for (b,) in own.select("block").filter("size > 0").distinct().collect():
        block = own.filter(F.col("block") == b).select("item_id", "text").toArrow()
        names = spark.createDataFrame(block.select(["item_id"]).append_column("item", pa.array(range(block.num_rows), pa.int64())))
        ranked = written(_search_block(docs, block, k, id_col, text_col), "lexical-found")
        found.append(ranked.join(F.broadcast(names), "item"))
    real = F.when(F.col("doc") != MIN_LONG, F.col("doc")).alias("doc")
    if not found:
        kind = own.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc long, score long")
    return reduce(DataFrame.unionByName, found).select("item_id", "rank", real, "score")
