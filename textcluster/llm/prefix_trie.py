"""Prefix trie of conversations by union-find over sorted-neighbour LCP edges.

A conversation is the sequence of its turns; a turn is a 128-bit digest of role and text. Sorting
the sequences (range-partitioned, shorter prefixes first, equal sequences by id) puts the members of
every trie node next to each other. Inside a partition the edges between neighbours, each with the
length of their longest common prefix (LCP), are taken in descending depth by a union-find: a merge
of two components at depth e makes the branching node of depth e, or hands one component to the
other's node where that already has depth e. Chains of nodes without a branch are written out from
the depths of a node and its parent.

Forests are merged across boundaries by their spines. A node of depth d that touches a partition's
border is open if the border's LCP is d or more; only those are not complete inside the partition.
Each is contracted to one row of sums (members, leaves, children, shared text) under a 128-bit
identity of its prefix, and the rows of all partitions are added up: a node that spans k partitions
gives k rows, whatever its members. Each sum is over properties of a member and its two neighbours
alone (it ends a leaf; it opens a child; the text shared with its predecessor), so that parts add up.

Only digests, lengths and ids are sorted and shuffled, never texts; one conversation's digests are one
row (about 40 bytes a turn). The ids of conversations that end at a node are hashed in one pass over
blocks in order, with one batch of blocks in memory.

Defined results: turns are ordered by turn number (null first), equal ones by the digest of role and
text, and repeated rows stay repeated turns; a null role or text is empty; rows with a null
conversation id are left out; a conversation without turns is a member of the root; an empty table
gives no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textcluster.session import ensure_checkpoint_dir

from .common import written

DIGEST = 32
BLOCK = 512
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = T.StructType([
    T.StructField(name, T.StringType() if name in ("nid", "up", "ends") else T.ArrayType(T.StringType()) if name == "ids" else T.LongType())
    for name in ("part", "nid", "up", "depth", "conv", "parent", "n", "children", "leaves", "shared", "before", "ends", "ids")
])


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns array<struct<turn, digest, size>>) in order; digest of role and text, size in code points."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).alias("size")).alias("t"))
    return rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(own: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Every sequence with its first ``head`` turns replaced by those of the conversation ``base``
    (none if absent); ``head`` is at most ``most``, so a base hands on no more than that."""
    bases = own.select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most).alias("__first"))
    joined = own.withColumn("__base_id", base).join(bases, F.col("__base_id") == F.col("__base"), "left")
    size = F.size("turns")
    first = F.slice(F.coalesce("__first", F.slice("turns", 1, 0)), F.lit(1), head)
    rest = F.slice("turns", head + 1, F.greatest(size - head, F.lit(0)))
    return joined.select("conv_id", F.concat(first, rest).alias("turns"))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two digest arrays."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    return int(differs[0]) if len(differs) else n


def _digests(key: str) -> np.ndarray:
    return np.frombuffer(key.encode(), f"S{DIGEST}")


def _ramp(sizes: np.ndarray) -> np.ndarray:
    stop = np.cumsum(sizes)
    return np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - sizes, sizes)


def neighbour_lcp(digests: np.ndarray, at: np.ndarray) -> np.ndarray:
    """lcp[j] of sequences j - 1 and j (lcp[0] = 0); sequence j is digests[at[j] : at[j + 1]]."""
    length = np.diff(at)
    out = np.zeros(len(length), np.int64)
    if len(length) < 2:
        return out
    n = np.minimum(length[:-1], length[1:])
    ramp = _ramp(n)
    same = digests[np.repeat(at[:-2], n) + ramp] == digests[np.repeat(at[1:-1], n) + ramp]
    place = np.where(same, np.iinfo(np.int64).max, ramp)
    out[1:] = n
    full = np.flatnonzero(n)
    if len(full):
        out[1:][full] = np.minimum(n[full], np.minimum.reduceat(place, (np.cumsum(n) - n)[full]))
    return out


def forest(lcp: np.ndarray, length: np.ndarray, conv: np.ndarray) -> tuple[np.ndarray, ...]:
    """(depth, parent, lo, hi, smallest id, children) of the branching nodes, ends and root over sorted
    sequences; a node's members are the sequences lo .. hi. Parent is a place in these arrays, -1 at the root."""
    n = len(length)
    depth, lo, hi, low, children = length.tolist(), list(range(n)), list(range(n)), conv.tolist(), [0] * n
    parent, same_as = [-1] * n, list(range(n))
    leader, top = list(range(n)), list(range(n))  # of sequences; top: the node above a component

    def find(x: int, of: list[int]) -> int:
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    cuts = lcp.tolist()
    for j in (np.argsort(-lcp[1:], kind="stable") + 1).tolist():
        e, x, y = cuts[j], find(j - 1, leader), find(j, leader)
        a, b = top[x], top[y]
        if depth[a] == e and depth[b] == e:
            children[a] += children[b]
            same_as[b] = a
            node = a
        elif depth[a] == e or depth[b] == e:
            node, other = (a, b) if depth[a] == e else (b, a)
            parent[other] = node
            children[node] += 1
        else:
            node = len(depth)
            for to, value in ((depth, e), (lo, 0), (hi, 0), (low, 0), (children, 2), (parent, -1), (same_as, node)):
                to.append(value)
            parent[a] = parent[b] = node
        lo[node], hi[node], low[node] = lo[a], hi[b], min(low[a], low[b])
        leader[y] = x
        top[x] = node
    head = top[find(0, leader)]
    if depth[head] > 0:
        parent[head] = len(depth)
        for to, value in ((depth, 0), (lo, 0), (hi, n - 1), (low, low[head]), (children, 1), (parent, -1), (same_as, len(depth))):
            to.append(value)
    live = np.flatnonzero(np.array(same_as) == np.arange(len(depth)))
    place = np.full(len(depth) + 1, -1)
    place[live] = np.arange(len(live))
    above = np.array([find(p, same_as) if p >= 0 else -1 for p in parent])[live]
    return np.array(depth)[live], place[above], np.array(lo)[live], np.array(hi)[live], np.array(low)[live], np.array(children)[live]


def _prefix_ids(digests: np.ndarray, most: int) -> list[str]:
    """Identity of the prefixes of 0 .. most turns."""
    h, out = hashlib.md5(), []
    for d in range(most + 1):
        out.append(f"{d}:{h.hexdigest()}")
        if d < most:
            h.update(digests[d])
    return out


def _ids(conv: np.ndarray) -> str:
    return ",".join(map(str, conv.tolist()))


def partition_nodes(part: int, conv: np.ndarray, digests: np.ndarray, at: np.ndarray, sizes: np.ndarray, before: int, after: int) -> pa.RecordBatch:
    """The trie nodes of one partition of sorted sequences; ``before`` and ``after`` are the LCP with the
    neighbours beyond its borders (-1: none). Open nodes carry ``nid``, and nodes below an open one ``up``."""
    n, length = len(conv), np.diff(at)
    lcp = neighbour_lcp(digests, at)
    depth, parent, lo, hi, low, children = forest(lcp, length, conv)
    done = np.concatenate([[0], np.cumsum(sizes)])
    text = lambda j, d: done[at[j] + d] - done[at[j]]  # noqa: E731  code points of the first d turns of sequence j
    lcp[0] = max(before, 0)
    ends_leaf = np.append(lcp[1:], after) < length
    leaves = np.concatenate([[0], np.cumsum(ends_leaf)])
    shared = text(np.arange(n), lcp)
    shared_sum = np.concatenate([[0], np.cumsum(np.where(np.arange(n) > 0, shared, 0))])
    new = np.concatenate([[True], (lcp[1:] != length[1:]) | (length[:-1] != length[1:])])
    stop = np.append(np.flatnonzero(new), n)
    run = stop[np.searchsorted(stop, lo, "right")] - lo  # equal sequences from lo on
    n_ends = np.where(length[lo] == depth, run, 0)

    top = np.where(parent >= 0, depth[parent], -1)
    chain = depth - top
    node = np.repeat(np.arange(len(depth)), chain)
    d = np.repeat(top + 1, chain) + _ramp(chain)
    last = d == depth[node]
    first, final = lo[node] == 0, hi[node] == n - 1
    opened = (first & (d <= before)) | (final & (d <= after))
    above = np.where(d == top[node] + 1, parent[node], node)
    up_opened = (d > 0) & (((lo[above] == 0) & (d - 1 <= before)) | ((hi[above] == n - 1) & (d - 1 <= after)))
    kids = np.where(last, children[node], 1) - (first & (before > d))
    inside = shared_sum[hi[node] + 1] - shared_sum[lo[node] + 1] + np.where(first & (before >= d), shared[0], 0)
    left, right = (_prefix_ids(digests[at[j] : at[j + 1]], most) for j, most in ((0, max(before, 0)), (n - 1, max(after, 0))))

    def names(which: np.ndarray, deep: np.ndarray, by_left: np.ndarray) -> pa.Array:
        out = [None] * len(which)
        for i in np.flatnonzero(which).tolist():
            out[i] = (left if by_left[i] else right)[deep[i]]
        return pa.array(out, pa.string())

    ends, blocks = [EMPTY] * len(node), [None] * len(node)
    for i in np.flatnonzero(last & (n_ends[node] > 0)).tolist():
        own = conv[lo[node[i]] : lo[node[i]] + n_ends[node[i]]]
        if opened[i]:
            ends[i], blocks[i] = None, [_ids(own[k : k + BLOCK]) for k in range(0, len(own), BLOCK)]
        else:
            ends[i] = hashlib.sha256(_ids(own).encode()).hexdigest()
    conv_id = low[node]
    parent_id = pa.array(low[above], mask=(d == 0) | up_opened)
    columns = [
        pa.array(np.full(len(node), part)), names(opened, d, first & (d <= before)), names(up_opened, d - 1, (lo[above] == 0) & (d - 1 <= before)),
        pa.array(d), pa.array(conv_id), parent_id, pa.array(hi[node] - lo[node] + 1), pa.array(kids),
        pa.array(leaves[hi[node] + 1] - leaves[lo[node]]), pa.array(inside), pa.array(text(lo[node], np.maximum(d - 1, 0))),
        pa.array(ends, pa.string()), pa.array(blocks, pa.list_(pa.string())),
    ]
    return pa.RecordBatch.from_arrays([c.cast(pa.int64()) if pa.types.is_integer(c.type) else c for c in columns], names=NODES.names)


def _partition(batches):
    """All nodes of a partition, in batches."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    whole = pa.Table.from_batches(parts).combine_chunks()
    keys, sizes = whole.column("key"), whole.column("sizes").combine_chunks()
    count = np.asarray(sizes.value_lengths()).astype(np.int64)
    digests = np.frombuffer("".join(keys.to_pylist()).encode(), f"S{DIGEST}")
    at = np.concatenate([[0], np.cumsum(count)])
    number = lambda c: np.asarray(whole.column(c).combine_chunks())
    nodes = partition_nodes(int(number("part")[0]), number("conv_id"), digests, at, np.asarray(sizes.flatten()).astype(np.int64), int(number("before")[0]), int(number("after")[0]))
    for i in range(0, nodes.num_rows, 10000):
        yield nodes.slice(i, 10000)


def _digest_ids(batches):
    """One hash per node over its blocks of ids, which come in order; a node may go on in the next batch."""
    name, h = None, None
    for batch in batches:
        out = []
        for nid, ids in zip(batch.column("nid").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if nid != name:
                if h is not None:
                    out.append((name, h.hexdigest()))
                name, h = nid, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["nid", "ends"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (name, h.hexdigest())], ["nid", "ends"])


def _borders(rows: DataFrame) -> DataFrame:
    """(part, before, after): LCP of each partition's first and last sequence with its neighbours'. One
    row per partition; the window holds partition numbers only."""

    @F.arrow_udf("long")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([-1 if x is None or y is None else _common(_digests(x), _digests(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

    ends = written(rows.groupBy("part").agg(F.min("key").alias("lowest"), F.max("key").alias("highest")), "trie-borders")
    order = ends.select("part").selectExpr("part", "lag(part) OVER (ORDER BY part) AS prev")
    lows = ends.select("part", F.col("lowest").alias("here"))
    highs = ends.select(F.col("part").alias("prev"), F.col("highest").alias("there"))
    pairs = order.join(lows, "part").join(highs, "prev", "left").select("part", "prev", common("there", "here").alias("lcp"))
    pairs = written(pairs, "trie-lcp")
    after = pairs.select(F.col("prev").alias("part"), F.col("lcp").alias("after")).filter("part is not null")
    return pairs.select("part", F.col("lcp").alias("before")).join(after, "part", "left").select("part", "before", F.coalesce("after", F.lit(-1)).alias("after"))


def trie(own: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every
    node over sequences (conv_id, turns)."""
    ensure_checkpoint_dir(own.sparkSession)
    keyed = written(own.select("conv_id", F.array_join("turns.digest", "").alias("key"), F.col("turns.size").alias("sizes")), "trie-keys")
    # the checkpoint keeps the partitions and their order, which numbers them for both passes
    rows = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").checkpoint()
    rows = rows.withColumn("part", F.spark_partition_id().cast("long"))
    nodes = rows.join(F.broadcast(_borders(rows)), "part").mapInArrow(_partition, NODES)
    nodes = written(nodes, "trie-nodes")

    opened = nodes.filter("nid is not null")
    blocks = opened.filter("ids is not null").select("nid", "part", F.posexplode("ids").alias("pos", "ids"))
    hashed = blocks.repartition("nid").sortWithinPartitions("nid", "part", "pos").select("nid", "ids").mapInArrow(_digest_ids, "nid string, ends string")
    merged = opened.groupBy("nid").agg(
        F.min("up").alias("up"), F.min("depth").alias("depth"), F.min("conv").alias("conv"),
        *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "shared")], F.min("before").alias("before"),
    ).join(hashed, "nid", "left")
    merged = written(merged, "trie-open")
    ids = merged.select(F.col("nid").alias("up"), F.col("conv").alias("__parent"))
    spine = merged.join(ids, "up", "left").withColumnRenamed("__parent", "parent")

    closed = nodes.filter("nid is null")
    # a complete node below an open one: the parent's id comes by partition, so that no key is hot
    local = opened.select("nid", "part").join(merged.select("nid", F.col("conv").alias("__parent")), "nid").withColumnRenamed("nid", "up")
    below = closed.filter("up is not null").join(local, ["up", "part"], "left").withColumn("parent", F.col("__parent"))
    columns = ["depth", "conv", "parent", "n", "children", "leaves", "shared", "before", "ends"]
    found = closed.filter("up is null").select(*columns).unionByName(below.select(*columns)).unionByName(spine.select(*columns))
    saved = F.col("shared") - (F.col("n") - 1) * F.col("before")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
