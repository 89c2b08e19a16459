"""Mini-batch k-means with its centres in a table (M4, T4).

A centre is the mean of all members folded into it so far (learning rate 1 / count), so the table holds
their *sums*: ``(cluster_id, term_idx, s)`` rows of the entries that are not zero, plus one row per
centre with its number of members (term_idx -1) and one with the squared distances met so far (-2).
Up to ``MAX_ENTRIES`` rows the driver holds the table (at most 134 MB of sums and about 100 MB of means, whatever
the vectors' width) and a step is one pass whose partial sums the driver adds up; beyond that the driver
holds k counts and k lengths, and a step writes the table anew from a union with its batch's sums and
one aggregation by (centre, entry).

Tasks need the centres to assign a batch. They get them in feature blocks: ranges of term_idx with at
most ``MAX_ENTRIES`` stored entries, each broadcast on its own. The usual table is one block and a step
is one pass; where there are more, each block gives partial products per document, which are added up
by document before the nearest centre is chosen.

Seeding is k-means|| on the ``init_size`` documents with the smallest hashes, all ``n_init`` tries in the
same passes: in a few rounds about k candidates each are drawn with probability in proportion to the squared
distance from those before (an exponential race, smallest -ln(u) / d^2, within k hash classes; each task
gives its first of a class), and k-means++ over the candidates, weighted by the documents nearest to them, gives the seeds. The try with
the lowest cost on that sample is kept.

Vectors that are read many times (the batches, the seeding sample) are packed: a row holds a stretch of
documents as one Arrow batch, which Spark moves as bytes and no task converts entry by entry.

After each step the inertia per document enters an exponentially weighted average; a fit ends when
that has not fallen by the share ``tol`` for ``max_no_improvement`` steps. Centres with less than ``reassignment_ratio`` of
the largest centre's members are starving: every few steps they restart at documents of the batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

SIZE, COST = -1, -2
#: stored entries of a block of centres: what the driver (at 28 bytes each) and a task (at 12) hold at a time
MAX_ENTRIES = 1 << 23
RANGE = 1 << 12  # features per unit of which blocks are made
#: largest features x k matrix that a task makes of a block
DENSE = 1 << 22
#: entries that a task adds up at a time, and largest features x k array that it adds them up in
STRETCH = 1 << 21
#: widest vectors with a place for every feature
WIDE = 1 << 24
PACKED = "packed"
ROW_GROUP = 4 << 20
TABLE = "cluster_id int, term_idx bigint, s double"


@dataclass
class Centres:
    """The table of sums with what the driver knows of every centre."""

    spark: SparkSession
    k: int
    counts: np.ndarray
    costs: np.ndarray
    squares: np.ndarray
    blocks: list  # (first, end) ranges of term_idx
    written: DataFrame | None = None
    sums: tuple | None = None  # (term_idx * k + cluster_id in ascending order, s) and the means, where one block holds them
    held: "Block | None" = None

    @property
    def table(self) -> DataFrame:
        """``(cluster_id, term_idx, s)``."""
        if self.sums is None:
            return self.written
        (key, s), own = self.sums, np.flatnonzero((self.counts != 0) | (self.costs != 0))
        cid, tid = np.concatenate([key % self.k, own, own]), np.concatenate([key // self.k, np.repeat([SIZE, COST], len(own))])
        return self.spark.createDataFrame(_arrow(cid.astype(np.int32), tid, np.concatenate([s, self.counts[own], self.costs[own]])), TABLE)

    def weights(self) -> DataFrame:
        """``(cluster_id, term_idx, weight)`` of the entries that are not zero."""
        sizes = self.table.where(f"term_idx = {SIZE}").select("cluster_id", F.col("s").alias("n"))
        entries = self.table.where("term_idx >= 0 and s <> 0")
        return entries.join(sizes, "cluster_id").select("cluster_id", "term_idx", (F.col("s") / F.col("n")).alias("weight"))

    def dense(self, width: int) -> np.ndarray:
        """k x width on the driver, for narrow vectors (a vocabulary) and tests."""
        out = np.zeros((self.k, width))
        if self.held is not None:
            out[self.held.cluster, np.repeat(self.held.features, np.diff(self.held.at))] = self.held.weight
            return out
        rows = self.weights().toArrow()
        out[rows.column("cluster_id").to_numpy(), rows.column("term_idx").to_numpy()] = rows.column("weight").to_numpy()
        return out


@dataclass
class Block:
    """Means of all centres at some features: entries ``at[i] : at[i + 1]`` are those of ``features[i]``."""

    features: np.ndarray
    at: np.ndarray
    cluster: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, cluster: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> "Block":
        order = np.argsort(feature, kind="stable")
        return cls.ordered(cluster[order], feature[order], weight[order])

    @classmethod
    def ordered(cls, cluster: np.ndarray, feature: np.ndarray, weight: np.ndarray) -> "Block":
        """From entries in ascending order of their features."""
        first = np.flatnonzero(np.append(True, feature[1:] != feature[:-1])) if len(feature) else np.zeros(0, np.int64)
        kind = np.uint16 if not len(cluster) or cluster.max() < 1 << 16 else np.int32
        return cls(feature[first], np.append(first, len(feature)), cluster.astype(kind), weight)

    def arrays(self) -> tuple:
        """What a broadcast carries: plain arrays, for executors without this package."""
        return self.features, self.at, self.cluster, self.weight

    def products(self, n: int, rows, idx, val, k: int) -> np.ndarray:
        """n x k inner products of sparse rows with the centres, over this block's features."""
        if not len(self.features):
            return np.zeros((n, k))
        place, hit = self._places(idx)
        place, rows, val = place[hit], rows[hit], val[hit]
        size = self.at[place + 1] - self.at[place]
        dense = self._dense(k)[place]
        own = dense >= 0
        out = self._dense_products(n, rows[own], dense[own], val[own])
        place, rows, val, size = place[~own], rows[~own], val[~own], size[~own]
        stop = np.cumsum(size)
        flat = np.repeat(self.at[place] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        key = np.repeat(rows, size) * k + self.cluster[flat]
        return out + np.bincount(key, np.repeat(val, size) * self.weight[flat], n * k).reshape(n, k)

    def _places(self, idx) -> tuple[np.ndarray, np.ndarray]:
        """(places among the features, whether there)."""
        width = int(self.features[-1]) + 1
        if width > WIDE:
            place = np.minimum(np.searchsorted(self.features, idx), len(self.features) - 1)
            return place, self.features[place] == idx
        if getattr(self, "table", None) is None:
            self.table = np.full(width + 1, -1, np.int32)
            self.table[self.features] = np.arange(len(self.features))
        place = self.table[np.minimum(idx, width)]
        return place, place >= 0

    def _dense(self, k: int) -> np.ndarray:
        """Of each feature its row in a features x k matrix of at most ``DENSE``, or -1: all features where they
        fit, else those that most centres have."""
        if getattr(self, "matrix", None) is None:
            size = np.diff(self.at)
            with_most = np.cumsum(np.bincount(size, minlength=k + 1)[::-1])[::-1]  # features with at least so many centres
            least = int(np.argmax(with_most * k <= DENSE)) if (with_most * k <= DENSE).any() else k + 1
            kept = np.flatnonzero(size >= least)
            self.row = np.full(len(size), -1, np.int32)
            self.row[kept] = np.arange(len(kept))
            self.matrix = np.zeros((len(kept), k))
            of = np.repeat(self.row, size)
            self.matrix[of[of >= 0], self.cluster[of >= 0]] = self.weight[of >= 0]
        return self.row

    def _dense_products(self, n: int, rows, place, val) -> np.ndarray:
        """The same where a features x k matrix is small."""
        from .models import products

        return products(n, rows, place, val, self.matrix) if len(self.matrix) else np.zeros((n, self.matrix.shape[1]))


def _arrow(cid, tid, s):
    import pyarrow as pa

    return pa.table({"cluster_id": pa.array(cid, pa.int32()), "term_idx": pa.array(tid, pa.int64()), "s": pa.array(s, pa.float64())})


def _columns_of(rows) -> tuple:
    return tuple(rows.column(c).to_numpy() for c in ("cluster_id", "term_idx", "s"))


def holding(spark: SparkSession, k: int, cid: np.ndarray, tid: np.ndarray, s: np.ndarray) -> Centres:
    """Centres of which the driver holds all entries."""
    counts, costs = (np.bincount(cid[tid == x], s[tid == x], k) for x in (SIZE, COST))
    entry = (tid >= 0) & (s != 0)
    key = tid[entry].astype(np.int64) * k + cid[entry]
    order = np.argsort(key, kind="stable")
    return _with_means(spark, k, counts, costs, key[order], s[entry][order])


def _with_means(spark: SparkSession, k: int, counts: np.ndarray, costs: np.ndarray, key: np.ndarray, s: np.ndarray) -> Centres:
    """The same from sums in ascending order of their keys (term_idx * k + cluster_id)."""
    cluster = key % k
    mean = s / np.maximum(counts, 1e-300)[cluster]
    squares = np.bincount(cluster, mean * mean, k)
    return Centres(spark, k, counts, costs, squares, [(0, None)], sums=(key, s), held=Block.ordered(cluster, key // k, mean))


def _added(centres: Centres, counts: np.ndarray, costs: np.ndarray, key: np.ndarray, s: np.ndarray) -> Centres:
    """Held centres with more members: sums by key, each key once and in ascending order."""
    keys, sums = centres.sums[0], centres.sums[1].copy()
    at = np.searchsorted(keys, key)
    there = at < len(keys)
    there[there] = keys[at[there]] == key[there]
    sums[at[there]] += s[there]
    keys, sums = np.insert(keys, at[~there], key[~there]), np.insert(sums, at[~there], s[~there])
    return _with_means(centres.spark, centres.k, centres.counts + counts, centres.costs + costs, keys, sums)


def _by_key(key: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, in ascending order."""
    order = np.argsort(key, kind="stable")
    key, s = key[order], s[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(s, first) if len(key) else s


def load(table: DataFrame, k: int) -> Centres:
    """The centres of a written table of sums."""
    if table.count() <= MAX_ENTRIES:
        return holding(table.sparkSession, k, *_columns_of(table.toArrow()))
    own = table.groupBy("cluster_id").agg(
        *[F.sum(F.when(F.col("term_idx") == x, F.col("s"))).alias(n) for x, n in ((SIZE, "n"), (COST, "cost"))],
        F.sum(F.when(F.col("term_idx") >= 0, F.col("s") * F.col("s"))).alias("sq"),
    )
    counts, costs, squares = np.zeros(k), np.zeros(k), np.zeros(k)
    for c, n, cost, sq in own.collect():  # k rows
        counts[c], costs[c], squares[c] = n or 0, cost or 0, (sq or 0) / max(n or 0, 1e-300) ** 2
    per = table.where("term_idx >= 0").groupBy(F.floor(F.col("term_idx") / RANGE).cast("bigint").alias("r")).count().orderBy("r").collect()
    blocks, size = [], MAX_ENTRIES + 1
    for r, n in per:  # width / RANGE rows
        if size + n > MAX_ENTRIES:
            blocks.append([r * RANGE, r * RANGE + RANGE])
            size = 0
        blocks[-1][1], size = r * RANGE + RANGE, size + n
    return Centres(table.sparkSession, k, counts, costs, squares, [tuple(b) for b in blocks], written=table)


def _block(centres: Centres, first: int, end: int) -> Block:
    rows = centres.table.where((F.col("term_idx") >= first) & (F.col("term_idx") < end) & (F.col("s") != 0)).toArrow()
    cid = rows.column("cluster_id").to_numpy()
    return Block.of(cid, rows.column("term_idx").to_numpy(), rows.column("s").to_numpy() / np.maximum(centres.counts[cid], 1e-300))


def _nearest(products: np.ndarray, x_sq: np.ndarray, squares: np.ndarray):
    d2 = np.maximum(x_sq[:, None] - 2.0 * products + squares[None, :], 0.0)
    label = np.argmin(d2, axis=1)
    return label, d2[np.arange(len(d2)), label]


def _columns(vectors: DataFrame, names) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*names).schema.fields)


def _stretches(batches):
    """Arrow batches of vectors, packed or not, in slices."""
    import pyarrow as pa

    from .models import in_slices, vector_sizes

    for b in batches:
        own = [b]
        if b.schema.names == [PACKED]:
            own = (x for blob in b.column(PACKED) for x in pa.ipc.open_stream(blob.as_buffer()))
        yield from in_slices(own, vector_sizes())


def pack(rows: DataFrame, group: str | None = None, n_groups: int = 1, n_files: int = 1) -> DataFrame:
    """``(packed)``: the rows of ``rows`` (with a column ``features``) by stretches, each one Arrow batch as bytes. With
    ``group`` (an integer column, which is left out), ``(group, file, packed)`` with stretches of one of ``n_groups``
    groups, dealt to ``n_files`` files."""
    import pyarrow as pa

    def run(batches):
        from pyspark import TaskContext

        from .models import SLICE, in_slices, vector_sizes

        n = TaskContext.get().partitionId()
        for b in in_slices(batches, vector_sizes(), min(SLICE * n_groups, STRETCH)):
            groups = b.column(group).to_numpy(zero_copy_only=False) if group else np.zeros(b.num_rows, np.int32)
            b = b.drop_columns([group]) if group else b
            for g in np.unique(groups):
                own = b.take(pa.array(np.flatnonzero(groups == g))) if group else b
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own)
                n += 1
                found = [pa.array([g], pa.int32()), pa.array([n % n_files], pa.int32())] if group else []
                yield pa.RecordBatch.from_arrays([*found, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[*([group, "file"] if group else []), PACKED])

    return rows.mapInArrow(run, (f"{group} int, file int, " if group else "") + f"{PACKED} binary")


def unpack(packed: DataFrame, schema) -> DataFrame:
    """The rows again."""
    def run(batches):
        yield from _stretches(batches)

    return packed.select(PACKED).mapInArrow(run, schema)


def _one_pass(shared, emit):
    """A mapInArrow function that labels every batch with the one block of ``shared`` centres."""
    def run(batches):
        from .models import flatten_vectors

        block, squares = Block(*shared.value[0]), shared.value[1]
        for b in _stretches(batches):
            n, rows, idx, val = flatten_vectors(b.column("features"))
            label, d2 = _nearest(block.products(n, rows, idx, val, len(squares)), np.bincount(rows, val * val, n), squares)
            yield emit(b, rows, idx, val, label, d2)

    return run


def _shared(centres: Centres):
    return centres.spark.sparkContext.broadcast((centres.held.arrays(), centres.squares))


def _by_blocks(vectors: DataFrame, centres: Centres, id_col: str) -> DataFrame:
    """``(id, cluster_id, dist2)`` from partial products of every block, added up by document."""
    import pyarrow as pa

    spark, k = vectors.sparkSession, centres.k
    parts = None
    for i, (first, end) in enumerate(centres.blocks):
        shared = spark.sparkContext.broadcast(_block(centres, first, end).arrays())

        def run(batches, shared=shared, own=i == 0):
            from .models import flatten_vectors

            block = Block(*shared.value)
            for b in _stretches(batches):
                n, rows, idx, val = flatten_vectors(b.column("features"))
                x_sq = np.bincount(rows, val * val, n) if own else np.zeros(n)
                products = block.products(n, rows, idx, val, k)
                some = np.flatnonzero(products.any(1) | own)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(products[some].ravel()), k).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(some)), pa.array(x_sq[some]), lists], [id_col, "x_sq", "p"])

        part = vectors.select(id_col, "features").mapInArrow(run, f"{_columns(vectors, [id_col])}, x_sq double, p array<double>")
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy(id_col).agg(F.sum("x_sq").alias("x_sq"), *[F.sum(F.get("p", F.lit(c))).alias(f"p{c}") for c in range(k)])
    ordered = F.array_min(F.array(*[F.struct((F.lit(float(centres.squares[c])) - 2 * F.col(f"p{c}")).alias("d"), F.lit(c).alias("c")) for c in range(k)]))
    return sums.select(id_col, ordered.alias("best"), "x_sq").select(
        id_col, F.col("best.c").cast("int").alias("cluster_id"), F.greatest(F.col("best.d") + F.col("x_sq"), F.lit(0.0)).alias("dist2")
    )


def assign(vectors: DataFrame, centres: Centres, keep=("doc_id", "permalink"), id_col: str = "doc_id") -> DataFrame:
    """``keep + (cluster_id, dist2)``; ties go to the smaller id. ``id_col`` is unique."""
    import pyarrow as pa

    keep = [c for c in keep if c in vectors.columns]
    if centres.held is None:
        own = vectors.select(*dict.fromkeys([id_col, *keep]))
        return own.join(_by_blocks(vectors, centres, id_col), id_col).select(*keep, "cluster_id", "dist2")

    def emit(b, rows, idx, val, label, d2):
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(label.astype(np.int32)), pa.array(d2)], [*keep, "cluster_id", "dist2"])

    schema = ", ".join(x for x in (_columns(vectors, keep), "cluster_id int, dist2 double") if x)
    return vectors.select(*keep, "features").mapInArrow(_one_pass(_shared(centres), emit), schema)


def _entries(label, d2, rows, idx, val, k: int):
    """Table rows of the sums of labelled sparse rows, with sizes and costs."""
    import pyarrow as pa

    width = int(idx.max()) + 1 if len(idx) else 1
    key, inverse = np.unique(label[rows].astype(np.int64) * width + idx, return_inverse=True)
    own = np.unique(label)
    cid = np.concatenate([key // width, own, own])
    tid = np.concatenate([key % width, np.full(len(own), SIZE), np.full(len(own), COST)])
    s = np.concatenate([np.bincount(inverse, val, len(key)), np.bincount(label, minlength=k)[own], np.bincount(label, d2, k)[own]])
    return pa.RecordBatch.from_arrays([pa.array(cid.astype(np.int32)), pa.array(tid.astype(np.int64)), pa.array(s)], ["cluster_id", "term_idx", "s"])


def batch_sums(batch: DataFrame, centres: Centres, id_col: str = "doc_id") -> DataFrame:
    """TABLE rows, partial sums of the tasks: what a batch adds to its nearest centres."""
    k = centres.k
    if centres.held is not None:
        def emit(b, rows, idx, val, label, d2):
            return _entries(label, d2, rows, idx, val, k)

        return batch.select("features").mapInArrow(_one_pass(_shared(centres), emit), TABLE)

    def add(batches):
        from .models import flatten_vectors

        for b in batches:
            n, rows, idx, val = flatten_vectors(b.column("features"))
            if n:
                yield _entries(b.column("cluster_id").to_numpy(), b.column("dist2").to_numpy(), rows, idx, val, k)

    labelled = batch.select(id_col, "features").join(_by_blocks(batch, centres, id_col), id_col)
    return labelled.select("features", "cluster_id", "dist2").mapInArrow(add, TABLE)


def _write(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(TABLE).parquet(path)


def _sums_by_key(label, idx, val, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(term_idx * k + cluster_id in ascending order, sums) of labelled entries."""
    width = int(idx.max()) + 1 if len(idx) else 0
    if 0 < width <= WIDE:
        met = np.zeros(width, bool)
        met[idx] = True
        features = np.flatnonzero(met)
        if len(features) * k <= 4 * STRETCH:
            place = np.zeros(width, np.int32)
            place[features] = np.arange(len(features))
            sums = np.bincount(place[idx].astype(np.int64) * k + label, val, len(features) * k)
            at = np.flatnonzero(sums)
            return features[at // k] * k + at % k, sums[at]
    return _by_key(idx.astype(np.int64) * k + label, val)


def _held_sums(batch: DataFrame, shared, k: int) -> DataFrame:
    """``(n, key, s, counts, costs)``, partial sums of the tasks as arrays of bytes with ``n`` keys: what a batch
    adds to its nearest centres, where one block holds them."""
    def run(batches):
        import pyarrow as pa

        parts, size, counts, costs = [], 0, np.zeros(k), np.zeros(k)

        def add(b, rows, idx, val, label, d2):
            return label, d2, label[rows].astype(np.int32), idx.astype(np.int64), val

        def added():
            key, s = _sums_by_key(*[np.concatenate(x) for x in zip(*parts)], k)
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (key.astype(np.int64), s, counts, costs)]
            return pa.RecordBatch.from_arrays([pa.array([len(key)], pa.int64()), *blobs], ["n", "key", "s", "counts", "costs"])

        for label, d2, *entries in _one_pass(shared, add)(batches):
            counts, costs = counts + np.bincount(label, minlength=k), costs + np.bincount(label, d2, k)
            parts.append(entries)
            size += len(entries[0])
            if size >= STRETCH:
                yield added()
                parts, size, counts, costs = [], 0, np.zeros(k), np.zeros(k)
        if parts:
            yield added()

    return batch.mapInArrow(run, "n bigint, key binary, s binary, counts binary, costs binary")


def _fold_held(batch: DataFrame, centres: Centres) -> Centres | None:
    """The batch's sums added on the driver, or None where they or the table they give are too large for it."""
    from pyspark import StorageLevel

    k, shared = centres.k, _shared(centres)
    part = _held_sums(batch, shared, k).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if (part.agg({"n": "sum"}).first()[0] or 0) > MAX_ENTRIES:
            return None
        rows = part.toArrow()
    finally:
        part.unpersist()
        shared.destroy()
    of = lambda c, kind: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in rows.column(c)]])
    key, s = _by_key(of("key", np.int64), of("s", np.float64))
    if len(key) + len(centres.sums[0]) > MAX_ENTRIES:
        return None
    return _added(centres, *[of(c, np.float64).reshape(-1, k).sum(0) for c in ("counts", "costs")], key, s)


def fold(batch: DataFrame, centres: Centres, path: str, id_col: str = "doc_id", keep: bool = False, packed: DataFrame | None = None) -> Centres:
    """One step: the batch's sums added. A table that the driver cannot hold is written to ``path``; with
    ``keep`` any table is. ``packed`` is the batch as ``pack`` gives it, where there is one."""
    if centres.sums is not None:
        after = _fold_held(batch.select("features") if packed is None else packed.select(PACKED), centres)
        if after is not None:
            if keep:
                _write(after.table.coalesce(1), path)
            return after
    both = centres.table.unionByName(batch_sums(batch, centres, id_col))
    return load(_write(both.groupBy("cluster_id", "term_idx").agg(F.sum("s").alias("s")), path), centres.k)


def restart(batch: DataFrame, centres: Centres, starving: np.ndarray, path: str, seed: int, id_col: str = "doc_id") -> Centres:
    """The table with the starving centres at documents of the batch, drawn by hash. They get the
    smallest number of members among the other centres, so that they do not starve at once again."""
    drawn = batch.select(id_col, "features").orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(len(starving)).collect()
    starving = starving[: len(drawn)]
    size = float(np.delete(centres.counts, starving).min())
    if not len(drawn) or size <= 0:
        return centres
    fresh = _point_rows([(int(c), row["features"]) for c, row in zip(starving, drawn)], size)
    if centres.sums is not None:
        (key, s), k, counts = centres.sums, centres.k, centres.counts.copy()
        kept = ~np.isin(key % k, starving)
        counts[starving] = size
        cid, tid, added = fresh
        entry = tid >= 0
        own = _by_key(np.concatenate([key[kept], tid[entry] * k + cid[entry]]), np.concatenate([s[kept], added[entry]]))
        return _with_means(centres.spark, k, counts, centres.costs, *own)
    kept = centres.table.where(~F.col("cluster_id").isin([int(c) for c in starving]) | (F.col("term_idx") == COST))
    return load(_write(kept.unionByName(batch.sparkSession.createDataFrame(_arrow(*fresh), TABLE)), path), centres.k)


def _point_rows(points: list, size: float) -> tuple:
    """TABLE columns of centres that stand at given vectors with ``size`` members (at most k rows' entries)."""
    own = [(c, *_sparse(x)) for c, x in points]
    cid = np.concatenate([*[np.full(len(i), c) for c, i, _ in own], [c for c, *_ in own]]).astype(np.int32)
    tid = np.concatenate([*[i for _, i, _ in own], np.full(len(own), SIZE)]).astype(np.int64)
    return cid, tid, np.concatenate([*[v * size for *_, v in own], np.full(len(own), size)])


def _sparse(x) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a vector or of the struct that it is stored as."""
    values, indices = np.asarray(x.values, float), getattr(x, "indices", None)
    return (np.flatnonzero(values), values[values != 0]) if indices is None else (np.asarray(indices, np.int64), values)


def _uniform(id_col: str, *salt: int) -> Column:
    """A number in (0, 1) that depends on the id and the salt alone."""
    return (F.pmod(F.xxhash64(F.col(id_col), *[F.lit(s) for s in salt]), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def _distances(sample: DataFrame, tries: list[list], emit, schema: str) -> DataFrame:
    """What ``emit`` makes of a task's ``(batch, d, near)``: squared distances to the nearest point of each try (1
    where a try has none) and those points' numbers."""
    blocks, n_tries = [], len(tries)
    for own in tries if tries[0] else ():
        parts = [_sparse(x) for x in own]
        cid = np.concatenate([np.full(len(i), c) for c, (i, _) in enumerate(parts)])
        block = Block.of(cid, np.concatenate([i for i, _ in parts]).astype(np.int64), np.concatenate([v for _, v in parts]))
        blocks.append((block.arrays(), np.array([float((v * v).sum()) for _, v in parts])))
    shared = sample.sparkSession.sparkContext.broadcast(blocks)

    def met(batches):
        from .models import flatten_vectors

        own = [(Block(*x), sq) for x, sq in shared.value]
        for b in _stretches(batches):
            n, rows, idx, val = flatten_vectors(b.column("features"))
            x_sq = np.bincount(rows, val * val, n)
            found = [_nearest(block.products(n, rows, idx, val, len(sq)), x_sq, sq) for block, sq in own]
            # rounding may leave a point a hair from itself
            d = [np.where(d <= 1e-12 * (x_sq + 1e-300), 0.0, d) for _, d in found] or [np.ones(n)] * n_tries
            yield b, d, [x for x, _ in found] or [np.zeros(n, np.int64)] * n_tries

    return sample.mapInArrow(lambda batches: emit(met(batches)), schema)


def _winners(round_: int, n_tries: int, id_col: str):
    """``(t, class, r, id, features)``: of a task, the first of each try and class in the exponential race. Equal
    races go to the smaller id."""
    def run(met):
        import pyarrow as pa

        first: dict = {}
        for b, d, _ in met:
            klass = b.column("klass").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)[:, round_]
            draws = b.column("draws").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1, n_tries)[:, round_]
            for t in range(n_tries):
                runs = np.flatnonzero(d[t] > 0)  # documents at a point do not run
                race = draws[runs, t] / d[t][runs]
                order = np.lexsort((race, klass[runs]))
                own, r = klass[runs][order], race[order]
                for at in np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else ():
                    upto = at + int(np.searchsorted(own[at:], own[at], "right"))
                    tied = runs[order[at : at + int(np.searchsorted(r[at:upto], r[at], "right"))]]
                    ids = [b.column(id_col)[int(i)].as_py() for i in tied]
                    best = min(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] if ids[i] is not None else 0))
                    place = (float(r[at]), ids[best] is not None, ids[best])
                    if (t, int(own[at])) not in first or place < first[t, int(own[at])][0]:
                        # a copy, so that the batch can go
                        first[t, int(own[at])] = place, b.select([id_col, "features"]).take(pa.array([int(tied[best])]))
        for (t, c), ((r, *_), row) in sorted(first.items(), key=lambda x: x[0]):
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([c], pa.int32()), pa.array([r]), *row.columns], ["t", "class", "r", id_col, "features"])

    return run


def _met_by_point(n_tries: int):
    """``(t, point, n)``: of a task, the documents nearest to each point of each try."""
    def run(met):
        import pyarrow as pa

        counts = [np.zeros(0, np.int64)] * n_tries
        for _, _, near in met:
            for t, x in enumerate(near):
                own = np.bincount(x, minlength=len(counts[t]))
                own[: len(counts[t])] += counts[t]
                counts[t] = own
        for t, own in enumerate(counts):
            point = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(point), t, np.int32)), pa.array(point.astype(np.int64)), pa.array(own[point].astype(np.int64))], ["t", "point", "n"])

    return run


def _costs(met):
    import pyarrow as pa

    for _, d, _ in met:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(d), dtype=np.int32)), pa.array([float(x.sum()) for x in d])], ["t", "cost"])


def _choose(points: list, weight: np.ndarray, k: int, rng) -> list:
    """k-means++ over weighted points; where fewer are distinct, the first is repeated."""
    parts = [_sparse(x) for x in points]
    chosen, least = [], np.full(len(points), np.inf)
    odds = weight.astype(float)
    while len(chosen) < k and odds.sum() > 0:
        c = int(rng.choice(len(points), p=odds / odds.sum()))
        chosen.append(points[c])
        own = dict(zip(parts[c][0].tolist(), parts[c][1].tolist()))
        square = sum(v * v for v in own.values())
        for j, (i, v) in enumerate(parts):
            dot = sum(x * own.get(f, 0.0) for f, x in zip(i.tolist(), v.tolist()))
            d = float((v * v).sum()) + square - 2 * dot
            least[j] = min(least[j], d if d > 1e-12 * square else 0.0)
        least[c] = 0.0
        odds = weight * least
    return chosen + chosen[:1] * (k - len(chosen))


def seeds(
    sample: DataFrame, k: int, n_init: int, seed: int, id_col: str = "doc_id", rounds: int = 3, hold: bool = False
) -> tuple[list[list], list[float]]:
    """k-means|| seeds of ``n_init`` tries over a sample: (the tries' k vectors, their costs). The driver holds
    n_init x (rounds x k + 1) documents' vectors. With ``hold`` the sample is packed and persisted; else it
    should be by the caller."""
    from pyspark import StorageLevel

    draws = [-F.log(_uniform(id_col, seed, t, r)) for r in range(rounds + 1) for t in range(n_init)]
    classes = [F.pmod(F.xxhash64(F.col(id_col), F.lit(seed), F.lit(r)), F.lit(k if r else 1)).cast("int") for r in range(rounds + 1)]
    drawn = sample.select(id_col, "features", F.array(*draws).alias("draws"), F.array(*classes).alias("klass"))
    held = None
    if hold:
        drawn = held = pack(drawn).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _seeds(drawn, k, n_init, seed, id_col, rounds, _columns(sample, [id_col]))
    finally:
        if held is not None:
            held.unpersist()


def _seeds(drawn: DataFrame, k: int, n_init: int, seed: int, id_col: str, rounds: int, id_column: str) -> tuple[list[list], list[float]]:
    plain = "features struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
    tries: list[list] = [[] for _ in range(n_init)]
    for round_ in range(rounds + 1):
        first = _distances(drawn, tries, _winners(round_, n_init, id_col), f"t int, class int, r double, {id_column}, {plain}")
        won = first.groupBy("class", "t").agg(F.min_by("features", F.struct("r", F.col(id_col).alias("i"))).alias("features"))
        for row in won.orderBy("class", "t").collect():  # k rows a try
            tries[row["t"]].append(row["features"])
    counts = [np.zeros(len(x)) for x in tries]
    for t, point, n in _distances(drawn, tries, _met_by_point(n_init), "t int, point bigint, n bigint").groupBy("t", "point").agg(F.sum("n")).collect():
        counts[t][point] = n
    chosen = [_choose(x, c, k, np.random.default_rng(seed + t)) for t, (x, c) in enumerate(zip(tries, counts))]
    costs = dict(_distances(drawn, chosen, _costs, "t int, cost double").groupBy("t").agg(F.sum("cost")).collect())
    return chosen, [float(costs[t]) for t in range(n_init)]


def smallest_hashes(rows: DataFrame, n: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """The ``n`` rows with the smallest hashes of (seed, id), where they are: no row is moved or sorted. The
    last hash kept is found from the ids alone, first by counts of 2^16 ranges of hashes, then by
    hash within one range. Rows that share that hash (an id that repeats) come along."""
    value = F.xxhash64(F.lit(seed), id_col)
    ranges = F.shiftright(value, 48)
    before = 0
    for at, found in sorted(rows.groupBy(ranges.alias("r")).count().collect()):  # at most 2^16 rows
        if before + found > n:
            break
        before += found
    else:
        return rows
    last = None
    for h, found in sorted(rows.where(ranges == at).select(value.alias("h")).groupBy("h").count().collect()):  # 2^-16 of the ids
        if before >= n:
            break
        last, before = h, before + found
    return rows.where((ranges < at) if last is None else (value <= last))


def seed_centres(vectors: DataFrame, k: int, n_init: int, seed: int, init_size: int, path: str, id_col: str = "doc_id") -> tuple[Centres, list]:
    """Centres without members at the best of ``n_init`` k-means|| seedings: (centres, (run, seed, cost))."""
    sample = smallest_hashes(vectors.select(id_col, "features"), init_size, seed, id_col)
    tries, costs = seeds(sample, k, n_init, seed, id_col, hold=True)
    best = int(np.argmin(costs))
    # a weight that the first members outweigh: the mean of a centre is then that of its members
    rows = _point_rows(list(enumerate(tries[best])), 1e-9)
    if len(rows[0]) <= MAX_ENTRIES:
        return holding(vectors.sparkSession, k, *rows), [(r, seed + r, c) for r, c in enumerate(costs)]
    return load(_write(vectors.sparkSession.createDataFrame(_arrow(*rows), TABLE), path), k), [(r, seed + r, c) for r, c in enumerate(costs)]


@dataclass
class Stop:
    """The early stop: an exponentially weighted average of the inertia per document."""

    alpha: float
    patience: int | None
    tol: float = 0.0
    average: float | None = None
    least: float = np.inf
    since: int = 0

    def after(self, inertia: float) -> bool:
        """Takes a step's inertia per document; whether to end."""
        self.average = inertia if self.average is None else self.average * (1 - self.alpha) + inertia * self.alpha
        if self.average < self.least * (1 - self.tol):
            self.least, self.since = self.average, 0
        else:
            self.since += 1
        return self.patience is not None and self.since >= self.patience


def starving(counts: np.ndarray, ratio: float, step: int, batch_n: int) -> np.ndarray:
    """Centres to restart after this step: those far below the largest, every few steps and more often
    while some centre has few members; at most half the batch's documents are used, the emptiest first."""
    if ratio <= 0 or (step + 1) % (10 + int(counts.min())):
        return np.zeros(0, np.int64)
    low = np.flatnonzero(counts < ratio * counts.max())
    return low[np.argsort(counts[low], kind="stable")][: batch_n // 2]


@dataclass
class Fit:
    centres: Centres
    init_costs: list
    steps: int = 0
    folded: int = 0  # members folded in
    restarted: int = 0
    averages: list = field(default_factory=list)


def fit(
    vectors: DataFrame, k: int, batch_size: int, max_iter: int, n_init: int, seed: int, id_col: str = "doc_id",
    max_no_improvement: int | None = 10, reassignment_ratio: float = 0.01, tol: float = 1e-3, rows_per_file: int = 2500,
) -> Fit:
    """M4: at most ``max_iter`` epochs, each visiting every document once; see the module's text.

    Documents are dealt once into ceil(N / batch_size) batches by hashing (id, seed), and their vectors
    written packed with one folder per batch, so that a step reads its batch alone."""
    spark = vectors.sparkSession
    n_docs = vectors.count()
    if n_docs == 0:
        raise ValueError("no documents to cluster")
    n_batches = max(1, -(-n_docs // batch_size))
    root, path = scratch_path(spark, "centres"), scratch_path(spark, "minibatches")
    dealt = vectors.select(id_col, "features", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(n_batches)).cast("int").alias("mb"))
    # a batch's stretches meet in a few tasks before the write: few files per folder
    # and rows of few documents in them, so that the tasks of a step share its batch evenly
    packed = pack(dealt, "mb", n_batches, max(1, -(-batch_size // rows_per_file))).repartition("mb", "file").drop("file")
    packed.write.partitionBy("mb").option("parquet.block.size", ROW_GROUP).option("parquet.block.size.row.check.min", 1).parquet(path)
    staged, schema = spark.read.parquet(path), vectors.select(id_col, "features").schema

    centres, init_costs = seed_centres(vectors, k, n_init, seed, 3 * batch_size, f"{root}/seed", id_col)
    out = Fit(centres, init_costs)
    stop = Stop(min(1.0, 2.0 * batch_size / (n_docs + 1)), max_no_improvement, tol)
    for step in range(max_iter * n_batches):
        packed = staged.where(F.col("mb") == step % n_batches)
        batch = unpack(packed, schema)
        before, had = centres.costs.sum(), centres.counts.sum()
        centres = fold(batch, centres, f"{root}/{step:06d}", id_col, packed=packed)
        n = int(round(centres.counts.sum() - had))
        out.steps, out.folded = step + 1, out.folded + n
        if n == 0:
            continue
        ended = stop.after((centres.costs.sum() - before) / n)
        out.averages.append(stop.average)
        if ended:
            break
        low = starving(centres.counts, reassignment_ratio, step, n)
        if len(low):
            centres = restart(batch, centres, low, f"{root}/{step:06d}-restart", seed + step, id_col)
            out.restarted += len(low)
    out.centres = centres
    return out
