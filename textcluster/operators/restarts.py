"""All restarts of a k-means in one scan an iteration.

``models.kmeans_restarts`` fits Spark ML's k-means once a restart: ``n_init`` scans an iteration. Here one
scan serves all runs: a task assigns each row to the nearest centre of every run that still moves, adds
the rows up by (run, centre, term), and shuffles those sums. A run whose centres all move at most ``tol``
drops out of later scans; the cost of all runs is one more scan. Seeding is k-means|| over all
documents, the tries of all runs in the same passes (``minibatch.seeds``).

Tasks and driver hold n_init x k x width numbers, refused beyond ``MAX_ENTRIES`` (64 MB): vectors over a
vocabulary fit, wide hashing vectors belong to ``minibatch``. An empty centre stays where it is. Rows with
empty vectors count as points at 0; an empty table raises ``ValueError``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import minibatch as mb
from .models import DEFAULT_INIT, DEFAULT_ITER, DEFAULT_K, flatten_vectors, in_slices, nearest_of, products, vector_sizes

MAX_ENTRIES = 1 << 23
#: ``term`` of the rows that hold a centre's members and its cost instead of a sum
MEMBERS, COST = -1, -2


@dataclass
class Runs:
    """``centres`` of the cheapest run; every ``(run, seed, cost)``; the iterations of each run."""

    centres: np.ndarray
    costs: list[tuple[int, int, float]]
    iterations: list[int]


def _sums_fn(shared, features_col: str, with_sums: bool):
    def run(batches):
        import pyarrow as pa

        runs, centres = shared.value
        squares = [(c * c).sum(axis=1) for c in centres]
        ks, width = [len(c) for c in centres], centres[0].shape[1]
        ends = np.cumsum(ks)
        matrix = np.ascontiguousarray(np.vstack(centres).T)  # all runs' centres are multiplied at once
        sums = [np.zeros(k * width) for k in ks] if with_sums else []
        members, cost = [np.zeros(k, np.int64) for k in ks], [np.zeros(k) for k in ks]
        for b in in_slices(batches, vector_sizes(features_col)):
            n, rows, idx, val = flatten_vectors(b.column(features_col))
            dots = products(n, rows, idx, val, matrix)
            for r, k in enumerate(ks):
                label, d2 = nearest_of(dots[:, ends[r] - k : ends[r]], n, rows, val, squares[r])
                members[r] += np.bincount(label, minlength=k)
                cost[r] += np.bincount(label, d2, k)
                if with_sums:
                    np.add.at(sums[r], label[rows] * width + idx, val)
        for r, run_id in enumerate(runs):
            own = np.arange(ks[r])
            parts = [(own, np.full(ks[r], MEMBERS), members[r].astype(float)), (own, np.full(ks[r], COST), cost[r])]
            if with_sums:
                at = np.flatnonzero(sums[r])
                parts.append((at // width, at % width, sums[r][at]))
            cluster, term, s = (np.concatenate([p[i] for p in parts]) for i in range(3))
            cols = [np.full(len(s), run_id, np.int32), cluster.astype(np.int32), term.astype(np.int64), s]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["run", "cluster_id", "term", "s"])

    return run


def run_sums(vectors: DataFrame, centres: dict[int, np.ndarray], features_col: str = "features", with_sums: bool = True) -> DataFrame:
    """``(run, cluster_id, term, s)`` of one scan: for every run the sum of its members' entries by centre
    and term; term -1 holds the members, -2 the squared distances to the centre."""
    shared = vectors.sparkSession.sparkContext.broadcast((list(centres), list(centres.values())))
    rows = vectors.select(features_col).mapInArrow(_sums_fn(shared, features_col, with_sums), "run int, cluster_id int, term bigint, s double")
    return rows.groupBy("run", "cluster_id", "term").agg(F.sum("s").alias("s"))


def _moved(found, run: int, before: np.ndarray) -> np.ndarray:
    """The centres after a scan; one without members stays."""
    k, width = before.shape
    own = found["run"] == run
    cluster, term, s = found["cluster_id"][own], found["term"][own], found["s"][own]
    members = np.zeros(k)
    members[cluster[term == MEMBERS]] = s[term == MEMBERS]
    sums = np.zeros((k, width))
    sums[cluster[term >= 0], term[term >= 0]] = s[term >= 0]
    return np.where(members[:, None] > 0, sums / np.maximum(members, 1)[:, None], before)


def iterate(vectors: DataFrame, starts: list[np.ndarray], max_iter: int = DEFAULT_ITER, tol: float = 1e-4, features_col: str = "features"):
    """Lloyd iterations of all runs from their starts: (centres by run, costs by run, iterations by run)."""
    if sum(c.size for c in starts) > MAX_ENTRIES:
        raise ValueError(f"n_init x k x width is over {MAX_ENTRIES}; use mini-batch k-means")
    centres, moving = dict(enumerate(starts)), set(range(len(starts)))
    iterations = [0] * len(starts)
    for _ in range(max_iter):
        if not moving:
            break
        table = run_sums(vectors, {r: centres[r] for r in sorted(moving)}, features_col).toArrow()  # <= n_init x k x (width + 2) rows
        found = {c: table[c].to_numpy() for c in table.column_names}
        for r in sorted(moving):
            after = _moved(found, r, centres[r])
            step = np.sqrt(((after - centres[r]) ** 2).sum(axis=1)).max()
            centres[r], iterations[r] = after, iterations[r] + 1
            if step <= tol:
                moving.discard(r)
    costs = run_sums(vectors, centres, features_col, with_sums=False).where(F.col("term") == COST).groupBy("run").agg(F.sum("s").alias("cost"))
    by_run = {row["run"]: row["cost"] for row in costs.collect()}
    return [centres[r] for r in range(len(starts))], [by_run[r] for r in range(len(starts))], iterations


def _dense(points: list, width: int) -> np.ndarray:
    out = np.zeros((len(points), width))
    for row, point in zip(out, points, strict=True):
        at, val = mb._sparse(point)
        row[at] = val
    return out


def fit(
    vectors: DataFrame,
    k: int = DEFAULT_K,
    n_init: int = DEFAULT_INIT,
    max_iter: int = DEFAULT_ITER,
    seed: int = 1,
    tol: float = 1e-4,
    id_col: str = "doc_id",
) -> Runs:
    """M3: ``n_init`` runs in shared scans; the cheapest is kept (ties: the earlier). ``vectors`` should be
    materialised by the caller."""
    first = vectors.select("features").first()
    if first is None:
        raise ValueError("k-means needs at least one document")
    width = first["features"].size if hasattr(first["features"], "size") else len(first["features"])
    if n_init * k * width > MAX_ENTRIES:
        raise ValueError(f"n_init x k x width is over {MAX_ENTRIES}; use mini-batch k-means")
    tries, _ = mb.seeds(vectors, k, n_init, seed, id_col)
    centres, costs, iterations = iterate(vectors, [_dense(t, width) for t in tries], max_iter, tol)
    # equal but for the order of additions: the earlier run
    best = next(r for r in range(n_init) if costs[r] <= min(costs) * (1 + 1e-9))
    return Runs(centres[best], [(r, seed + r, c) for r, c in enumerate(costs)], iterations)
