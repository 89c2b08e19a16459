import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from textcluster.operators import minibatch as mb
from textcluster.operators import models as md
from textcluster.session import scratch_path


def sparse_rows(n, width, groups, seed=0):
    """Documents of a few entries each, every group in its own range of features."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        g = i % groups
        at = np.sort(rng.choice(width // groups, 8, replace=False)) + g * (width // groups)
        rows.append((i, str(i), Vectors.sparse(width, at.tolist(), rng.random(8).tolist())))
    return rows


@pytest.fixture()
def vectors(spark):
    return spark.createDataFrame(sparse_rows(240, 600, 3), ["doc_id", "permalink", "features"]).repartition(3).cache()


def dense(rows, width):
    return np.array([r["features"].toArray() for r in sorted(rows, key=lambda r: r["doc_id"])])


def test_every_document_is_folded_in_and_labelled_once(spark, vectors):
    res = mb.fit(vectors, k=3, batch_size=50, max_iter=2, n_init=2, seed=1, max_no_improvement=None, reassignment_ratio=0)
    assert res.steps == 10 and res.folded == 480 and round(res.centres.counts.sum()) == 480
    found = mb.assign(vectors, res.centres).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(240))
    x, c = dense(vectors.collect(), 600), res.centres.dense(600)
    d = ((x[:, None] - c[None]) ** 2).sum(-1)
    for r in found:
        assert r["dist2"] == pytest.approx(d[r["doc_id"]].min(), abs=1e-9) and d[r["doc_id"], r["cluster_id"]] <= d[r["doc_id"]].min() + 1e-9
    full = md.kmeans_restarts(vectors, k=3)[1]
    assert sum(r["dist2"] for r in found) <= 1.1 * min(r[2] for r in full)


def test_a_step_is_the_running_mean_of_members(spark, vectors):
    path = scratch_path(spark, "t_fold")
    centres, costs = mb.seed_centres(vectors, 4, 3, 7, 1000, f"{path}/seed")
    assert len(costs) == 3 and costs[int(np.argmin([c for *_, c in costs]))][2] == pytest.approx(mb.assign(vectors, centres).agg({"dist2": "sum"}).first()[0])
    x, c = dense(vectors.collect(), 600), centres.dense(600)
    first = vectors.where("doc_id < 100")
    d = ((x[:100, None] - c[None]) ** 2).sum(-1)
    label = d.argmin(1)
    after = mb.fold(first, centres, f"{path}/1")
    want = np.array([x[:100][label == i].mean(0) if (label == i).any() else c[i] for i in range(4)])
    assert np.allclose(after.dense(600), want, atol=1e-6) and after.counts.round().tolist() == np.bincount(label, minlength=4).tolist()
    assert after.costs.sum() == pytest.approx(d.min(1).sum()) and np.allclose(after.squares, (want**2).sum(1), atol=1e-6)


def test_feature_blocks_give_the_same_centres(spark, vectors, monkeypatch):
    run = lambda: mb.fit(vectors, k=5, batch_size=80, max_iter=2, n_init=2, seed=3)
    one = run()
    monkeypatch.setattr(mb, "MAX_ENTRIES", 150)
    monkeypatch.setattr(mb, "RANGE", 16)
    many = run()
    assert one.centres.held is not None and many.centres.held is None and len(many.centres.blocks) > 3
    assert np.allclose(one.centres.dense(600), many.centres.dense(600), atol=1e-9) and np.allclose(one.averages, many.averages)
    label = lambda fit: sorted(map(tuple, mb.assign(vectors, fit.centres).drop("dist2").collect()))
    assert label(one) == label(many)


def test_wide_features_leave_no_dense_array(spark, monkeypatch):
    rows = [(i, str(i), Vectors.sparse(1 << 20, [i % 7, 1000 + i, (1 << 20) - 1 - i], [30.0, 1.0, 1.0])) for i in range(60)]
    wide = spark.createDataFrame(rows, ["doc_id", "permalink", "features"])
    sizes = []
    real = np.zeros
    monkeypatch.setattr(np, "zeros", lambda shape, *a, **b: sizes.append(int(np.prod(shape))) or real(shape, *a, **b))
    res = mb.fit(wide, k=7, batch_size=20, max_iter=4, n_init=1, seed=2)
    monkeypatch.undo()
    assert max(sizes) < 10000 and res.centres.table.count() < 2000
    by_group = {}
    for r in mb.assign(wide, res.centres).collect():
        by_group.setdefault(r["doc_id"] % 7, set()).add(r["cluster_id"])
    assert all(len(v) == 1 for v in by_group.values()) and len({min(v) for v in by_group.values()}) == 7


def test_the_stop_waits_for_the_average():
    stop = mb.Stop(alpha=0.5, patience=3)
    assert [stop.after(x) for x in (10, 8, 8, 9, 12, 12)] == [False, False, False, False, False, True]
    flat = mb.Stop(alpha=1.0, patience=3)
    assert [flat.after(5.0) for _ in range(4)] == [False, False, False, True]
    falling = mb.Stop(alpha=0.3, patience=1)
    assert not any(falling.after(100.0 - i) for i in range(50))
    assert not any(mb.Stop(1.0, None).after(1.0) for _ in range(50))


def test_a_fit_ends_early_and_starving_centres_restart(spark):
    # a far point takes one centre for itself, the others share a dense group
    rows = [(i, str(i), Vectors.dense([float(i % 10) / 10, float(i % 7) / 10])) for i in range(300)] + [(300, "300", Vectors.dense([90.0, 90.0]))]
    data = spark.createDataFrame(rows, ["doc_id", "permalink", "features"])
    res = mb.fit(data, k=3, batch_size=301, max_iter=100, n_init=1, seed=1, reassignment_ratio=0)
    assert res.steps < 100 and res.restarted == 0
    assert np.array_equal(mb.starving(np.array([500.0, 1.0, 300.0]), 0.01, 10, 100), [1])
    assert len(mb.starving(np.array([500.0, 1.0, 300.0]), 0.01, 9, 100)) == 0 and len(mb.starving(np.array([500.0, 1.0]), 0, 10, 100)) == 0
    path = scratch_path(spark, "t_restart")
    moved = mb.restart(data.where("doc_id < 300"), res.centres, np.array([int(np.argmin(res.centres.counts))]), path, 5)
    again = int(np.argmin(res.centres.counts))
    assert moved.counts[again] == pytest.approx(np.delete(res.centres.counts, again).min())
    points = {tuple(r["features"].toArray()) for r in data.collect()}
    assert any(np.allclose(moved.dense(2)[again], p) for p in points)


def test_fewer_distinct_points_than_centres(spark):
    rows = [(i, str(i), Vectors.sparse(10, [1, 2], [1.0, 1.0]) if i else Vectors.sparse(10, [], [])) for i in range(9)]
    data = spark.createDataFrame(rows, ["doc_id", "permalink", "features"])
    res = mb.fit(data, k=4, batch_size=4, max_iter=3, n_init=2, seed=1)
    assert sum(r["dist2"] for r in mb.assign(data, res.centres).collect()) == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ValueError):
        mb.fit(data.where("doc_id < 0"), 2, 10, 2, 1, 1)
