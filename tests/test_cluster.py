import numpy as np
import pytest

from textcluster.operators import cluster as cl
from textcluster.operators import features as fe
from textcluster.operators import models as md
from textcluster.operators import vectors as vz


@pytest.fixture()
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for label, centre in enumerate([(0.0, 0.0), (5.0, 5.0), (0.0, 5.0)]):
        for i in range(20):
            rows.append((label * 100 + i, (rng.normal(size=2) * 0.3 + centre).tolist(), label))
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_assign_and_lloyd_never_raises_inertia(blobs):
    cents = cl.centroids_from_labels(blobs, "label")
    moved = cents.selectExpr("cluster_id", "dim", "value + 1.0 as value")
    before = cl.inertia(cl.assign(blobs, moved)).first()["inertia"]
    new, cost = cl.lloyd_step(blobs, moved)
    after = cl.inertia(cl.assign(blobs, new)).first()["inertia"]
    assert cost.first()["inertia"] == pytest.approx(before)
    assert after <= before + 1e-9
    labels = {r["vec_id"]: r["cluster_id"] for r in cl.assign(blobs, cents).collect()}
    assert all(labels[v] == v // 100 for v in labels)


@pytest.fixture()
def text_vectors(spark):
    words = [["alpha", "beta", "gamma"], ["delta", "epsilon", "zeta"], ["theta", "kappa", "lambda"]]
    rows = []
    for g, ws in enumerate(words):
        for i in range(15):
            rows.append((g * 100 + i, " ".join(ws[j % 3] for j in range(i % 5 + 3)), str(10000000 + g * 100 + i)))
    docs = spark.createDataFrame(rows, "doc_id long, content string, permalink string")
    vec = vz.fit_tfidf(docs, fe.TfidfParams(min_df=0.0, max_df=1.0))
    return vec, vec.transform(docs).cache()


def test_kmeans_best_of_n_and_membership(text_vectors):
    _, vectors = text_vectors
    model, runs = md.kmeans_restarts(vectors, k=3, n_init=3, max_iter=10)
    assert min(r[2] for r in runs) == pytest.approx(model.summary.trainingCost)
    mem = md.assign_model(model, vectors).collect()
    assert len(mem) == 45 and {r["cluster_id"] for r in mem} <= {0, 1, 2}
    assert len({r["doc_id"] for r in mem}) == 45


def test_numpy_nearest_matches_brute_force():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(4, 6))
    dense = rng.normal(size=(5, 6)) * (rng.random((5, 6)) > 0.5)
    rows, idx = np.nonzero(dense)
    lab, d2 = md.nearest_centres(5, rows, idx, dense[rows, idx], centers, (centers**2).sum(1))
    brute = ((dense[:, None, :] - centers[None]) ** 2).sum(-1)
    assert (lab == brute.argmin(1)).all() and np.allclose(d2, brute.min(1))
