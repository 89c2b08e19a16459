"""Restarts in one scan: equal to separate runs and to plain Lloyd iterations."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textcluster.operators import models as md
from textcluster.operators import restarts as rs


def points(n=240, d=6, seed=2):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 5, (5, d))
    return middle[r.integers(0, 5, n)] + r.normal(0, 1, (n, d))


def frame(spark, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id long, v array<double>").repartition(4).select("doc_id", array_to_vector("v").alias("features")).cache()


def plain(x, centres, max_iter, tol):
    for i in range(max_iter):
        label = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        after = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
        step = np.sqrt(((after - centres) ** 2).sum(1)).max()
        centres = after
        if step <= tol:
            break
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum(), i + 1


def test_runs_equal_separate_plain_runs(spark):
    x = points()
    starts = [x[:5].copy(), x[100:105].copy(), np.vstack([x[50:54], [[99.0] * 6]])]  # the last has a centre without members
    got = rs.iterate(frame(spark, x), starts, 20, 1e-4)
    for start, centres, cost, n in zip(starts, *got, strict=True):
        want = plain(x, start, 20, 1e-4)
        assert np.allclose(centres, want[0]) and np.isclose(cost, want[1]) and n == want[2]
    assert (got[0][2][4] == 99.0).all() and len(set(got[2])) > 1  # runs end on their own
    alone = [rs.iterate(frame(spark, x), [s], 20, 1e-4) for s in starts]
    assert np.allclose(got[1], [a[1][0] for a in alone])


def test_one_scan_serves_all_runs(spark):
    x = points(60)
    sums = rs.run_sums(frame(spark, x), {0: x[:3], 1: x[3:6], 2: x[6:10]})
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == plan.count("InMemoryTableScan") == 1
    members = sums.where(F.col("term") == rs.MEMBERS).groupBy("run").agg(F.sum("s").alias("n")).collect()
    assert {r["run"]: r["n"] for r in members} == {0: 60.0, 1: 60.0, 2: 60.0}


def test_kept_run_is_the_cheapest_and_near_spark_ml(spark):
    x = points()
    vectors = frame(spark, x)
    got = rs.fit(vectors, 5, 3, 30, 1)
    costs = [c for *_, c in got.costs]
    assert [r[:2] for r in got.costs] == [(0, 1), (1, 2), (2, 3)]
    d = ((x[:, None] - got.centres[None]) ** 2).sum(2).min(1).sum()
    assert np.isclose(d, min(costs)) and min(costs) <= 1.1 * min(c for *_, c in md.kmeans_restarts(vectors, 5, 3, 30)[1])
    again = rs.fit(vectors.repartition(3), 5, 3, 30, 1)
    assert np.allclose(again.centres, got.centres)  # whatever the partitions


def test_sparse_empty_repeated_and_few_rows(spark):
    rows = [(0, Vectors.sparse(4, {})), (1, Vectors.sparse(4, {1: 1.0})), (2, Vectors.sparse(4, {1: 1.0}))]
    got = rs.fit(spark.createDataFrame(rows, ["doc_id", "features"]).cache(), 3, 2, 5)
    assert min(c for *_, c in got.costs) == pytest.approx(0.0) and got.centres.shape == (3, 4)


def test_empty_table_and_width(spark):
    vectors = frame(spark, points(8))
    with pytest.raises(ValueError):
        rs.fit(vectors.where("doc_id < 0"))
    with pytest.raises(ValueError):
        rs.iterate(vectors, [np.zeros((20, 1 << 20))])


def test_job_with_one_scan_and_summary(spark):
    from textcluster.operators import features as fe
    from textcluster.plans import jobs

    texts = [f"common{i % 3} word{i % 3} other{i % 2}" for i in range(40)]
    arts = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "seq long, content string, permalink string")
    cfg = jobs.JobConfig(algorithm="kmeans_one_scan", count_terms_by="summary", k=3, params=fe.TfidfParams(max_df=1.0), collate=True)
    res = jobs.cluster_articles(spark, arts, cfg)
    labels = {r["permalink"]: r["cluster_id"] for r in res.membership.collect()}
    assert len(labels) == 40 and len(res.runs) == 3 and res.keywords.count() == 3
    assert len({(int(p) % 3, c) for p, c in labels.items()}) == 3  # one cluster for each kind of text
    assert res.collated.count() == 3
    with pytest.raises(ValueError):
        jobs.JobConfig(count_terms_by="guess").check()
