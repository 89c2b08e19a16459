import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textcluster.llm import topk

from .helpers import rng

SCHEMA = "vec_id long, embedding array<float>, label int, v string, score string, shard string"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "v", "s", "x") for i, v in rows], schema).repartition(3)


def brute(rows, k, is_query):
    fine = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in fine:
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def vectors(r, n, d):
    out = [[float(np.float32(r.gauss(0, 0.2))) for _ in range(d)] for _ in range(n)]
    return out + [list(out[0]) for _ in range(n // 4)]  # many equal vectors: ties at the last rank


@pytest.mark.parametrize("shard,block", [(4096, 4096), (40, 7)])
def test_matches_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LEAF", 8)
    rows = list(enumerate(vectors(rng(1), 240, 6)))
    rows += [(None, [0.5] * 6), (1000, None), (1001, []), (1002, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (1003, [float("nan")] * 6), (1004, [float("inf")] * 6)]
    rows += [(20, rows[20][1]), (1020, [1.0, 2.0]), (1040, [1.0, 3.0]), (1060, [0.0] * 6)]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, 20)
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got.collect()) == brute(rows, 20, lambda i: i % 20 == 0)


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**29 + i, float(i % 2), 1.0]) for i in range(9)]
    got = topk.top_k(table(spark, rows, SCHEMA.replace("float", "double")), F.col("vec_id") < 3, 4, scale=1)
    want = [(q, r + 1, i, s) for q in range(3) for r, (s, i) in enumerate(sorted(((sum(int(x) * int(y) for x, y in zip(rows[q][1], v, strict=True)), i) for i, v in rows if i != q), key=lambda x: (-x[0], x[1]))[:4])]
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got.collect()) == want


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_bounds_hold_for_every_node():
    r = np.random.default_rng(2)
    x = r.integers(-30, 30, (300, 8))
    tree = topk.BallTree(x, np.arange(300), 16)
    q = r.integers(-30, 30, (20, 8))
    for node, (a, b) in enumerate(zip(tree.low, tree.high, strict=True)):
        bound = q @ tree.centres[node] + np.linalg.norm(q, axis=1) * tree.radii[node]
        assert (q @ tree.vectors[a:b].T <= bound[:, None] + 1e-6).all()
    assert sorted(tree.ids.tolist()) == list(range(300))
