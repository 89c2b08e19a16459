import random

import pytest
from pyspark.sql import functions as F

from textcluster.operators import counts as ct
from textcluster.session import scratch_path
from textcluster.sinks import staged as sg


@pytest.mark.parametrize("kind", ["sparse", "dense", "text", "lump"])
def test_ranks_and_parts_over_any_key(spark, kind):
    r = random.Random(4)
    keys = {
        "sparse": [i * 10**7 + r.randint(0, 10**6) for i in range(700)], "dense": list(range(-50, 650)),
        "text": [f"k{r.randint(0, 10**9):010d}" for _ in range(700)], "lump": [10**12 + i for i in range(650)] + [-(10**15) * i for i in range(1, 51)],
    }[kind]
    r.shuffle(keys)
    df = spark.createDataFrame([(k, str(k)) for k in keys], f"seq {'string' if kind == 'text' else 'long'}, content string").repartition(5)
    want = {k: i for i, k in enumerate(sorted(keys))}
    assert {x["seq"]: x["idx"] for x in ct.dense_index(df, "seq").collect()} == want
    parts = {x["seq"]: x["part"] for x in ct.located_parts(df, "seq", 90).collect()}
    assert parts == {k: max(1, -(-i // 90)) for k, i in want.items()}
    assert parts == {x["seq"]: x["part"] for x in ct.with_parts(df, "seq", 90).collect()}


def test_equal_keys_have_consecutive_ranks(spark):
    df = spark.createDataFrame([(k,) for k in [5] * 40 + [1] * 3 + [9]], "seq long").repartition(4)
    found = sorted(map(tuple, ct.ranked_keys(df, "seq").collect()))
    assert [i for _, i in found] == list(range(44)) and [k for k, _ in found] == [1] * 3 + [5] * 40 + [9]


def test_sparse_keys_give_no_task_more_than_a_stretch(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select((F.col("id") * 10**9).alias("seq"))
        sizes = [n for _, n in ct.ranked_keys(df, "seq").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 10 and max(sizes) < 1000
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_staging_exchanges_no_content(spark):
    df = spark.createDataFrame([(i * 10**7, "text " * 50) for i in range(300)], "seq long, content string")
    plan = ct.located_parts(df, "seq", 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0]
    path = scratch_path(spark, "t_located")
    sg.write_parts(df, path, 100)
    counts = {x["part"]: x["n_docs"] for x in ct.part_counts(sg.read_staged(spark, path)).collect()}
    assert counts == {1: 101, 2: 100, 3: 99}


def test_empty_and_small_tables(spark):
    empty = spark.createDataFrame([], "seq long, content string")
    assert ct.dense_index(empty, "seq").count() == 0 and ct.located_parts(empty, "seq", 10).count() == 0
    one = spark.createDataFrame([(7, "x")], "seq long, content string")
    assert [tuple(x) for x in ct.with_parts(one, "seq", 10).collect()] == [(7, "x", 0, 1)]
