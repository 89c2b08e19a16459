"""The heavy-hitter summary: its error bound, and that the vocabulary equals the one by grouping."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textcluster.operators import features as fe
from textcluster.operators import heavy as hv
from textcluster.operators import tokens as tk
from textcluster.operators import vectors as vz


def corpus(n=600, seed=3):
    r = random.Random(seed)
    common = [f"common{i}" for i in range(30)]
    return [" ".join([w for i, w in enumerate(common) if r.random() < (i + 1) / 40] + [f"rare{r.randrange(5000)}" for _ in range(20)]) for _ in range(n)]


def frame(spark, texts, parts=5):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").repartition(parts, "doc_id")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sets(st.integers(0, 30), max_size=12), max_size=15), min_size=1, max_size=6), st.integers(1, 12))
def test_summary_counts_are_low_by_at_most_the_error(batches, counters):
    rows = [pa.RecordBatch.from_arrays([pa.array([[str(x) for x in s] for s in b], pa.list_(pa.string()))], ["t"]) for b in batches]
    out = [r for b in hv._summary_fn(counters)(iter(rows)) for r in b.to_pylist()]
    true = Counter(str(x) for b in batches for s in b for x in s)
    whole, held = out[0], {r["term"]: r["n"] for r in out[1:]}
    assert (whole["docs"], whole["weight"]) == (sum(map(len, batches)), sum(true.values()))
    assert len(held) <= counters and whole["error"] * (counters + 1) <= whole["weight"]
    assert all(n - whole["error"] <= held.get(t, 0) <= n for t, n in true.items())


def test_cut_leaves_at_most_the_counters():
    r = np.random.default_rng(5)
    for _ in range(200):
        counts, m = r.integers(1, 6, r.integers(1, 40)), int(r.integers(1, 20))
        less = hv.cut(counts, m)
        assert (counts > less).sum() <= m and (less == 0 or (counts >= less).sum() >= m + 1)


@pytest.mark.parametrize("counters", [4, 60, 1 << 16])
def test_vocabulary_equals_the_one_by_grouping(spark, counters):
    docs = frame(spark, corpus() + [None, "", "common1 common1"])
    params = fe.TfidfParams(min_df=0.05, max_df=0.7, max_features=15)
    n = fe.doc_count(docs)
    want = fe.vocabulary_from_stats(tk.term_stats_from_docs(docs), n, params).collect()
    got = fe.vocabulary_from_stats(hv.frequent_term_stats(docs, params, counters=counters), n, params).collect()
    assert sorted(got) == sorted(want) and len(want) == 15


def test_candidates_are_complete_and_few(spark):
    texts = corpus()
    docs = frame(spark, texts)
    kept = {r["term"] for r in hv.candidates(docs, 0.05, counters=4).collect()}
    df = Counter(t for x in texts for t in set(x.split()))
    assert {t for t, n in df.items() if n >= 0.05 * len(texts)} <= kept
    assert len(kept) <= 2 * sum(df.values()) / (0.05 * len(texts)) < len(df)


def test_bounds_that_keep_nearly_every_term_go_to_the_grouping(spark):
    docs = frame(spark, corpus(40))
    assert hv.candidates(docs, 0.0) is None and hv.candidates(docs, 0.01) is None
    params = fe.TfidfParams(min_df=0.0, max_df=1.0)
    assert sorted(hv.frequent_term_stats(docs, params).collect()) == sorted(tk.term_stats_from_docs(docs).collect())


def test_empty_table(spark):
    docs = frame(spark, ["x"]).where("doc_id < 0")
    assert hv.frequent_term_stats(docs).count() == 0


def test_only_candidates_are_shuffled_by_the_count(spark):
    docs = frame(spark, corpus())
    stats = hv.frequent_term_stats(docs, fe.TfidfParams())
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_fit_by_summary_equals_fit_by_grouping(spark):
    docs = frame(spark, corpus())
    a, b = (vz.fit_tfidf(docs, by=x) for x in fe.COUNTED_BY)
    assert a.vocabulary == b.vocabulary and a.vocabulary
    assert list(a.pipeline.stages[1].getScalingVec()) == list(b.pipeline.stages[1].getScalingVec())
    with pytest.raises(ValueError):
        vz.fit_tfidf(docs, by="guess")
