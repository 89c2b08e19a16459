"""LDA topics (M7, M8)."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from textcluster.operators import topics as tp


def _counts(spark, n=60, v=24, k=3, seed=0):
    """Documents of k groups of terms, of 1 to 200 words each, and one without a term."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        own = np.arange(v) % k == i % k
        words = rng.choice(v, size=rng.integers(1, 200), p=np.where(own, 9.0, 1.0) / np.where(own, 9.0, 1.0).sum())
        ids, tf = np.unique(words, return_counts=True)
        rows.append((i, Vectors.sparse(v, ids.tolist(), tf.astype(float).tolist())))
    rows.append((n, Vectors.sparse(v, [], [])))
    return spark.createDataFrame(rows, ["doc_id", "features"])


def _plain_mixture(idx, counts, beta, alpha, gamma, tolerance=1e-9):
    """One document, step by step, as Spark ML infers it."""
    while True:
        w = np.exp(tp.log_weights(gamma[None, :])[0])
        new = w * ((counts / (beta[idx] @ w)) @ beta[idx]) + alpha
        if np.abs(new - gamma).mean() <= tolerance:
            return new
        gamma = new


def test_digamma_and_trigamma():
    x = np.array([0.01, 0.5, 1.0, 3.7, 25.0, 1e6])
    euler = 0.5772156649015329
    assert tp.digamma(np.array([1.0, 2.0])) == pytest.approx([-euler, 1 - euler], abs=1e-10)
    assert tp.trigamma(np.array([1.0]))[0] == pytest.approx(np.pi**2 / 6, abs=1e-9)
    assert tp.digamma(x + 1) - tp.digamma(x) == pytest.approx(1 / x, rel=1e-6)
    assert tp.trigamma(x) - tp.trigamma(x + 1) == pytest.approx(1 / x**2, rel=1e-3, abs=1e-14)


def test_every_document_once_a_pass(spark):
    """A pass adds every occurrence of a term once: Spark ML drew documents with replacement instead."""
    counts = _counts(spark)
    words = sum(r["features"].toArray() for r in counts.collect())
    before, after = (tp.fit_lda(counts, n_topics=3, max_iter=n).topics for n in (0, 1))
    learning = (tp.OFFSET + 1) ** -tp.DECAY
    given = (after - (1 - learning) * before) / learning - 1 / 3
    assert given.sum(axis=1) == pytest.approx(words, rel=1e-9)


def test_topics_equal_a_plain_fit(spark):
    """Three passes by blocks and extrapolation against documents one by one, to a fine tolerance."""
    counts, k, passes = _counts(spark), 3, 3
    docs = [r["features"] for r in counts.collect() if len(r["features"].indices)]
    draw = np.random.default_rng(5)
    topics, alpha = draw.gamma(tp.GAMMA_SHAPE, 1 / tp.GAMMA_SHAPE, (24, k)), np.full(k, 1 / k)
    for i in range(1, passes + 1):
        beta = np.exp(tp.digamma(topics) - tp.digamma(topics.sum(axis=0)))
        start, given, logs = draw.gamma(tp.GAMMA_SHAPE, 1 / tp.GAMMA_SHAPE, k), np.zeros((24, k)), np.zeros(k)
        for d in docs:
            gamma = _plain_mixture(d.indices, d.values, beta, alpha, start)
            own = np.exp(tp.log_weights(gamma[None, :])[0]) * beta[d.indices]
            given[d.indices] += own / own.sum(axis=1, keepdims=True) * d.values[:, None]
            logs += tp.log_weights(gamma[None, :])[0]
        learning = (tp.OFFSET + i) ** -tp.DECAY
        topics = (1 - learning) * topics + learning * (given + 1 / k)
        alpha = tp._learned_prior(alpha, logs, len(docs), learning)
    model = tp.fit_lda(counts.repartition(4), n_topics=k, max_iter=passes, seed=5)
    assert model.topics == pytest.approx(topics, rel=5e-3)
    assert model.alpha == pytest.approx(alpha, rel=1e-3)


def test_inference_takes_fewer_steps(monkeypatch):
    """Flat topics, where plain steps are slowest: at most two thirds of the evaluations, the same mixtures."""
    rng = np.random.default_rng(1)
    beta = np.exp(rng.normal(0, 0.1, (40, 5)))
    counts, alpha, start = rng.integers(1, 9, (20, 40)).astype(float), np.full(5, 0.2), np.ones(5)
    seen, plain = [], []
    log_weights = tp.log_weights
    monkeypatch.setattr(tp, "log_weights", lambda g: (seen.append(len(g)), log_weights(g))[1])
    got = tp._infer_block(np.repeat(beta[None], 20, 0), counts, alpha, start)[0]
    fast = sum(seen)
    seen.clear()
    monkeypatch.setattr(tp, "EXTRAPOLATED", 0)
    tp._infer_block(np.repeat(beta[None], 20, 0), counts, alpha, start)
    assert 3 * fast <= 2 * sum(seen)
    monkeypatch.setattr(tp, "log_weights", log_weights)
    for c in counts:
        plain.append(_plain_mixture(np.arange(40), c, beta, alpha, start))
    assert np.abs(got - np.array(plain)).mean() / counts.sum(axis=1).mean() < 0.01


def test_document_topics(spark):
    counts = _counts(spark)
    weights = np.where(np.arange(24)[:, None] % 3 == np.arange(3), 90.0, 10.0)
    model = tp.TopicModel(weights, np.full(3, 1 / 3))
    rows = {r["doc_id"]: np.array(r["mixture"]) for r in tp.document_topics(model, counts).collect()}
    assert len(rows) == 61 and not rows[60].any()
    assert all(rows[i].sum() == pytest.approx(1) for i in range(60))
    assert sum(rows[i].argmax() == i % 3 for i in range(60)) >= 55


def test_rates_and_wrong_settings(spark):
    counts = _counts(spark)
    drawn = tp.fit_lda(counts, n_topics=3, max_iter=2, rate=0.5)
    assert drawn.topics.shape == (24, 3) and tp.topic_sums(drawn) == pytest.approx([1, 1, 1])
    for wrong in ({"n_topics": 1}, {"rate": 0.0}, {"rate": 1.5}, {"max_iter": -1}):
        with pytest.raises(ValueError):
            tp.fit_lda(counts, **wrong)


def test_keywords(spark):
    model = tp.TopicModel(np.array([[1.0, 5.0], [3.0, 5.0], [2.0, 0.5]]), np.ones(2))
    vocab = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "term_idx bigint, term string")
    got = {r["topic"]: (r["keywords"], r["top_weight_sum"]) for r in tp.topic_terms(model, vocab, 2).collect()}
    assert got == {0: ("a, c", pytest.approx(5 / 6)), 1: ("a, b", pytest.approx(10 / 10.5))}


def test_terms_are_counted_once(spark, tmp_dir, monkeypatch):
    """The query's vectorizer and its relational vocabulary share one count of all terms."""
    from textcluster.operators import tokens as tk
    from textcluster.operators import vectors as vz
    from textcluster.plans import queries as q

    rows = [(i, " ".join(f"w{j}" for j in range(40) if (i * j) % 3), "en", "s", 10) for i in range(1, 31)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_dir}/documents.parquet")
    seen, count = [], tk.term_stats_from_docs
    for m in (tk, vz):
        monkeypatch.setattr(m, "term_stats_from_docs", lambda *a, **k: (seen.append(1), count(*a, **k))[1])
    got = q.q_lda_topics(spark, tmp_dir).collect()
    assert len(seen) == 1 and len(got) == 10
    assert all(r["n_terms"] == r["n_known"] > 0 and r["total"] == 1.0 for r in got)
