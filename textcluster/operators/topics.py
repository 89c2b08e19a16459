"""LDA topics (M7, M8).

Online variational Bayes (Hoffman, Blei, Bach 2010) on raw term counts over the tfidf vocabulary, with the settings
of Spark ML's ``LDA``: priors 1 / k, document prior learned, learning offset 1024 and decay 0.51. The
topic count is an argument. A pass is one job: tasks get the topics by broadcast, infer the mixture of
each of their documents and send one partial sum a (term, topic); these are added up by an aggregation, and
the driver holds the V x k topics (V at most ``max_features``).

Spark ML's ``LDA`` draws documents with replacement, at a rate of 1.0 too, where a draw leaves out 37 % of
them; here a rate of 1.0 is every document once. A document's inference ends as there, when its topic
weights change by at most ``TOLERANCE`` on average. What differs is the way to that point: documents of like
length are worked on together, and every other step is extrapolated (SQUAREM, Varadhan and Roland 2008),
which takes about half the evaluations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_terms
from .models import flatten_vectors, in_slices, vector_sizes

OFFSET, DECAY = 1024, 0.51
#: shape of the gamma draws that topics and mixtures start from (mean 1)
GAMMA_SHAPE = 100
TOLERANCE = 1e-3
#: entries of a block of documents (documents x terms x topics), 1 MB
BLOCK = 1 << 17
#: longest extrapolation, and the evaluations after which a document goes on by plain steps
LONGEST, EXTRAPOLATED = 64.0, 1000
#: keys of a pass's sums beside term_idx * k + topic
DOCS, MIXTURE = -1, -2


@dataclass
class TopicModel:
    """V x k topic weights (not normalised), and the k weights of the documents' prior."""

    topics: np.ndarray
    alpha: np.ndarray

    @property
    def shares(self) -> np.ndarray:
        """V x k: the term distribution of each topic."""
        return self.topics / self.topics.sum(axis=0, keepdims=True)


def digamma(x):
    """For x > 0: six steps of the recurrence (as one quotient), then the asymptotic series."""
    y, q = x + 6.0, x * (x + 5.0)
    b, c = q + 4.0, q + 6.0
    f = 1.0 / (y * y)
    series = f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f * (1 / 132)))))
    return np.log(y) - 0.5 / y - series - (2.0 * x + 5.0) * (b * c + q * (b + c)) / (q * b * c)


def trigamma(x):
    """For x > 0, likewise."""
    y = x + 6.0
    f = 1.0 / (y * y)
    series = f * (0.5 + (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30)))) / y)
    return sum(1.0 / (x + i) ** 2 for i in range(6)) + 1.0 / y + series


def log_weights(gamma):
    """n x k: expected logarithms of the mixtures with Dirichlet weights ``gamma``."""
    return digamma(gamma) - digamma(gamma.sum(axis=1))[:, None]


def _infer_block(beta, counts, alpha, start):
    """Mixtures of n documents: ``beta`` n x w x k, ``counts`` n x w. Gives the Dirichlet weights, their
    expected mixtures (n x k) and the counts by what the mixture expects of each term (n x w)."""
    n, w, k = beta.shape
    gammas, mixtures, ratios = np.empty((n, k)), np.empty((n, k)), np.empty((n, w))
    live, ended = np.arange(n), np.zeros(n, bool)
    gamma, base, change, n_evaluated = np.tile(start, (n, 1)), None, None, 0
    while True:
        mixture = np.exp(log_weights(gamma))
        ratio = counts / ((beta @ mixture[:, :, None])[:, :, 0] + 1e-100)
        new = mixture * (ratio[:, None, :] @ beta)[:, 0, :] + alpha
        step = new - gamma
        n_evaluated += 1
        ends = ~(np.abs(step).mean(axis=1) > TOLERANCE) & ~ended
        if ends.any():
            done = live[ends]
            gammas[done], mixtures[done], ratios[done] = gamma[ends], mixture[ends], ratio[ends]
            ended |= ends
            if ended.all():
                return gammas, mixtures, ratios
            if ended.mean() >= 0.25:
                on = ~ended
                live, beta, counts, gamma, new, step = live[on], beta[on], counts[on], gamma[on], new[on], step[on]
                base, change = (None, None) if base is None else (base[on], change[on])
                ended = np.zeros(len(live), bool)
        if base is None and n_evaluated < EXTRAPOLATED:
            base, change, gamma = gamma, step, new
        elif base is None:
            gamma = new
        else:
            bend = step - change
            length = np.sqrt((change**2).sum(axis=1) / np.maximum((bend**2).sum(axis=1), 1e-300))
            a = np.clip(length, 1.0, LONGEST)[:, None]
            far = base + 2.0 * a * change + a * a * bend
            # Weights are at least the prior's; a document that leaves that range takes the plain step.
            gamma = np.where((far >= alpha).all(axis=1)[:, None], far, new)
            base = None


def infer(n, rows, idx, counts, beta, alpha, start):
    """Mixtures of sparse documents under ``beta`` (V x k), by blocks of documents of like length: yields
    ``(docs, ids, gammas, mixtures, ratios)``, ids V where a document has fewer terms than its block.
    Documents without a term are left out."""
    v, k = beta.shape
    size = np.bincount(rows, minlength=n)
    at = np.cumsum(size) - size
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    sizes, padded, first = size[order], np.vstack([beta, np.zeros((1, k))]), 0
    while first < len(order):
        least = int(sizes[first])
        end = int(np.searchsorted(sizes, max(least + 8, least * 9 // 8), side="right"))
        docs = order[first : min(end, first + max(1, BLOCK // (int(sizes[end - 1]) * k)))]
        first += len(docs)
        width = np.arange(size[docs[-1]])
        on = width < size[docs][:, None]
        place = np.where(on, at[docs][:, None] + width, 0)
        ids = np.where(on, idx[place], v)
        yield docs, ids, *_infer_block(padded[ids], np.where(on, counts[place], 0.0), alpha, start)


def _pass_fn(shared, features_col: str):
    """Sums of a task's documents: ``(key, s)`` with what each term gives to each topic under
    key term_idx * k + topic, the number of documents, and the logarithms of their mixtures."""
    import pyarrow as pa

    def run(batches):
        beta, alpha, start = shared.value
        v, k = beta.shape
        total, logs, n_docs = np.zeros((v + 1, k)), np.zeros(k), 0
        for b in in_slices(batches, vector_sizes(features_col)):
            for docs, ids, gammas, mixtures, ratios in infer(*flatten_vectors(b.column(features_col)), beta, alpha, start):
                flat = ids.ravel()
                for t in range(k):
                    total[:, t] += np.bincount(flat, (ratios * mixtures[:, t, None]).ravel(), v + 1)
                logs += log_weights(gammas).sum(axis=0)
                n_docs += len(docs)
        if n_docs:
            given = (total[:v] * beta).ravel()
            some = np.flatnonzero(given)
            keys = np.concatenate([some, [DOCS], MIXTURE - np.arange(k)])
            sums = np.concatenate([given[some], [n_docs], logs])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums, pa.float64())], names=["key", "s"])

    return run


def _learned_prior(alpha, logs, n_docs: float, rate: float):
    """One weighted Newton step on the documents' prior (Huang 2005); left as it is where the step leads
    to weights that are not positive."""
    gradient = n_docs * (digamma(alpha.sum()) - digamma(alpha) + logs / n_docs)
    c, q = n_docs * trigamma(alpha.sum()), -n_docs * trigamma(alpha)
    b = (gradient / q).sum() / (1.0 / c + (1.0 / q).sum())
    new = alpha - rate * (gradient - b) / q
    return new if (new > 0).all() else alpha


def fit_lda(
    counts: DataFrame, n_topics: int = 20, max_iter: int = 30, seed: int = 1, features_col: str = "features", rate: float = 1.0
) -> TopicModel:
    """M7: fit topics on count vectors. ``rate`` is the share of the documents an iteration draws; at
    1.0 every iteration is a full pass."""
    if n_topics < 2 or max_iter < 0 or not 0.0 < rate <= 1.0:
        raise ValueError("n_topics must be at least 2, max_iter at least 0, rate above 0 and at most 1")
    sc, docs, k, eta = counts.sparkSession.sparkContext, counts.select(features_col), n_topics, 1.0 / n_topics
    head = docs.where(F.col(features_col).isNotNull()).first()
    if head is None:
        raise ValueError("LDA needs documents")
    draw = np.random.default_rng(seed)
    topics = draw.gamma(GAMMA_SHAPE, 1.0 / GAMMA_SHAPE, (head[0].size, k))
    alpha = np.full(k, 1.0 / k)
    for i in range(1, max_iter + 1):
        beta = np.exp(digamma(topics) - digamma(topics.sum(axis=0)))
        shared = sc.broadcast((beta, alpha, draw.gamma(GAMMA_SHAPE, 1.0 / GAMMA_SHAPE, k)))
        drawn = docs if rate == 1.0 else docs.sample(True, rate, seed + i)
        sums = drawn.mapInArrow(_pass_fn(shared, features_col), "key bigint, s double").groupBy("key").agg(F.sum("s").alias("s")).toArrow()
        shared.destroy()
        key, s = sums.column("key").to_numpy(), sums.column("s").to_numpy()
        if not len(key):
            continue  # no document with a term
        given, logs = np.zeros(topics.size), np.zeros(k)
        given[key[key >= 0]] = s[key >= 0]
        logs[MIXTURE - key[key <= MIXTURE]] = s[key <= MIXTURE]
        learning = (OFFSET + i) ** -DECAY
        topics = (1.0 - learning) * topics + learning * (given.reshape(topics.shape) / rate + eta)
        alpha = _learned_prior(alpha, logs, float(s[key == DOCS][0]), learning)
    return TopicModel(topics, alpha)


def document_topics(model: TopicModel, counts: DataFrame, keep=("doc_id",), features_col: str = "features") -> DataFrame:
    """``keep + (mixture)``: the share of each topic in every document; zeros where it has no term."""
    import pyarrow as pa

    beta = np.exp(digamma(model.topics) - digamma(model.topics.sum(axis=0)))
    shared = counts.sparkSession.sparkContext.broadcast((beta, model.alpha))
    cols = list(keep)

    def run(batches):
        beta, alpha = shared.value
        for b in in_slices(batches, vector_sizes(features_col)):
            shares = np.zeros((b.num_rows, len(alpha)))
            for docs, _, gammas, _, _ in infer(*flatten_vectors(b.column(features_col)), beta, alpha, np.ones(len(alpha))):
                shares[docs] = gammas / gammas.sum(axis=1, keepdims=True)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(shares.ravel()), len(alpha)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], lists], names=[*cols, "mixture"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in counts.select(*cols).schema.fields)
    return counts.select(*cols, features_col).mapInArrow(run, schema + "mixture array<double>")


def topic_terms(model: TopicModel, vocab: DataFrame, n: int = 20) -> DataFrame:
    """M8: ``(topic, keywords, top_weight_sum)``: the n heaviest terms of each topic, weight
    descending then term ascending."""
    heavy = np.argsort(-model.shares, axis=0, kind="stable")[:n]
    rows = [(t, int(j), float(model.shares[j, t])) for t in range(heavy.shape[1]) for j in heavy[:, t]]
    long = vocab.sparkSession.createDataFrame(rows, "topic int, term_idx bigint, weight double")
    named = long.join(F.broadcast(vocab.select("term_idx", "term")), "term_idx")
    return named.groupBy("topic").agg(
        join_terms(
            F.transform(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))), lambda x: x["term"])
        ).alias("keywords"),
        F.sum("weight").alias("top_weight_sum"),
    )


def topic_sums(model: TopicModel) -> list[float]:
    """Sum of each topic's normalised term distribution (1.0 each); the V x k matrix is bounded by
    the vocabulary size and topic count."""
    return model.shares.sum(axis=0).tolist()
