"""Quality scoring: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Tokens are runs of letters, digits or other signs (case kept), hashed to buckets. Every bucket has a
sparse random index vector; a bucket's context vector is the sum of the index vectors of the tokens
around its occurrences, over all documents (each task sums into one fixed-size table, and only those
tables are shuffled). A document is the mean of its tokens' vectors, its length and the share of its
tokens that repeat one of the two before. The network is fitted on a
bounded labelled sample, its logits divided by a temperature found on held-back rows, and the odds
moved from the sample's label shares to those of all usable labels.

Defined results: null and empty texts are the zero vector; repeated rows score alike; without
labelled rows of both labels every score is the share of label 1 (0.5 without any); an empty table
gives no rows; only the text column is read for a score, so other columns never clash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import ship, unpack
from .labelled import sample, sigmoid, temperature

BITS, DIM, NONZERO, WINDOW, HIDDEN = 14, 64, 4, 2, 32
BUCKETS, BLOCK = 1 << BITS, 1 << 10
#: bytes of training text whose token vectors the driver holds at a time
TRAIN_SLICE = 1 << 18
#: class of each byte: 0 space, 1 letter, 2 digit, 3 other
KIND = np.full(256, 3, np.uint8)
KIND[scan.LETTER], KIND[0x30:0x3A], KIND[scan.SPACE] = 1, 2, 0


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each (BUCKETS, NONZERO): the sparse ternary index vector of every bucket."""
    keys = scan.keyed(29, BUCKETS * NONZERO).reshape(BUCKETS, NONZERO)
    return (keys % np.uint64(DIM)).astype(np.int64), np.where(keys >> np.uint64(63), 1.0, -1.0)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first) of the tokens of the texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = KIND[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    keep = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][keep], edges[1:][keep]
    hashes = scan.run_hashes(data, starts, ends, scan.EXACT)
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(starts, offsets)


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, DIM) sums of the index vectors around every occurrence, over all documents."""

    def count(batches):
        places, signs = index_vectors()
        sums = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for _, data, offsets in scan.texts(batch.column(0)):
                buckets, first = tokens(data, offsets)
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for step in range(1, WINDOW + 1):
                    near = np.flatnonzero(doc[step:] == doc[:-step])
                    a, b = buckets[near], buckets[near + step]
                    for x, y in ((a, b), (b, a)):
                        sums += np.bincount((x[:, None] * DIM + places[y]).ravel(), signs[y].ravel(), BUCKETS * DIM)
        table = sums.astype(np.int64).reshape(-1, BLOCK * DIM)
        rows = [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(table) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([c for _, c in rows], pa.binary())], ["block", "sums"])

    def add(frames):
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for block, packed in zip(frame["block"], frame["sums"], strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.int64)
                held[block] = held[block] + part if block in held else part
        yield pd.DataFrame({"block": list(held), "sums": [s.tobytes() for s in held.values()]})

    parts = docs.select(text_col).mapInArrow(count, "block int, sums binary")
    merged = parts.repartition(BUCKETS // BLOCK, "block").mapInPandas(add, "block int, sums binary")
    out = np.zeros((BUCKETS // BLOCK, BLOCK * DIM), np.int64)
    for row in merged.collect():  # BUCKETS x DIM numbers, whatever the input
        out[row[0]] = np.frombuffer(row[1], np.int64)
    return out.reshape(BUCKETS, DIM)


def word_vectors(context: np.ndarray) -> np.ndarray:
    """A bucket's vector: its context's direction plus its own index vector's."""
    places, signs = index_vectors()
    own = np.zeros((BUCKETS, DIM))
    np.add.at(own, (np.arange(BUCKETS)[:, None], places), signs)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return (unit(context.astype(float)) + unit(own)).astype(np.float32)


@dataclass
class Model:
    rows: np.ndarray  # (BUCKETS, HIDDEN): word vectors through the first layer
    extra: np.ndarray  # (2, HIDDEN): length and repeats through the first layer
    offset: np.ndarray
    weights: np.ndarray
    bias: float
    temperature: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def pooled(vectors: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of the tokens' rows per text; zeros for a text without tokens."""
    out = np.zeros((len(first) - 1, vectors.shape[1]))
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(vectors[buckets], first[full], axis=0, dtype=np.float64) / np.diff(first)[full][:, None]
    return out


def shape(buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(log length, share of tokens equal to one of the two before) per text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    again = np.zeros(len(buckets), bool)
    for step in (1, 2):
        again[step:] |= (buckets[step:] == buckets[:-step]) & (doc[step:] == doc[:-step])
    n = np.diff(first)
    return np.stack([np.log1p(n), np.bincount(doc, again, len(n)) / np.maximum(n, 1)], 1)


def train(table: pa.Table, counts: dict[int, int], vectors: np.ndarray, epochs: int = 60, batch: int = 64, seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    y = table["y"].to_numpy().astype(float)
    x = [np.concatenate([pooled(vectors, *found), shape(*found)], 1) for _, d, o in scan.texts(table["text"], TRAIN_SLICE) for found in [tokens(d, o)]]
    held = table["fold"].to_numpy() == 1
    own = np.flatnonzero(~held)
    if len({*y[own].tolist()}) < 2:
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        return Model(np.zeros((BUCKETS, HIDDEN), np.float32), np.zeros((2, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, constant=share)
    x = np.concatenate(x)
    mean, spread = x[own].mean(0), x[own].std(0) + 1e-6
    z = (x - mean) / spread
    params = [rng.normal(0, DIM**-0.5, (DIM + 2, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            h = np.tanh(z[chunk] @ params[0] + params[1])
            error = (sigmoid(h @ params[2] + params[3]) - y[chunk]) / len(chunk)
            back = error[:, None] * params[2] * (1 - h * h)
            grads = [z[chunk].T @ back + 1e-4 * params[0], back.sum(0), h.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):  # Adam
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    first = params[0] / spread[:, None]
    model = Model((vectors @ first[:DIM]).astype(np.float32), first[DIM:], params[1] - mean @ first, params[2], float(params[3][0]))
    rows = held if min((y[held] == 0).sum(), (y[held] == 1).sum()) >= 10 else np.ones(len(y), bool)
    raw = np.tanh(z @ params[0] + params[1]) @ params[2] + params[3]
    model.temperature = temperature(raw[rows], y[rows])
    model.shift = float(np.log(counts[1] / counts[0]) - np.log((y == 1).sum() / (y == 0).sum()))
    return model


def scores(model: Model, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    hidden = np.tanh(pooled(model.rows, buckets, first) + shape(buckets, first) @ model.extra + model.offset)
    return sigmoid((hidden @ model.weights + model.bias) / model.temperature + model.shift)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    table, counts = sample(docs, labels, label)
    return train(table, counts, word_vectors(context_vectors(docs)))


def score_column(spark, model: Model, text: Column) -> Column:
    """The calibrated probability of label 1 of a text."""
    shared = ship(spark, model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        own, out = unpack(shared), []
        for _, data, offsets in scan.texts(column):
            if own.constant is not None:
                out.append(np.full(len(offsets) - 1, own.constant))
                continue
            out.append(scores(own, *tokens(data, offsets)))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return score.asNondeterministic()(text)
