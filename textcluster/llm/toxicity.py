"""Toxicity scoring with a convolutional text classifier written in numpy.

A word's embedding is the sum of hashed rows for the whole word and its first 4, 5 and 6 bytes, so
inflected and compound forms share evidence. Filters of widths 1, 2 and 3 slide over the words, the
maximum over the whole text is pooled per filter, and a linear layer gives a logit. Fitting uses a
bounded labelled sample (labelled.SAMPLE_PER_LABEL rows of each label); scoring covers whole texts.
Cuts are calibrated by language, guessed from the text's own function words (never from a column):
the score is 0.5 exactly at the language's cut.

Defined results: null and empty texts score as a text without words; ties and repeated rows score
alike; without labelled rows of both labels every score is 0; an empty table gives no rows; only the
text column is read for a score, so other columns never clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import ship, unpack
from .labelled import best_threshold, sample, sigmoid, temperature

BITS, DIM, FILTERS, WIDTHS = 16, 16, 8, (1, 2, 3)
PREFIXES = (4, 5, 6)
PAD = 1 << BITS
#: frequent function words that tell the languages of the corpus apart (fixed values)
FUNCTION_WORDS = {
    "en": "the and of to is that it with for was are this",
    "de": "der die das und zu den von mit ist nicht auf ein",
    "fr": "le les et des une qui dans pour est au du sur",
    "es": "el los las y con por del para su al como más",
}
LANGUAGES = ("", *FUNCTION_WORDS)


@dataclass
class Model:
    table: np.ndarray  # (buckets + 1, DIM), the last row is the padding
    filters: list[np.ndarray]  # per width (width, DIM, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    fitted: bool = False

    def projected(self) -> list[list[np.ndarray]]:
        """Per width and place the filter outputs of every bucket: a window's output is a sum of gathers."""
        return [[(self.table @ f[j]).astype(np.float32) for j in range(len(f))] for f in self.filters]


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features (n, 4), word hashes, first): buckets of every word of the texts."""
    starts, ends, first = scan.runs(data, offsets, scan.LETTER[data])
    prefix = scan.prefix_sums(data, scan.FOLDED)
    whole = scan.span_hashes(prefix, starts, ends)
    found = [whole] + [scan.mixed(scan.span_hashes(prefix, starts, np.minimum(ends, starts + n)) ^ np.uint64(n)) for n in PREFIXES]
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int32) for h in found], 1), whole, first


def _padded(features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with padding words after each text: windows that start at a word of the text or at the
    first padding word stay within the text and its padding."""
    gap, count = max(WIDTHS), np.diff(first)
    out = np.full((len(features) + gap * len(count), features.shape[1]), PAD, np.int32)
    out[np.arange(len(features)) + gap * np.repeat(np.arange(len(count)), count)] = features
    return out, first[:-1] + gap * np.arange(len(count))


def _language_keys() -> tuple[np.ndarray, np.ndarray]:
    words = [(i + 1, w.encode()) for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws.split()]
    data = np.frombuffer(b"".join(w for _, w in words), np.uint8)
    ends = np.cumsum([len(w) for _, w in words])
    hashes = scan.run_hashes(data, ends - np.array([len(w) for _, w in words]), ends)
    order = np.argsort(hashes)
    return hashes[order], np.array([i for i, _ in words])[order]


def languages(hashes: np.ndarray, first: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of the language with the most function words per text (0: none found)."""
    known, lang = keys
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    kind = np.where(known[at] == hashes, lang[at], 0)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(LANGUAGES)
    counts = np.bincount(doc * n + kind, minlength=(len(first) - 1) * n).reshape(-1, n)
    counts[:, 0] = 0
    return np.where(counts.max(1) > 0, counts.argmax(1), 0)


def logits(model: Model, tables: list[list[np.ndarray]], features: np.ndarray, first: np.ndarray) -> np.ndarray:
    padded, begin = _padded(features, first)
    if not len(begin):
        return np.zeros(0)
    bounds = np.stack([begin, begin + np.diff(first) + 1], 1).ravel()
    pooled = []
    for places, bias in zip(tables, model.biases, strict=True):
        n = len(padded)
        out = np.zeros((n, FILTERS), np.float32)
        for j, place in enumerate(places):
            part = place[padded[:, 0]]
            for c in range(1, padded.shape[1]):
                part += place[padded[:, c]]
            out[: n - j] += part[j:]
        top = np.maximum.reduceat(out, bounds, axis=0)[::2]
        pooled.append(np.maximum(top + bias, 0))
    return np.concatenate(pooled, 1) @ model.weights + model.bias


def train(table: pa.Table, epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 5) -> Model:
    """Fit the network on (text, y, fold); fold 1 is held back for the cuts."""
    rng = np.random.default_rng(seed)
    y, held = table["y"].to_numpy(), table["fold"].to_numpy() == 1
    parts = [(word_features(d, o)) for _, d, o in scan.texts(table["text"], 1 << 20)]
    docs = [p[0][p[2][i] : p[2][i + 1]] for p in parts for i in range(len(p[2]) - 1)]
    keys = _language_keys()
    langs = np.concatenate([languages(p[1], p[2], keys) for p in parts]) if parts else np.zeros(0, int)
    del parts
    own = np.flatnonzero(~held)
    model = Model(
        np.zeros((PAD + 1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS)),
    )
    if len({*y[own].tolist()}) < 2:
        return model
    model.fitted = True
    # start: one dimension of a bucket's row is its document log-odds, shrunk for rare buckets
    seen = np.zeros((2, PAD + 1))
    for i in own:
        seen[y[i], np.unique(docs[i])] += 1
    n0, n1 = (y[own] == 0).sum(), (y[own] == 1).sum()
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    model.table[:] = rng.normal(0, 0.02, model.table.shape)
    model.table[:, 0] = np.where(seen.sum(0) > 0, odds * np.minimum(1, seen.sum(0) / 5), -1.0) / 4
    model.table[PAD] = 0
    for f in model.filters:
        f[:] = rng.normal(0, 0.1, f.shape)
        f[0, 0] += rng.uniform(0.3, 1.0, FILTERS)
    model.weights[:] = 0.3
    model.bias = -1.0
    squares = {"table": np.full(model.table.shape, 1e-2, np.float32), "weights": np.full(model.weights.shape, 1e-2), "bias": 1e-2}
    squares["filters"] = [np.full(f.shape, 1e-2) for f in model.filters]
    squares["biases"] = [np.full(FILTERS, 1e-2) for _ in WIDTHS]
    balance = np.where(y == 1, 0.5 * len(own) / n1, 0.5 * len(own) / n0)
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
            _step(model, squares, [docs[i] for i in chunk], y[chunk], balance[chunk], rate)
    _calibrate(model, docs, langs, y, held)
    return model


def _step(model: Model, squares: dict, docs: list[np.ndarray], y: np.ndarray, balance: np.ndarray, rate: float) -> None:
    """One Adagrad step on a batch: forward, then back through the pooled places only."""
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    padded, begin = _padded(np.concatenate(docs) if docs else np.zeros((0, 4), np.int32), first)
    stop = begin + np.diff(first) + 1
    rows = model.table[padded].sum(1)
    pooled, places = [], []
    for f, bias in zip(model.filters, model.biases, strict=True):
        n = len(rows) - len(f) + 1
        out = sum(rows[j : j + n] @ f[j] for j in range(len(f))) + bias
        place = np.stack([a + out[a:b].argmax(0) for a, b in zip(begin, stop, strict=True)])
        places.append(place)
        pooled.append(np.maximum(out[place, np.arange(FILTERS)], 0))
    hidden = np.concatenate(pooled, 1)
    error = (sigmoid(hidden @ model.weights + model.bias) - y) * balance / len(y)
    back = error[:, None] * model.weights[None, :] * (hidden > 0)

    def move(value, square, grad):
        square += grad * grad
        value -= rate * grad / np.sqrt(square)

    table_grad: dict[str, list] = {"at": [], "grad": []}
    for k, (f, place) in enumerate(zip(model.filters, places, strict=True)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        grad = np.zeros_like(f)
        for j in range(len(f)):
            at = place + j
            grad[j] = np.einsum("df,dfe->ef", g, rows[at])
            table_grad["at"].append(padded[at].reshape(-1, padded.shape[1]))
            table_grad["grad"].append((g[:, :, None] * f[j].T[None]).reshape(-1, DIM))
        move(model.biases[k], squares["biases"][k], g.sum(0))
        move(f, squares["filters"][k], grad)
    at, inverse = np.unique(np.concatenate(table_grad["at"]), return_inverse=True)
    total = np.zeros((len(at), DIM))
    each = np.concatenate(table_grad["grad"])
    inverse = inverse.reshape(-1, padded.shape[1])
    for c in range(inverse.shape[1]):
        np.add.at(total, inverse[:, c], each)
    total[at == PAD] = 0
    square = squares["table"][at] + total * total
    squares["table"][at] = square
    model.table[at] -= rate * total / np.sqrt(square)
    move(model.weights, squares["weights"], hidden.T @ error)
    squares["bias"] += error.sum() ** 2
    model.bias -= rate * error.sum() / np.sqrt(squares["bias"])


def _calibrate(model: Model, docs, langs, y, held) -> None:
    """Cuts per language and one slope, from the held-back rows where they hold enough of both labels."""
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    tables, out = model.projected(), []
    for a in range(0, len(docs), 256):
        b = min(a + 256, len(docs))
        out.append(logits(model, tables, np.concatenate(docs[a:b]), first[a : b + 1] - first[a]))
    z = np.concatenate(out)
    enough = lambda m: min((y[m] == 0).sum(), (y[m] == 1).sum()) >= 10
    pick = lambda m: m & held if enough(m & held) else m
    everyone = np.ones(len(y), bool)
    model.cuts[""] = best_threshold(z[pick(everyone)], y[pick(everyone)])
    for i, name in enumerate(LANGUAGES):
        if i and enough(langs == i):
            model.cuts[name] = best_threshold(z[pick(langs == i)], y[pick(langs == i)])
    shift = z - np.array([model.cuts.get(LANGUAGES[i], model.cuts[""]) for i in langs])
    rows = pick(everyone)
    model.slope = 1.0 / temperature(shift[rows], y[rows])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    model = train(sample(docs, labels, label)[0])
    scan.release()
    return model


def score_column(spark, model: Model, text: Column) -> Column:
    """struct<score, language> of a text."""
    shared = ship(spark, model)
    ready: dict = {}

    @F.arrow_udf("struct<score:double,language:string>")
    def score(column: pa.Array) -> pa.Array:
        if not ready:
            own = unpack(shared)
            ready.update(model=own, tables=own.projected(), keys=_language_keys())
        own = ready["model"]
        scores, names = [], []
        for _, data, offsets in scan.texts(column, 1 << 20):
            features, hashes, first = word_features(data, offsets)
            lang = languages(hashes, first, ready["keys"])
            names += [LANGUAGES[i] for i in lang]
            if not own.fitted:
                scores.append(np.zeros(len(lang)))
                continue
            cuts = np.array([own.cuts.get(x, own.cuts[""]) for x in LANGUAGES])
            scores.append(sigmoid(own.slope * (logits(own, ready["tables"], features, first) - cuts[lang])))
        scan.release()
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(names, pa.string())], ["score", "language"])

    return score.asNondeterministic()(text)


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """``docs`` without those that score at least ``cut``."""
    scored = docs.withColumn("__tox", score_column(docs.sparkSession, model, F.col(text_col)))
    return scored.filter(F.col("__tox.score") < cut).select(*docs.columns)
