import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textcluster.llm import labelled, quality, scan, toxicity

from .helpers import awkward, docs, empty, rng, words

BAD = ("zorkfool", "blethnitt", "quamscum")


def corpus(n=700, seed=3):
    r = rng(seed)
    texts, toxic, good = [], [], []
    for _ in range(n):
        own = words(r, r.randint(5, 150))
        t, q = int(r.random() < 0.2), int(r.random() < 0.7)
        if t:
            for _ in range(r.randint(2, 5)):
                own[r.randint(0, len(own)) : 0] = [r.choice(BAD) + r.choice(("", "er", "ing"))]
        if not q:
            own = [w + r.choice(("%%%", "###")) for w in own]
        texts.append(" ".join(own))
        toxic.append(t)
        good.append(q)
    return texts, toxic, good


def tables(spark):
    texts, toxic, good = corpus()
    labels = spark.createDataFrame(list(zip(range(len(texts)), good, toxic, ["z"] * len(texts), strict=True)), "doc_id long, quality int, toxic int, text string")
    return docs(spark, texts), labels, toxic, good


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def accuracy(rows, truth, cut):
    own = [i for i in range(len(truth)) if held(i)]
    return np.mean([(rows[i] >= cut) == bool(truth[i]) for i in own])


def test_toxicity_held_out_accuracy_and_rejection(spark):
    frame, labels, toxic, _ = tables(spark)
    model = toxicity.fit(frame, labels)
    rows = {x["doc_id"]: x["s"] for x in frame.select("doc_id", toxicity.score_column(spark, model, F.col("text"))["score"].alias("s")).collect()}
    assert accuracy(rows, toxic, 0.5) >= 0.97 and all(0 <= s <= 1 for s in rows.values())
    kept = toxicity.reject_toxic(frame, model)
    assert kept.columns == frame.columns and {x["doc_id"] for x in kept.collect()} == {i for i, s in rows.items() if s < 0.5}
    odd = docs(spark, awkward(rng(1)))
    scores = [x[0]["score"] for x in odd.select(toxicity.score_column(spark, model, F.col("text"))).collect()]
    assert len(scores) == 14 and all(0 <= s <= 1 for s in scores)


def test_quality_held_out_accuracy_and_calibration(spark):
    frame, labels, _, good = tables(spark)
    model = quality.fit(frame, labels)
    rows = {x["doc_id"]: x["s"] for x in frame.select("doc_id", quality.score_column(spark, model, F.col("text")).alias("s")).collect()}
    assert accuracy(rows, good, 0.3) >= 0.97 and all(0 <= s <= 1 for s in rows.values())
    assert abs(np.mean(list(rows.values())) - np.mean(good)) < 0.05
    odd = docs(spark, awkward(rng(1)))
    scores = [x[0] for x in odd.select(quality.score_column(spark, model, F.col("text"))).collect()]
    assert len(scores) == 14 and all(0 <= s <= 1 for s in scores)


def test_held_out_labels_and_other_columns_never_matter(spark):
    frame, labels, *_ = tables(spark)
    changed = labels.withColumn("toxic", F.when(labelled.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (labelled.sample(f, x, "toxic", 50) for f, x in ((frame, labels), (frame.withColumns({"lang": F.lit("fr"), "source": F.lit("q")}), changed)))
    assert a[0].equals(b[0]) and a[1] == b[1] and a[0].num_rows == 100


def test_repeated_ids_do_not_grow_the_sample(spark):
    frame, labels, *_ = tables(spark)
    assert labelled.sample(frame.unionByName(frame), labels.unionByName(labels), "toxic", 50)[0].num_rows == 100


@pytest.mark.parametrize("keep", ["doc_id < 0", "toxic = 0 and quality = 1"])
def test_without_labels_of_both_kinds(spark, keep):
    frame, labels, *_ = tables(spark)
    few = labels.filter(keep)
    tox = frame.select(toxicity.score_column(spark, toxicity.fit(frame, few), F.col("text"))["score"]).distinct().collect()
    assert [x[0] for x in tox] == [0.0]
    qual = frame.select(quality.score_column(spark, quality.fit(frame, few), F.col("text"))).distinct().collect()
    assert [x[0] for x in qual] == [0.5 if "<" in keep else 1.0]


def test_empty_tables(spark):
    _, labels, *_ = tables(spark)
    none = empty(spark)
    assert none.select(toxicity.score_column(spark, toxicity.fit(none, labels), F.col("text"))).count() == 0
    assert none.select(quality.score_column(spark, quality.fit(none, labels), F.col("text"))).count() == 0


def test_context_vectors_count_every_neighbour(spark):
    texts = [t or "" for t in awkward(rng(5))][:9] + ["a b c a b", "x"]
    got = quality.context_vectors(docs(spark, texts))
    places, signs = quality.index_vectors()
    want = np.zeros_like(got)
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        own = quality.tokens(data, np.array([0, len(data)]))[0].tolist()
        for i, a in enumerate(own):
            for b in own[max(0, i - quality.WINDOW) : i] + own[i + 1 : i + 1 + quality.WINDOW]:
                for p, s in zip(places[b].tolist(), signs[b].tolist(), strict=True):
                    want[a, p] += int(s)
    assert (got == want).all()


def test_convolution_by_gathers_equals_plain_windows():
    r = np.random.default_rng(1)
    model = toxicity.Model(r.normal(size=(toxicity.PAD + 1, toxicity.DIM)), [r.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS],
                           [r.normal(size=toxicity.FILTERS) for _ in toxicity.WIDTHS], r.normal(size=toxicity.FILTERS * 3), 0.3)
    model.table[toxicity.PAD] = 0
    texts = ["", "one", "one two", " ".join(words(rng(2), 40)), "", "x", ""]
    _, data, offsets = next(scan.texts(pa.array(texts)))
    features, _, first = toxicity.word_features(data, offsets)
    got = toxicity.logits(model, model.projected(), features, first)
    for i in range(len(texts)):
        rows = np.concatenate([model.table[features[first[i] : first[i + 1]]].sum(1), np.zeros((3, toxicity.DIM))])
        hidden = []
        for f, b in zip(model.filters, model.biases, strict=True):
            out = np.array([sum(rows[p + j] @ f[j] for j in range(len(f))) for p in range(len(rows) - 2)])
            hidden.append(np.maximum(out.max(0) + b, 0))
        assert np.isclose(got[i], np.concatenate(hidden) @ model.weights + model.bias, atol=1e-3)


def test_scores_do_not_depend_on_neighbouring_texts():
    texts = [t or "" for t in awkward(rng(5))]
    _, data, offsets = next(scan.texts(pa.array(texts)))
    buckets, first = quality.tokens(data, offsets)
    for i, text in enumerate(texts):
        own = np.frombuffer(text.encode(), np.uint8)
        assert quality.tokens(own, np.array([0, len(own)]))[0].tolist() == buckets[first[i] : first[i + 1]].tolist()


def test_threshold_and_temperature():
    z, y = np.array([-3.0, -1, 0, 2, 5, 6]), np.array([0, 0, 0, 0, 1, 1])
    assert labelled.best_threshold(z, y) == 3.5
    assert labelled.temperature(np.array([4.0, -4, 4, -4]), np.array([1, 0, 0, 1])) > 5
