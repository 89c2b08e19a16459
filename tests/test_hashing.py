"""Signed hashing against plain Python, document by document."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from textcluster.operators import features as fe
from textcluster.operators import hashing as hs
from textcluster.operators import vectors as vz

TEXTS = ["alpha beta alpha gamma", "beta delta", "", None, "the and of", "alpha beta alpha gamma", "é éa ßß naïve Alpha " + "long " * 50]


def frame(spark, texts=TEXTS, parts=3):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, content string, features string").repartition(parts)


def code(term, width):
    d = hashlib.md5(term.encode()).hexdigest()
    return int(d[:8], 16) % width, -1 if int(d[8:10], 16) % 2 else 1


def plain(tokens, width):
    """{doc: {bucket: weight}} from lists of tokens by document."""
    counts = {}
    for doc, toks in tokens.items():
        own = Counter()
        for t in toks:
            bucket, sign = code(t, width)
            own[bucket] += sign
        counts[doc] = {b: v for b, v in own.items() if v}
    df = Counter(b for own in counts.values() for b in own)
    out = {}
    for doc, own in counts.items():
        w = {b: v * (math.log((1 + len(tokens)) / (1 + df[b])) + 1) for b, v in own.items()}
        out[doc] = {b: x / sum(map(abs, w.values())) for b, x in w.items()}
    return out


@pytest.mark.parametrize("width", [3, 64, 1 << 20])
def test_weights_equal_plain_ones(spark, width):
    from textcluster.operators.tokens import add_tokens

    docs = frame(spark)
    tokens = {r["doc_id"]: r["t"] or [] for r in add_tokens(docs, "content", "t").collect()}
    vec = vz.fit_hashing(docs, num_features=width)
    got = {}
    for r in hs.entries(vec.transform(docs, keep=("doc_id",))).collect():
        got.setdefault(r["doc_id"], {})[r["bucket"]] = r["weight"]
    want = plain(tokens, width)
    assert got.keys() == {d for d, w in want.items() if w}
    for d, w in got.items():
        assert w.keys() == want[d].keys() and all(math.isclose(w[b], want[d][b]) for b in w)


def test_terms_of_one_bucket_cancel():
    width = 1
    buckets, signs = hs.codes(["alpha", "beta", "gamma", "delta"], width)
    assert set(buckets) == {0} and set(signs) <= {-1.0, 1.0}
    _, many = hs.codes([f"t{i}" for i in range(4000)], 1 << 20)
    assert abs(many.sum()) < 300
    assert [len(x) for x in hs.codes([], 8)] == [0, 0]


def test_document_frequencies_add_up(spark):
    docs = frame(spark)
    counts = hs.signed_counts(docs, 64)
    whole = sorted(hs.bucket_df(counts, 64).collect())
    parts = [hs.bucket_df(counts.where(c), 64) for c in ("doc_id % 2 = 0", "doc_id % 2 = 1")]
    assert sorted(hs.add_df(*parts).collect()) == whole and dict(whole)[hs.ALL] == len(TEXTS)


def test_saved_vectorizer_gives_the_same_vectors(spark, tmp_dir):
    docs = frame(spark)
    vec = vz.fit_hashing(docs, fe.TfidfParams(norm="l2"), num_features=256)
    vec.save(tmp_dir)
    again = vz.Vectorizer.load(tmp_dir, fe.TfidfParams(norm="l2"))
    assert (again.kind, again.width) == ("hashing", 256)
    a, b = ({r["doc_id"]: r["features"] for r in v.transform(docs, keep=("doc_id",)).collect()} for v in (vec, again))
    assert a == b and np.isclose(np.linalg.norm(a[0].toArray()), 1.0)


def test_empty_table_and_bad_arguments(spark):
    none = frame(spark).where("doc_id < 0")
    assert vz.fit_hashing(none, num_features=8).transform(none, keep=("doc_id",)).count() == 0
    for bad in ({"width": 0}, {"norm": "l3"}):
        with pytest.raises(ValueError):
            hs.signed_counts(none, **bad)
