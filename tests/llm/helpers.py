"""Small tables with the awkward cases, and brute-force results for them."""

import hashlib
import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators also use for their own columns
    T.StructField("score", T.StringType()), T.StructField("h1", T.StringType()), T.StructField("pos", T.StringType()),
    T.StructField("component", T.StringType()), T.StructField("n", T.StringType()), T.StructField("doc", T.StringType()),
])
STEMS = "the of and ra lo ti né zu ké wor mi sta ble on er".split()


def words(rng, n):
    return ["".join(rng.choice(STEMS) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def docs(spark, texts, ids=None, parts=3):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src0", None if t is None else len(t), "s", "h", "p", "c", "n", "d") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward(rng):
    """Null, empty, blank, short, very long and repeated texts."""
    base = " ".join(words(rng, 300))
    return [None, "", " \n\t", "one", "one two", base, base, base.upper(), base + " end", " ".join(words(rng, 30000)), "\n" * 50, "é" * 5000, "▁ ▁x", "\U0001f600 x"]


def grams(text, k):
    found = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not found:
        return set()
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)} or {tuple(found)}


def groups(sets, num, den):
    """{key: smallest key of its component} by comparing all pairs."""
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in sets}


def rng(seed=1):
    return random.Random(seed)
