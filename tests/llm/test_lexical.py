import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textcluster.llm import lexical

from .helpers import awkward, docs, empty, rng, words

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k):
    held = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for name, text in set(items):
        scored = []
        for i, c in held:
            n = sum(c.values())
            m = 25 + (75 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text))
            if score > 0:
                scored.append((-score, -(1 << 63) if i is None else i, i))
        out += [(name, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def corpus(r, n):
    texts = awkward(r) + [" ".join(r.choice(("Zu", "ké", "ra1", "-", "ONE")) for _ in range(r.randint(1, 80))) for _ in range(n)]
    texts += [" ".join(words(r, r.randint(1, 60))) for _ in range(n)]
    ids = list(range(len(texts)))
    ids[5], ids[6], ids[30] = None, None, ids[31]
    return texts, ids


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc string, rank string")


@pytest.mark.parametrize("block", [1 << 20, 60000])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "LEAF", 8)
    r = rng(4)
    texts, ids = corpus(r, 150)
    rows = [(k, " ".join(words(r, r.randint(1, 12))), "d", "r") for k in range(30)]
    rows += [(50, None, "d", "r"), (51, "", "d", "r"), (52, "?!", "d", "r"), (None, "One two one", "d", "r"), (53, texts[9], "d", "r"), (54, texts[40], "d", "r"), (54, texts[40], "d", "r"), (55, "unknownterm", "d", "r")]
    got = sorted((tuple(x) for x in lexical.top_documents(docs(spark, texts, ids, parts=5), items_of(spark, rows), 10, block_bytes=block).collect()), key=str)
    assert got == brute(list(zip(ids, texts, strict=True)), [x[:2] for x in rows], 10)


def test_ties_go_to_the_smaller_id_and_copies_rank_apart(spark):
    texts = ["alpha beta"] * 40 + ["gamma"] * 5
    got = lexical.top_documents(docs(spark, texts, list(range(45, 0, -1))), items_of(spark, [(1, "Alpha", "d", "r")]), 3).collect()
    assert sorted((x["rank"], x["doc"]) for x in got) == [(1, 6), (2, 7), (3, 8)] and len({x["score"] for x in got}) == 1


def shard_of(r, n_docs, vocabularies, n_items, monkeypatch):
    monkeypatch.setattr(lexical, "LEAF", 32)
    draw = lambda k: [vocabularies[k][int(len(vocabularies[k]) * r.random() ** 3)] for _ in range(r.randint(5, 60))]
    items = lexical.read_items(pa.array([" ".join(draw(i % len(vocabularies))) for i in range(n_items)]))
    items.weight = np.array([r.randint(0, 9000) for _ in items.hashes], np.int64)
    at, term, value = [0], [], []
    for d in range(n_docs):
        text = pa.array([" ".join(draw(d % len(vocabularies)))])
        own = np.concatenate([h for *_, h in lexical._terms(text)])
        places = [int(np.searchsorted(items.hashes, h)) for h in set(own.tolist()) if h in items.hashes]
        term += sorted(places)
        value += [r.randint(1, 999999) for _ in places]
        at.append(len(term))
    return items, lexical.Shard(np.arange(n_docs), np.array(at), np.array(term), np.array(value), items.weight, items.group)


def test_bounds_hold_and_prune(monkeypatch):
    r = rng(2)
    items, shard = shard_of(r, 1500, [[f"{k}w{i}" for i in range(150)] for k in "abcd"], 24, monkeypatch)
    own = [(items.term[a:b], items.count[a:b]) for a, b in zip(items.at[:-1], items.at[1:], strict=True)]
    limits = shard.bounds(items, own)
    want = []
    for i, (term, count) in enumerate(own):
        weight = dict(zip(term.tolist(), (count * items.weight[term]).tolist(), strict=True))
        scores = np.array([sum(weight.get(int(shard.terms[t]), 0) * int(v) for t, v in zip(shard.term[a:b], shard.value[a:b], strict=True)) for a, b in zip(shard.at[:-1], shard.at[1:], strict=True)])
        assert all(scores[ball.lo : ball.hi].max() <= limits[i, j] for j, ball in enumerate(shard.balls))
        want.append(sorted(zip((-scores).tolist(), shard.doc.tolist(), strict=True))[:5])
    best = lexical.Best(len(items), 5, np.zeros(len(items), np.int64))
    scored = lexical.search_shard(shard, items, best)
    assert [list(zip((-s).tolist(), d.tolist(), strict=True)) for s, d in zip(best.score, best.doc, strict=True)] == want
    assert scored < 0.5 * 1500 * len(items)  # subtrees without the item's terms are pruned


def test_empty_tables(spark):
    items = items_of(spark, [(1, "one", "d", "r")])
    assert lexical.top_documents(empty(spark), items).count() == 0
    assert lexical.top_documents(docs(spark, ["one"]), items.limit(0)).count() == 0
    assert lexical.top_documents(docs(spark, [None, "..."]), items).count() == 0
