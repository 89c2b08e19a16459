import re

import pytest

from textcluster.llm import decontaminate

from .helpers import awkward, docs, empty, rng, words

ITEMS = "item_id long, text string, hash string, pos string"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(rows, items):
    wins = {}
    for i, t in items:
        w = tokens(t)
        if i is not None and w:
            size = min(10, len(w))
            for p in range(len(w) - size + 1):
                wins.setdefault(tuple(w[p : p + size]), set()).add(i)
    out = {}
    for i, t in rows:
        w, hit, own = tokens(t), set(), set()
        for size in range(1, 11):
            for p in range(len(w) - size + 1):
                if found := wins.get(tuple(w[p : p + size])):
                    own |= found
                    hit |= set(range(p, p + size))
        out[i] = (len(w), len(hit), sorted(own))
    return out


def case(spark):
    r = rng(9)
    items = [(i, " ".join(words(r, r.randint(1, 40)))) for i in range(30)] + [(100, None), (101, ""), (None, "lo ra ti"), (7, "short second text")]
    texts = awkward(r)
    for _ in range(60):
        own = words(r, r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            passage = r.choice(items)[1] or ""
            at = r.randint(0, len(own))
            own[at:at] = re.sub(" ", r.choice((" ", "\n", ", ")), passage.upper() if r.random() < 0.3 else passage).split(" ")
        texts.append(" ".join(own))
    return texts, items, spark.createDataFrame([(i, t, "h", "p") for i, t in items], ITEMS)


@pytest.mark.parametrize("max_bytes", [64 << 20, 10])
def test_matches_brute_force(spark, max_bytes):
    texts, items, table = case(spark)
    rows = decontaminate.mark(docs(spark, texts), table, max_bytes=max_bytes).collect()
    got = {x["doc_id"]: (x["__dc_n_words"], x["__dc_n_hit"], list(x["__dc_items"])) for x in rows}
    assert got == brute(enumerate(texts), items)


def test_removal(spark):
    texts, items, table = case(spark)
    want = {i for i, (_, hit, _) in brute(enumerate(texts), items).items() if not hit}
    kept = decontaminate.remove_documents(docs(spark, texts), table)
    assert {x["doc_id"] for x in kept.collect()} == want and kept.columns == docs(spark, ["x"]).columns
    cut = {x["doc_id"]: x["text"] for x in decontaminate.remove_spans(docs(spark, texts), table).collect()}
    assert all(cut[i] == texts[i] for i in want)
    words_left = {i: len(tokens(t)) for i, t in cut.items()}
    assert all(words_left[i] == n - hit for i, (n, hit, _) in brute(enumerate(texts), items).items())


@pytest.mark.parametrize("max_bytes", [64 << 20, 10])
def test_rows_that_share_an_id_or_have_none(spark, max_bytes):
    texts, items, table = case(spark)
    want = brute(enumerate(texts), items)
    ids = [(None, 7, i)[i % 3] for i in range(len(texts))]
    frame = docs(spark, texts, ids)
    rows = decontaminate.mark(frame, table, max_bytes=max_bytes).collect()
    got = [(x["doc_id"], x["text"], x["__dc_n_words"], x["__dc_n_hit"], list(x["__dc_items"])) for x in rows]
    assert sorted(map(repr, got)) == sorted(repr((ids[i], t, *want[i])) for i, t in enumerate(texts))
    kept = decontaminate.remove_documents(frame, table, max_bytes=max_bytes).collect()
    assert sorted(repr((x["doc_id"], x["text"])) for x in kept) == sorted(repr((ids[i], t)) for i, t in enumerate(texts) if not want[i][1])


def test_spans_are_removed_beyond_the_broadcast(spark):
    texts, _, table = case(spark)
    frame = docs(spark, texts, [(None, 7, i)[i % 3] for i in range(len(texts))])
    cut = [sorted(repr((x["doc_id"], x["text"])) for x in decontaminate.remove_spans(frame, table, max_bytes=n).collect()) for n in (64 << 20, 10)]
    assert len(cut[0]) == len(texts) and cut[0] == cut[1]


def test_empty_tables(spark):
    _, _, table = case(spark)
    assert decontaminate.mark(empty(spark), table).count() == 0
    none = spark.createDataFrame([], ITEMS)
    assert [x["__dc_n_hit"] for x in decontaminate.mark(docs(spark, ["a b"]), none).collect()] == [0]
