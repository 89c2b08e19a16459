import hashlib

import numpy as np
import pyarrow as pa

from textcluster.llm import chunk_dedup, scan

from .helpers import awkward, docs, empty, rng, words


def chunks(text):
    """Chunks of one text, cut by a hash kept byte by byte."""
    data, out, last, h = text.encode(), [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(chunk_dedup.GEAR[byte])) & 0xFFFFFFFF
        inner = i + 1 < len(data) and data[i + 1] & 0xC0 == 0x80
        if h < (1 << 32) // chunk_dedup.MEAN_BYTES and not inner or i + 1 == len(data):
            while i + 1 - last > chunk_dedup.MAX_BYTES:
                cut = last + chunk_dedup.MAX_BYTES
                while data[cut] & 0xC0 == 0x80:
                    cut -= 1
                out.append((last, cut))
                last = cut
            out.append((last, i + 1))
            last = i + 1
    return out, data


def common_blocks(a, b, least):
    """All maximal (start in a, start in b, length) with equal text of at least ``least``, by comparing texts."""
    out = []
    for shift in range(-len(b) + least, len(a) - least + 1):
        i = max(shift, 0)
        while i < min(len(a), len(b) + shift):
            j = i
            while j < min(len(a), len(b) + shift) and a[j] == b[j - shift]:
                j += 1
            if j - i >= least:
                out.append((i, i - shift, j - i))
            i = j + 1
    return out


def test_cuts_equal_a_byte_by_byte_hash():
    texts = [t or "" for t in awkward(rng(3))] + [" ".join(words(rng(i), 200)) for i in range(20)]
    for _, data, offsets in scan.texts(pa.array(texts)):
        ends = chunk_dedup.cuts(data, offsets)
        for i, text in enumerate(texts):
            own = ends[(ends > offsets[i]) & (ends <= offsets[i + 1])] - offsets[i]
            assert own.tolist() == [b for _, b in chunks(text)[0]]


def corpus(r):
    passages = [" ".join(words(r, 60)) for _ in range(4)]
    texts = awkward(r)
    for _ in range(60):
        own = words(r, r.randint(10, 80))
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(own))
            own[at:at] = [r.choice(passages)]
        texts.append(" ".join(own))
    return passages, texts


def test_spans_stand_whole_in_their_keeper_and_hold_the_passages(spark):
    passages, texts = corpus(rng(8))
    got = chunk_dedup.repeated_spans(docs(spark, texts)).collect()
    marked = {i: [False] * len(t or "") for i, t in enumerate(texts)}
    for x in got:
        text, kept = texts[x["doc"]], texts[x["kept_in"]]
        assert x["kept_in"] < x["doc"] and 0 <= x["start"] and x["end"] <= len(text)
        assert text[x["start"] : x["end"]] in kept and x["end"] - x["start"] >= chunk_dedup.MIN_SPAN
        marked[x["doc"]][x["start"] : x["end"]] = [True] * (x["end"] - x["start"])
    seen = set()
    for i, t in enumerate(texts):
        for p in passages:
            at = (t or "").find(p)
            if at >= 0 and p in seen:
                assert all(marked[i][at : at + len(p)])
            elif at >= 0:
                seen.add(p)
    assert all(marked[6]) and len(marked[6]) > 0  # an exact copy is marked whole
    # texts as compared pair by pair: nothing is marked that no smaller text holds, and spans are maximal but for REACH
    short = [i for i, t in enumerate(texts) if t and len(t) < 3000][:40]
    for x in got:
        if x["doc"] in short and x["kept_in"] in short:
            blocks = common_blocks(texts[x["doc"]], texts[x["kept_in"]], chunk_dedup.MIN_SPAN)
            assert any(a <= x["start"] and x["end"] <= a + n and (n > 300 or (a, a + n) == (x["start"], x["end"])) for a, _, n in blocks)


def test_cut_texts_lose_the_marked_spans_alone(spark):
    _, texts = corpus(rng(9))
    spans = chunk_dedup.repeated_spans(docs(spark, texts)).collect()
    keep = {i: [True] * len(t or "") for i, t in enumerate(texts)}
    for x in spans:
        keep[x["doc"]][x["start"] : x["end"]] = [False] * (x["end"] - x["start"])
    want = {i: None if t is None else "".join(c for c, k in zip(t, keep[i], strict=True) if k) for i, t in enumerate(texts)}
    cut = chunk_dedup.cut_repeats(docs(spark, texts))
    assert {x["doc_id"]: x["text"] for x in cut.collect()} == want and cut.columns == docs(spark, ["x"]).columns
    assert sum(t is not None and want[i] != t for i, t in enumerate(texts)) > 10


def test_an_insertion_moves_few_cuts():
    text = " ".join(words(rng(4), 2000))
    own, data = chunks(text)
    moved, other = chunks(text[:5000] + "inserted words" + text[5000:])
    a, b = {data[x:y] for x, y in own}, {other[x:y] for x, y in moved}
    assert len(a - b) <= 4


def test_no_short_passage_is_missed(spark):
    # 50-word passages (about 320 bytes) at random offsets of two texts each
    r = rng(13)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    texts, places = [], {}
    for i in range(300):
        passage = " ".join(word() for _ in range(50))
        for doc in (2 * i, 2 * i + 1):
            head = " ".join(word() for _ in range(r.randint(5, 60))) + " "
            places[doc] = (len(head), len(head) + len(passage))
            texts.append(head + passage + " " + " ".join(word() for _ in range(r.randint(5, 60))))
    found = {}
    for x in chunk_dedup.repeated_spans(docs(spark, texts)).collect():
        a, b = places[x["doc"]]
        assert x["doc"] % 2 == 1 and x["kept_in"] == x["doc"] - 1 and x["start"] >= a - 4 and x["end"] <= b + 4
        found[x["doc"]] = found.get(x["doc"], 0) + x["end"] - x["start"]
    share = [found.get(d, 0) / (places[d][1] - places[d][0]) for d in range(1, 600, 2)]
    assert sum(x >= 0.9 for x in share) >= 297 and sum(share) / len(share) > 0.98


def test_null_and_repeated_ids(spark):
    text = " ".join(words(rng(5), 100))
    rows = chunk_dedup.repeated_spans(docs(spark, [text, text, text, "x"], [3, None, 3, 4])).collect()
    assert {(x["doc"], x["kept_in"], x["end"]) for x in rows} == {(3, None, len(text))}


def test_empty_table(spark):
    assert chunk_dedup.repeated_spans(empty(spark)).count() == 0
    assert np.array_equal(chunk_dedup.cuts(np.zeros(0, np.uint8), np.array([0, 0])), [])
