import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from textcluster.llm import pieces, scan

from .helpers import awkward, docs, empty, rng, words


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def encoded(v, texts, seed=7, rate=0.0):
    out = []
    for _, data, offsets in scan.texts(pa.array(texts, pa.string())):
        ids, counts = pieces.encode_slice(v, data, offsets, seed, rate)
        stop = np.concatenate([[0], np.cumsum(counts)])
        out += [ids[stop[i] : stop[i + 1]].tolist() for i in range(len(counts))]
    return out


def cases():
    r = rng(2)
    return [t or "" for t in awkward(r)] + [" ".join(words(r, 50)) for _ in range(20)] + ["ab" * 300, "a  b\t\tc\n", "日本語 mixed é", "<0x41> </s> <unk>", "   "]


def test_without_dropout_equals_the_library(vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for t in cases() if pieces.SPACE not in t]
    assert encoded(vocabulary, texts) == [model.encode(t) for t in texts]


def test_dropout_varies_by_seed_and_is_lossless(spark, vocabulary):
    texts = cases()
    a, b = encoded(vocabulary, texts, 1, 0.3), encoded(vocabulary, texts, 2, 0.3)
    assert a == encoded(vocabulary, texts, 1, 0.3) and a != b
    assert sum(map(len, a)) > sum(map(len, encoded(vocabulary, texts)))
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert [model.decode(x) for x in a] == texts
    # one word at many places of a text is cut in several ways
    one = encoded(vocabulary, [" ".join(["international"] * 200)], 1, 0.3)[0]
    assert len({tuple(x) for x in np.split(one, np.flatnonzero([vocabulary.spelled[vocabulary.spelled_at[i]] == 32 for i in one])) for x in [x.tolist()]}) > 5


def test_the_skip_share_of_every_merge_nears_the_rate(vocabulary):
    # one merge a word: "▁" and a letter; 80 texts of 50 times the letters
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [f"{i} " + " ".join(letters * 50) for i in range(80)]
    ids = np.concatenate([np.array(x) for x in encoded(vocabulary, texts, 7, 0.1)])
    for c in letters:
        alone, merged = vocabulary.symbols[ord(c)], vocabulary.merged[pieces._find(vocabulary, np.array([vocabulary.space]), vocabulary.symbols[[ord(c)]])][0]
        skipped, whole = (ids == alone).sum(), (ids == merged).sum()
        assert skipped + whole == 4000 and abs(skipped / 4000 - 0.1) < 0.022, c
    # the variety of a word grows with its occurrences
    texts = [f"{i} " + " ".join(["internationalization"] * 100) for i in range(20)]
    cut = set()
    for x in encoded(vocabulary, texts, 7, 0.3):
        at = np.flatnonzero([vocabulary.spelled[vocabulary.spelled_at[i]] == 32 for i in x])
        cut |= {tuple(w.tolist()) for w in np.split(np.array(x), at)}
    assert len(cut) > 100


def test_slices_and_order_do_not_matter(vocabulary):
    texts = cases()
    whole = encoded(vocabulary, texts, 5, 0.2)
    assert [encoded(vocabulary, [t], 5, 0.2)[0] for t in texts] == whole


def test_heap_equals_rounds(vocabulary, monkeypatch):
    texts = cases()[-12:]
    rounds = encoded(vocabulary, texts, 5, 0.2)
    monkeypatch.setattr(pieces, "LONG", 0)
    assert encoded(vocabulary, texts, 5, 0.2) == rounds


def test_all_candidates_dropped_leaves_characters(vocabulary):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = encoded(vocabulary, ["hello there"], 1, 1.0)[0]
    assert [model.id_to_piece(i) for i in got] == list("▁hello▁there")


def test_columns(spark, vocabulary):
    texts = awkward(rng(2))
    frame = docs(spark, texts)
    out = frame.withColumn("ids", pieces.encode_column(spark, vocabulary, F.col("text"), 3, 0.1))
    rows = out.withColumn("back", pieces.decode_column(spark, vocabulary, F.col("ids"))).collect()
    assert all(x["back"] == (x["text"] or "") for x in rows) and len(rows) == len(texts)
    none = empty(spark).select(pieces.encode_column(spark, vocabulary, F.col("text")).alias("ids"))
    assert none.select(pieces.decode_column(spark, vocabulary, F.col("ids"))).count() == 0


def test_documents_keep_their_columns(spark, vocabulary):
    texts = awkward(rng(2))
    frame = docs(spark, texts).withColumn("n_pieces", F.lit("taken"))
    out = pieces.encode_documents(frame, vocabulary, seed=3, rate=0.1)
    assert out.columns == [c for c in frame.columns if c != "n_pieces"] + list(pieces.ENCODED)
    rows = {x["doc_id"]: x for x in out.collect()}
    want = encoded(vocabulary, [t or "" for t in texts], 3, 0.1)
    assert all(rows[i]["piece_ids"] == w and rows[i]["n_pieces"] == len(w) and rows[i]["round_trip"] and rows[i]["text"] == texts[i] for i, w in enumerate(want))
    assert pieces.encode_documents(empty(spark), vocabulary).count() == 0
