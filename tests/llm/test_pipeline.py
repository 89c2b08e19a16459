import pytest
import sentencepiece

import corpus_pipeline as pipeline
from textcluster.llm import pieces
from textcluster.session import scratch_path

from . import test_classifiers as classifiers
from . import test_decontaminate as leaks
from . import test_line_dedup as lines
from .helpers import DOCS, docs, grams, groups, rng, words


def corpus():
    """Texts with toxic ones, shared lines, near copies and benchmark passages."""
    r = rng(12)
    texts, toxic, _ = classifiers.corpus(300)
    shared = ["a line that is shared by many documents, number %d" % i for i in range(3)]
    items = [" ".join(words(r, 30)) for _ in range(5)]
    for i in range(60):
        texts.append("\n".join([" ".join(words(r, 50)), *r.sample(shared, r.randint(0, 2))]))
    base = words(r, 200)
    for i in range(30):
        own = list(base)
        for _ in range(r.randint(0, 3)):
            own[r.randrange(200)] = "changed" + str(i)
        texts.append(" ".join(own))
    for i in range(20):
        texts.append(" ".join(words(r, 20)) + " " + r.choice(items) + " " + " ".join(words(r, 20)))
    texts += [None, "", "", "one", "▁", "é" * 3000, "\n\n"]
    return texts, toxic, items


@pytest.fixture(scope="module")
def folder(spark):
    texts, toxic, items = corpus()
    path = scratch_path(spark, "pipeline-test")
    docs(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_every_stage_does_its_work_on_what_the_one_before_kept(spark, folder):
    texts, toxic, items = corpus()
    now = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        out = pipeline.written(stage(spark, now, folder), f"test-{name}")
        rows = {x["doc_id"]: x["text"] for x in now.collect()}
        seen.append((name, rows, {x["doc_id"]: x for x in out.collect()}, out.columns))
        now = out
    names = [f.name for f in DOCS]
    assert all(columns == names for *_, columns in seen[:-1])

    _, rows, kept, _ = seen[0]
    assert sum((i in kept) != bool(t) for i, t in enumerate(toxic)) >= 0.97 * len(toxic)
    assert all(i in kept for i in range(len(toxic), len(texts)))

    _, rows, kept, _ = seen[1]
    want = {i: (dropped, text) for i, _, dropped, text in lines.brute(list(rows.items()))}
    assert {i: x["text"] or "" for i, x in kept.items()} == {i: t for i, (_, t) in want.items()}
    assert all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in kept.values()) and any(n for n, _ in want.values())

    _, rows, kept, _ = seen[2]
    found = groups({i: grams(t, 5) for i, t in rows.items()}, 80, 100)
    assert set(kept) == {found[i] for i in found} and len(kept) < len(rows)

    _, rows, kept, _ = seen[3]
    assert set(kept) == {i for i, (_, hit, _) in leaks.brute(rows.items(), enumerate(items)).items() if not hit} and len(kept) < len(rows)

    _, rows, kept, columns = seen[4]
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert columns == names + ["piece_ids", "n_pieces", "round_trip"] and set(kept) == set(rows)
    assert all(x["round_trip"] and x["n_pieces"] == len(x["piece_ids"]) and model.decode(list(x["piece_ids"])) == (x["text"] or "") for x in kept.values())

    final = {x["doc_id"]: (x["text"], x["n_pieces"]) for x in pipeline.run(spark, folder).collect()}
    assert final == {i: (x["text"], x["n_pieces"]) for i, x in kept.items()}


def test_empty_documents(spark, folder):
    now = spark.createDataFrame([], DOCS)
    for _, stage in pipeline.STAGES:
        now = stage(spark, now, folder)
    assert now.count() == 0
