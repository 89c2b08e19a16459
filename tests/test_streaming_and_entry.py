import os
import sys

import numpy as np
from pyspark.sql import functions as F

from textcluster.operators import features as fe
from textcluster.operators import vectors as vz
from textcluster.session import scratch_path
from textcluster.sinks import staged as sg
from textcluster.streaming import replay as st


def _articles(spark, n=30):
    rows = [(i, i, f"T{i}", f"word{i % 3} common{i % 2} text{i % 5}", str(10000000 + i)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, seq long, title string, content string, permalink string")


def test_replay_equals_batch(spark):
    arts = _articles(spark)
    path = scratch_path(spark, "t_staged")
    sg.write_parts(arts, path, threshold=9)
    sink, ckpt = scratch_path(spark, "t_sink"), scratch_path(spark, "t_ckpt")
    st.drain(st.replay(spark, path), sink, ckpt)
    got = sorted((r["doc_id"], r["part"]) for r in spark.read.parquet(sink).collect())
    assert got == sorted((r["doc_id"], r["part"]) for r in sg.read_staged(spark, path).collect())
    assert {p for _, p in got} == {1, 2, 3, 4}


def test_minibatch_stream_replay_is_idempotent(spark):
    arts = _articles(spark)
    path = scratch_path(spark, "t_staged2")
    sg.write_parts(arts, path, threshold=9)
    vec = vz.fit_tfidf(spark.read.parquet(path), fe.TfidfParams(min_df=0.0, max_df=1.0))
    state = scratch_path(spark, "t_state")
    ckpt = scratch_path(spark, "t_ckpt2")
    st.minibatch_stream(spark, vec.transform(st.replay(spark, path)), state, ckpt, k=2)
    one, width = st.final_centres(spark, state, 2), len(vec.vocabulary)
    members = sorted(map(tuple, st.streamed_members(spark, state).collect()))
    # A fresh checkpoint replays every batch; applied batches are skipped, so nothing moves.
    st.minibatch_stream(spark, vec.transform(st.replay(spark, path)), state, scratch_path(spark, "t_ckpt3"), k=2)
    two = st.final_centres(spark, state, 2)
    assert np.allclose(one.dense(width), two.dense(width)) and np.allclose(one.counts, two.counts) and round(one.counts.sum()) == 30
    assert members == sorted(map(tuple, st.streamed_members(spark, state).collect()))
    assert [m[0] for m in members] == list(range(30)) and len({m[-1] for m in members}) >= 4


def test_minibatch_stream_waits_for_k_distinct_vectors(spark):
    rows = [(i, i, "t", f"word{i} common{i % 2}" if i > 4 else "same words", str(i)) for i in range(40)]
    arts = spark.createDataFrame(rows, "doc_id long, seq long, title string, content string, permalink string")
    path = scratch_path(spark, "t_staged_wait")
    sg.write_parts(arts, path, threshold=3)
    vec = vz.fit_tfidf(arts, fe.TfidfParams(min_df=0.0, max_df=1.0))
    state = scratch_path(spark, "t_state_wait")
    st.minibatch_stream(spark, vec.transform(st.replay(spark, path)), state, scratch_path(spark, "t_ckpt_wait"), k=20)
    centres = st.final_centres(spark, state).dense(len(vec.vocabulary))
    assert len({tuple(np.round(c, 9)) for c in centres}) == 20
    members = st.streamed_members(spark, state).collect()
    assert sorted(m["doc_id"] for m in members) == list(range(40))
    assert min(m["centres_batch"] for m in members) > 3  # the first batches waited and were labelled later


def test_entry_and_registry(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["lang", "keywords"] and len(rows) >= 1
    assert all(len(r["keywords"].split(", ")) == 20 for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stage_per_source_and_reuse_saved_vectorizer(spark):
    from textcluster.plans import jobs

    arts = _articles(spark).withColumn("source_file", F.concat(F.lit("file:/in/f"), (F.col("doc_id") % 3).cast("string"), F.lit(".xml")))
    path = scratch_path(spark, "t_per_source")
    sg.write_per_source(arts, path)
    back = spark.read.parquet(path)
    assert back.count() == 30 and back.select("source_name").distinct().count() == 3
    feats = scratch_path(spark, "t_features")
    cfg = jobs.JobConfig(k=2, n_init=1, max_iter=5, gen_keywords=True, params=fe.TfidfParams(min_df=0.0, max_df=1.0))
    first = jobs.cluster_articles(spark, arts, cfg, features_path=feats)
    again = jobs.cluster_articles(spark, arts, cfg, features_path=feats)  # S8: loads the saved model
    assert again.vectorizer.vocabulary == first.vectorizer.vocabulary
    assert again.membership.count() == 30 and again.keywords.count() == 2


def test_stage_arriving_text_files(spark):
    from textcluster.sources import records as rc

    docs = spark.createDataFrame(
        [(i, f"Title {i}\nbody words {i}", "en", "s") for i in range(6)] + [(9, "short", "es", "s")],
        "doc_id long, text string, lang string, source string",
    )
    src = scratch_path(spark, "t_arriving_txt")
    rc.text_records(docs).repartition(3).select("record").write.text(src)
    out, ckpt = scratch_path(spark, "t_staged_txt"), scratch_path(spark, "t_ckpt_txt")
    st.stage_arriving(spark, src, out, ckpt, require_title=True, in_format="txt")
    got = sorted(r["permalink"] for r in spark.read.parquet(out).collect())
    assert got == [str(10000000 + i) for i in range(6)]  # the short 'es' record has too few segments
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 3  # one file per batch


def test_stream_hashing_then_idf_equals_batch_hashing(spark):
    arts = _articles(spark)
    path = scratch_path(spark, "t_staged_hash")
    sg.write_parts(arts, path, threshold=9)
    state, ckpt = scratch_path(spark, "t_hash_state"), scratch_path(spark, "t_hash_ckpt")
    width = 1 << 10
    st.hash_arriving(st.replay(spark, path), state, ckpt, width)
    last = st.last_batch(spark, state)
    assert last >= 2
    for batch_id in (0, last // 2, last):  # as of every batch: a fit over the documents so far
        streamed = {r["doc_id"]: r["features"] for r in st.finish_hashing(spark, state, batch_id, width=width).collect()}
        so_far = arts.where(F.col("doc_id").isin(list(streamed)))
        vec = vz.fit_hashing(so_far, fe.TfidfParams(), num_features=width)
        batch = {r["doc_id"]: r["features"] for r in vec.transform(so_far, keep=("doc_id",)).collect()}
        assert streamed.keys() == batch.keys() and (len(batch) == arts.count()) == (batch_id == last)
        assert all(np.allclose(streamed[d].toArray(), batch[d].toArray()) for d in batch)
        assert np.allclose(st.idf_after(spark, state, batch_id, width), vec.pipeline.stages[0].getScalingVec().toArray())
    # an arriving batch goes on from the state; the stateless form gives the same counts
    st.hash_arriving(st.replay(spark, path), state, ckpt, width)
    assert st.last_batch(spark, state) == last
    sink = scratch_path(spark, "t_hash_sink")
    st.drain(st.hash_stream(st.replay(spark, path), width), sink, scratch_path(spark, "t_hash_ckpt"))
    assert spark.read.parquet(sink).count() == arts.count()
