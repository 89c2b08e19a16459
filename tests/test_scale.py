"""What must not grow with the input: files of a replay, rows of one task, what a task makes of a batch."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textcluster.operators import hashing as hs
from textcluster.operators import minibatch as mb
from textcluster.operators import models as md
from textcluster.operators import parse as ps
from textcluster.operators import tokens as tk
from textcluster.plans import queries as qs
from textcluster.session import scratch_path
from textcluster.sinks import staged as sg
from textcluster.streaming import replay as st


def articles(spark, n):
    rows = [(i, i, f"T{i}", f"word{i % 3} common{i % 2}", str(10000000 + i)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, seq long, title string, content string, permalink string").repartition(4)


def test_files_of_a_replay_do_not_grow_with_parts(spark):
    arts = articles(spark, 600)
    by_folder, shared = scratch_path(spark, "t_folders"), scratch_path(spark, "t_shared")
    sg.write_parts(arts, by_folder, threshold=3)
    sg.write_parts(arts, shared, threshold=3, folders=False)
    cols = ["doc_id", "seq", "title", "content", "permalink", "part"]
    back = spark.read.schema(st.STAGED_SCHEMA).parquet(shared)
    assert sorted(back.select(cols).collect()) == sorted(sg.read_staged(spark, by_folder).select(cols).collect())
    files = back.groupBy(F.col("_metadata.file_path")).count().collect()
    assert 12 <= len(files) <= sg.REPLAY_FILES + 4 < len(sg.read_staged(spark, by_folder).inputFiles())
    sink = scratch_path(spark, "t_sink")
    st.drain(st.replay(spark, shared), sink, scratch_path(spark, "t_ckpt"))
    assert sorted(spark.read.parquet(sink).select(cols).collect()) == sorted(back.select(cols).collect())


def test_labels_are_checked_by_their_own_version(spark):
    points = [(i, str(i), Vectors.sparse(2, [0], [float(i % 2) + 0.1])) for i in range(80)]
    vectors = spark.createDataFrame(points, ["doc_id", "permalink", "features"])
    # odd versions have their centres the other way round; doc 7 has a wrong label, doc 9 one out of range
    rows = [(i, str(i), {7: 1 - (i + i // 2) % 2, 9: 5}.get(i, (i + i // 2) % 2), i // 2) for i in range(80)]
    members = spark.createDataFrame(rows, "doc_id long, permalink string, cluster_id int, centres_batch long")
    centres = lambda v: np.array([[0.1, 0.0], [1.1, 0.0]])[:: -1 if v % 2 else 1]
    got = {r["doc_id"]: (r["in_range"], r["is_nearest"]) for r in qs._checked_by_version(vectors, members, centres).collect()}
    assert len(got) == 80 and got[7] == (True, False) and got[9] == (False, None)
    assert all(v == (True, True) for d, v in got.items() if d not in (7, 9))


def test_the_seeding_sample_stays_where_it_is(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id").repartition(6)
    found = mb.smallest_hashes(rows, 700, 3)
    want = rows.orderBy(F.xxhash64(F.lit(3), "doc_id")).limit(700)
    assert sorted(found.collect()) == sorted(want.collect())
    # many rows in one range of hashes: an id that repeats comes as a whole
    one = spark.range(40).select(F.lit(1).cast("long").alias("doc_id"))
    assert mb.smallest_hashes(one, 10, 3).count() == 40 and mb.smallest_hashes(rows, 5000, 3).count() == 5000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan
    held = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) == 6 and max(r["count"] for r in held) < 350


def test_slices_hold_whole_rows_and_lose_none():
    lists = [["a"] * n for n in (3, 0, 5, 9, 1)] + [None, ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists)], names=["i", "t"])
    cut = list(md.in_slices([batch, batch.slice(0, 0)], md.list_sizes("t"), limit=4))
    assert [c.num_rows for c in cut] == [3, 1, 3] and pa.Table.from_batches(cut).to_pydict() == {"i": list(range(7)), "t": lists}


@pytest.mark.parametrize("limit", [1, 7])
def test_results_do_not_depend_on_slices(spark, monkeypatch, limit):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 5} gamma alpha " * (i % 4) if i % 9 else None) for i in range(60)], "doc_id long, content string")
    recs = docs.selectExpr("doc_id", "concat('<PubmedArticle><PMID>1</PMID><ArticleTitle>', content, '</ArticleTitle></PubmedArticle>') record")
    run = lambda: (
        sorted(tk.term_freq(docs).collect()),
        sorted(hs.entries(hs.signed_counts(docs, 64)).collect()),
        sorted(hs.bucket_df(hs.signed_counts(docs, 64), 64).collect()),
        sorted(ps.parse_xml(recs, keep=("doc_id",)).collect(), key=lambda r: r["doc_id"]),
    )
    whole = run()
    monkeypatch.setattr(md.in_slices, "__defaults__", (limit,))
    assert run() == whole and len(whole[3]) == 60


def test_segments_are_cut_once_a_record(spark):
    recs = spark.createDataFrame([("1. J\n\nt\n\na\n\ni\n\nbody\n\nPMID: 12345678",), ("x",), (None,)], "record string")
    parsed = ps.parse_text(recs, keep=())
    kept = parsed.na.drop("any", subset=["permalink", "title", "content"])
    assert [tuple(r)[:3] for r in kept.collect()] == [("t", "body", "12345678")]
    assert [r["error"] for r in parsed.collect()] == [None, "too_few_segments", "too_few_segments"]
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SEGMENTBREAK") <= 2  # once put in, once split by
