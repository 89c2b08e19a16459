"""The hashing job does each thing once: texts tokenised once, records cut where their lines are, sums of a
step added on the driver; the same results as the longer ways."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from textcluster.functions import text as tx
from textcluster.operators import counts as ct
from textcluster.operators import hashing as hs
from textcluster.operators import minibatch as mb
from textcluster.operators import vectors as vz
from textcluster.plans import jobs
from textcluster.session import scratch_path
from textcluster.sources import text as st


def test_texts_are_tokenised_once(spark, monkeypatch):
    rows = [(i, i, str(10000000 + i), f"alpha{i % 3} beta{i % 4} word{i}") for i in range(60)]
    arts = spark.createDataFrame(rows, "doc_id long, seq long, permalink string, content string")
    calls = []
    real = hs.add_tokens
    monkeypatch.setattr(hs, "add_tokens", lambda *a, **k: calls.append(1) or real(*a, **k))
    cfg = jobs.JobConfig(k=3, vectorizer="hashing", algorithm="minibatch", gen_keywords=False)
    found = jobs.cluster_articles(spark, arts, cfg)
    assert len(calls) == 1 and found.membership.count() == 60
    monkeypatch.undo()
    want = vz.fit_hashing(arts).transform(arts, keep=("doc_id",))
    assert sorted(hs.entries(found.vectors).collect()) == sorted(hs.entries(want).collect())
    found.vectors.unpersist()


def lines_of(text, block=0, name="f"):
    own = text.split("\n")
    return pa.RecordBatch.from_pydict({"source_file": [name] * len(own), "block": [block] * len(own), "line_key": list(range(len(own))), "line": own})


def test_records_are_cut_where_their_lines_are(monkeypatch):
    text = "\n".join(f"{i}. J\n\nbody {i}\n\nPMID: {10000000 + i}" for i in range(20)) + "\nrest\nmore"
    whole = lines_of(text)
    for batches in ([whole], [whole.slice(i, 3) for i in range(0, whole.num_rows, 3)]):
        got = list(st._cut(batches))
        texts = [x for kind, _, *f in got if kind == "records" for x in zip(f[0].tolist(), f[1].to_pylist())]
        assert texts == [(i, f"{i}. J\n\nbody {i}\n\nPMID: {10000000 + i}") for i in range(1, 20)]
        loose = [(f[0], x) for kind, _, *f in got if kind == "lines" for x in f[2].to_pylist()]
        assert loose == [(0, x) for x in ("0. J", "", "body 0", "", "PMID: 10000000")] + [(20, "rest"), (20, "more")]
        assert [x for x in got if x[0] == "count"] == [("count", ("f", 0), 20)]
    # a long record goes line by line, however its lines come
    monkeypatch.setattr(st, "LONG", 60)
    long = lines_of("PMID: 1\na\nPMID: 2\n" + "x" * 30 + "\n" + "y" * 30 + "\nPMID: 3\nb\nPMID: 4", 7)
    for batches in ([long], [long.slice(i, 1) for i in range(long.num_rows)]):
        got = list(st._cut(batches))
        assert [x for kind, _, *f in got if kind == "records" for x in zip(f[0].tolist(), f[1].to_pylist())] == [(1, "a\nPMID: 2"), (3, "b\nPMID: 4")]
        assert [(f[0], x) for kind, _, *f in got if kind == "lines" for x in f[2].to_pylist()] == [(0, "PMID: 1"), (2, "x" * 30), (2, "y" * 30), (2, "PMID: 3")]


@pytest.mark.parametrize("split", ["48", "200", "4096"])
def test_records_of_many_splits_equal_those_of_whole_files(spark, tmp_dir, split):
    import os

    os.makedirs(tmp_dir, exist_ok=True)
    for name, n, end in (("a.txt", 30, "\nrest"), ("b.txt", 3, ""), ("c.txt", 0, "no id\nat all"), ("d.txt", 1, "\n")):
        with open(f"{tmp_dir}/{name}", "w", encoding="utf-8") as f:
            f.write("\n".join(f"{i}. J\n\nbody {'word ' * (i % 9)}\n\nPMID: {10000000 + i}" for i in range(n)) + end)
    row = lambda r: (r["source_file"], r["seq"], r["record"].strip("\n"))
    whole = sorted(map(row, st.read_text_records(spark, tmp_dir).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert sorted(map(row, st.read_text_records_by_lines(spark, tmp_dir).collect())) == whole and len(whole) == 34
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_are_numbered_where_they_are(spark, monkeypatch):
    rows = [(f"f{i // 40}", (i // 10) % 4, i % 10, "text") for i in range(120)]
    path = scratch_path(spark, "t_numbered")
    spark.createDataFrame(rows, "source_file string, block long, seq long, content string").repartition(5).write.parquet(path)
    recs = spark.read.parquet(path)
    monkeypatch.setattr(ct, "MAX_BLOCKS", 3)
    many = sorted(ct.number_records(recs).collect())
    monkeypatch.undo()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = ct.number_records(recs)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        assert sorted(few.collect()) == many and sorted(r["seq"] for r in many) == list(range(120))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_blank_lines_as_by_the_regexes(spark):
    r = random.Random(5)
    bits = ["\n", "\n", "\r", "\r\n", " ", "\t", "a", "$1", "b c", "\u0085", " ", " "]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, "", "\n\n", "a\n ", "\n\n\u0085"]
    t = F.regexp_replace("t", r"\r\n?", "\n")
    t = F.regexp_replace(t, r"^\n+|\n+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n[ \t]*\n(?:[ \t]*\n)*", F.lit("SEP")), r"\n", " ")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(t.alias("want"), tx.collapse_blank_lines(F.col("t"), "SEP").alias("got"))
    assert all(x["want"] == x["got"] for x in rows.collect())


def test_term_codes_are_those_of_md5():
    r = random.Random(3)
    terms = ["".join(r.choice("abcxyzéß中𝒳0_") for _ in range(n)) for n in [*range(70), 120, 500] for _ in range(3)]
    digests = [hashlib.md5(t.encode()).digest() for t in terms]
    for width in (1, 1000, 1 << 20):
        for own, want in ((terms, digests), (pa.array(terms).slice(5, 90), digests[5:95])):
            buckets, signs = hs.codes(own, width)
            assert buckets.tolist() == [int.from_bytes(d[:4], "big") % width for d in want]
            assert signs.tolist() == [1.0 - 2.0 * (d[4] & 1) for d in want]


def wide_rows(spark, n=300, width=1 << 20, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, str(i), Vectors.sparse(width, np.sort(rng.choice(width, 12, replace=False) if i % 3 else rng.choice(40, 12, replace=False)).tolist(), rng.normal(size=12).tolist())) for i in range(n)]
    return spark.createDataFrame(rows, ["doc_id", "permalink", "features"]).repartition(3)


def test_packed_rows_are_the_rows(spark):
    rows = wide_rows(spark).drop("permalink")
    packed = mb.pack(rows.withColumn("g", (F.col("doc_id") % 4).cast("int")), "g", 4, 3)
    assert sorted(mb.unpack(packed, rows.schema).collect()) == sorted(rows.collect())
    for g in range(4):
        own = mb.unpack(packed.where(F.col("g") == g), rows.schema)
        assert sorted(r["doc_id"] for r in own.collect()) == list(range(g, 300, 4))
    assert {r["file"] for r in packed.collect()} <= {0, 1, 2}


@pytest.mark.parametrize("setting", [{}, {"DENSE": 40}, {"WIDE": 10}, {"STRETCH": 16}, {"MAX_ENTRIES": 500}])
def test_a_step_is_the_same_by_every_way(spark, monkeypatch, setting):
    rows, path = wide_rows(spark), scratch_path(spark, "t_ways")
    for name, value in setting.items():
        monkeypatch.setattr(mb, name, value)
    centres, _ = mb.seed_centres(rows, 6, 2, 1, 1000, f"{path}/seed")
    x = {r["doc_id"]: r["features"] for r in rows.collect()}
    point = lambda i: (np.asarray(x[i].indices), np.asarray(x[i].values))
    packed = mb.pack(rows.select("doc_id", "features").withColumn("g", F.lit(0)), "g")
    state = centres
    for step, own in enumerate((rows.where("doc_id < 100"), rows)):
        label = {r["doc_id"]: r["cluster_id"] for r in mb.assign(own, state).collect()}
        want: dict = {(int(r["cluster_id"]), int(r["term_idx"])): r["s"] for r in state.table.where("term_idx >= 0").collect()}
        for i, c in label.items():
            for t, v in zip(*point(i)):
                want[c, int(t)] = want.get((c, int(t)), 0.0) + v
        counts = state.counts + np.bincount(list(label.values()), minlength=6)
        state = mb.fold(own, state, f"{path}/{step}", packed=packed if step else None)
        got = {(r["cluster_id"], r["term_idx"]): r["s"] for r in state.table.where("term_idx >= 0").collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - v) < 1e-9 for i, v in want.items())
        assert np.allclose(state.counts, counts) and (state.held is None) == ("MAX_ENTRIES" in setting and len(got) > 500 - 12)
    moved = mb.restart(rows, state, np.array([1, 4]), f"{path}/restart", 9)
    left = {(r["cluster_id"], r["term_idx"]): r["s"] for r in moved.table.where("term_idx >= 0").collect()}
    assert {c: v for c, v in left.items() if c[0] not in (1, 4)} == pytest.approx({c: v for c, v in got.items() if c[0] not in (1, 4)})
    assert [sum(c[0] == i for c in left) for i in (1, 4)] == [12, 12] and moved.counts[1] == moved.counts[4] == np.delete(state.counts, [1, 4]).min()


def test_seeds_do_not_depend_on_packing_or_partitions(spark):
    rows = wide_rows(spark, 120, 5000).select("doc_id", "features")
    plain = lambda found: ([[(list(p["indices"]), list(p["values"])) for p in t] for t in found[0]], np.round(found[1], 9).tolist())
    want = plain(mb.seeds(rows.cache(), 5, 2, 3))
    assert plain(mb.seeds(rows, 5, 2, 3, hold=True)) == want == plain(mb.seeds(rows.coalesce(1), 5, 2, 3, hold=True))
    assert [len(t) for t in want[0]] == [5, 5]
