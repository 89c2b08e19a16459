import gzip
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textcluster.plans import jobs
from textcluster.session import scratch_path
from textcluster.streaming import replay as st

WORDS = ("alpha beta", "beta gamma", "gamma delta", "alpha delta")
SF = "/root/testdata/sf0.001"


def xml(ids, broken=()):
    recs = "".join(
        f"<PubmedArticle><MedlineCitation><PMID>{i}</PMID><Article><ArticleTitle>T{i}</ArticleTitle>"
        f"<Abstract><AbstractText>{WORDS[i % 4]} {i}</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>\n"
        for i in ids
    )
    recs += "".join("<PubmedArticle><MedlineCitation><Article></MedlineCitation></PubmedArticle>\n" for _ in broken)
    return '<?xml version="1.0"?>\n<PubmedArticleSet>\n' + recs + "</PubmedArticleSet>\n"


def text(ids):
    seg = "\n\n".join
    return "".join(seg([f"{i}. Journal", f"Title {i}", "Authors", "Places", f"{WORDS[i % 4]} {i}", f"PMID: {i}  [Indexed]\n"]) for i in ids) + "tail without an id line\n"


def folder(spark, files):
    path = scratch_path(spark, "inputs")
    os.makedirs(path)
    for name, body in files.items():
        data = body.encode()
        with open(f"{path}/{name}", "wb") as f:
            f.write(gzip.compress(data) if name.endswith(".gz") else data)
    return path


IDS = {"a": range(10000000, 10000040), "b": range(20000000, 20000007), "c": range(30000000, 30000025)}


@pytest.mark.parametrize("kind", ["xml", "txt"])
def test_numbers_are_dense_over_files_in_read_order(spark, kind):
    make = xml if kind == "xml" else text
    path = folder(spark, {f"{n}.{kind}": make(ids) for n, ids in IDS.items()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        recs = jobs.load_records(spark, path, kind)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = sorted((r["seq"], r["permalink"]) for r in recs.collect())
    assert rows == list(enumerate(str(i) for ids in IDS.values() for i in ids))
    cfg = jobs.JobConfig(k=2, n_init=1, max_iter=2, num_docs=45, gen_keywords=False)
    out = jobs.run(spark, path, scratch_path(spark, "out"), kind, cfg)
    got = {r[0] for r in spark.read.option("header", True).csv(out["clusters"]).select("permalink").collect()}
    assert got == {p for _, p in rows[:45]}


def test_case_gzip_and_wrong_extensions_batch_and_stream(spark):
    good = {"a.xml": xml([10000001]), "B.XML": xml([10000002]), "c.xml.gz": xml([10000003])}
    path = folder(spark, good | {"d.json": xml([10000004])})
    with pytest.raises(ValueError, match="d.json"):
        jobs.load_records(spark, path, "xml")
    want = {"10000001", "10000002", "10000003"}
    assert {r["permalink"] for r in jobs.load_records(spark, path, "xml", jobs.JobConfig(on_bad="skip")).collect()} == want
    out = scratch_path(spark, "staged")
    st.stage_arriving(spark, path, out, scratch_path(spark, "ckpt"))
    assert {r["permalink"] for r in spark.read.parquet(out).collect()} == want


def test_rejects_are_kept_by_jobs_and_streams(spark):
    path = folder(spark, {"a.xml": xml([10000001, 10000002, 10000003], broken=[1, 2])})
    out = jobs.run(spark, path, scratch_path(spark, "out"), "xml", jobs.JobConfig(k=2, n_init=1, max_iter=2, gen_keywords=False, out_format="parquet"))
    assert spark.read.parquet(out["rejected"]).count() == 2
    assert spark.read.parquet(out["ingest_counts"]).first().asDict() == {"n_read": 5, "n_valid": 3, "n_rejected": 2}
    staged = scratch_path(spark, "staged")
    st.stage_arriving(spark, path, staged, scratch_path(spark, "ckpt"))
    assert spark.read.parquet(staged + "_rejected").count() == 2 and spark.read.parquet(staged).count() == 3


@pytest.mark.parametrize("staged", [False, True])
def test_every_record_is_parsed_once(spark, staged):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(record):
        seen.add(1)
        return record

    path = folder(spark, {f"{n}.xml": xml(ids) for n, ids in IDS.items()})
    cfg = jobs.JobConfig(k=2, n_init=2, max_iter=2, parser=counted)
    jobs.run(spark, path, scratch_path(spark, "out"), "xml", cfg, staged_path=scratch_path(spark, "staged") if staged else None)
    assert seen.value == sum(len(ids) for ids in IDS.values())


def test_one_python_node_per_parse(spark):
    for name in ("xml_extract", "project_stream", "xml_fallback", "xml_pages"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") == 1, name


LAZY = ["term_freq", "doc_freq", "vocabulary", "idf", "collate_urls", "assign_nearest", "lloyd_step", "xml_extract", "text_extract", "part_numbers", "xml_pages"]


def test_building_a_query_runs_no_job(spark):
    sc = spark.sparkContext
    spark.read.parquet(f"{SF}/documents.parquet")  # a first read infers schemas in a job of its own
    readers = {len(sc.statusTracker().getJobIdsForGroup("none"))}
    for name in LAZY:
        sc.setJobGroup(f"plan-{name}", name)
        df = entry.queries()[name](spark, SF)
        df._jdf.queryExecution().optimizedPlan()
        jobs_run = sc.statusTracker().getJobIdsForGroup(f"plan-{name}")
        schema_reads = 4  # Parquet footers: one small job per table read
        assert len(jobs_run) <= schema_reads, (name, jobs_run)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert readers == {0}


def test_saved_vectors_replace_the_source(spark):
    path = folder(spark, {"a.xml": xml(range(10000000, 10000030))})
    saved, cfg = scratch_path(spark, "features"), jobs.JobConfig(k=2, n_init=1, max_iter=3)
    first = jobs.run(spark, path, scratch_path(spark, "out"), "xml", cfg, features_path=saved)
    again = jobs.run(spark, path + "-absent", scratch_path(spark, "out"), "xml", cfg, features_path=saved)
    rows = [sorted(map(tuple, spark.read.option("header", True).csv(p["clusters"]).collect())) for p in (first, again)]
    assert rows[0] == rows[1] and "rejected" not in again


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from textcluster.session import ensure_checkpoint_dir

    class Fake:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Fake()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return None

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
