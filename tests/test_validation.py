import pytest

from textcluster.operators import features as fe
from textcluster.operators import report as rp
from textcluster.plans import jobs
from textcluster.session import cluster_conf
from textcluster.sinks import export as ex
from textcluster.sources.files import validate_file


def test_validate_file(tmp_path):
    validate_file("NA")
    validate_file(str(tmp_path / "a.XML"))
    with pytest.raises(ValueError):
        validate_file(str(tmp_path))  # a directory
    with pytest.raises(ValueError):
        validate_file(str(tmp_path / "a.json"))


def test_job_config_checks():
    with pytest.raises(ValueError):
        jobs.JobConfig(vectorizer="hashing").check()  # keywords need a vocabulary
    jobs.JobConfig(vectorizer="hashing", gen_keywords=False).check()
    with pytest.raises(ValueError):
        jobs.JobConfig(algorithm="dbscan").check()
    with pytest.raises(ValueError):
        fe.TfidfParams(norm="l3")


def test_export_errors(spark):
    df = spark.range(2)
    with pytest.raises(ValueError):
        ex.assemble_output(df, None, gen_keywords=True)
    assert list(ex.assemble_output(df, None, gen_keywords=False)) == ["clusters"]
    with pytest.raises(ValueError):
        ex.export_tables("/nonexistent", {"t": df}, fmt="xlsx")


def test_export_parquet_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "cluster_id int, keywords string")
    paths = ex.export_tables(tmp_dir, {"cluster_keywords": df}, fmt="parquet")
    assert sorted(spark.read.parquet(paths["cluster_keywords"]).collect()) == sorted(df.collect())


def test_lda_report_format(spark):
    kw = spark.createDataFrame([(3, "x, y")], "cluster_id int, keywords string")
    assert rp.report_lines(kw, "lda").first()["line"] == "Topic #: 3   Top terms: x, y"
    with pytest.raises(ValueError):
        rp.report_lines(kw, "svd")


def test_cluster_conf_sizes_partitions():
    conf = cluster_conf(100 << 40, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert int(cluster_conf(1 << 20, 16)["spark.sql.shuffle.partitions"]) == 48


def test_run_with_num_docs_keeps_first_records(spark, tmp_dir):
    import os

    from textcluster.sources import records as rc

    docs = spark.createDataFrame(
        [(i, f"Title {i}\nalpha beta gamma w{i % 4}", "en", "s") for i in range(12)],
        "doc_id long, text string, lang string, source string",
    )
    src = os.path.join(tmp_dir, "in")
    rc.text_records(docs).coalesce(1).select("record").write.text(src)
    cfg = jobs.JobConfig(k=2, n_init=1, max_iter=3, num_docs=5, params=fe.TfidfParams(min_df=0.0, max_df=1.0))
    paths = jobs.run(spark, src, os.path.join(tmp_dir, "out"), "txt", cfg)
    members = spark.read.option("header", True).csv(paths["clusters"]).collect()
    assert sorted(r["permalink"] for r in members) == [str(10000000 + i) for i in range(5)]
    assert spark.read.option("header", True).csv(paths["cluster_keywords"]).count() == 2
