import pytest

from textcluster.operators import clean as cn
from textcluster.operators import parse as ps
from textcluster.sources.xml import read_xml_records

REC = (
    '<PubmedArticle><MedlineCitation><PMID Version="1">11111111</PMID><Article>'
    "<ArticleTitle>Title <i>one</i> A</ArticleTitle>"
    '<Abstract><AbstractText Label="BG">p &lt; 0.05, H<sub>2</sub>O.</AbstractText>'
    "<AbstractText>Second.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
)


def test_fields_markup_and_entities():
    title, content, pid, err = ps.parse_xml_record(REC)
    assert (title, content, pid, err) == ("Title one A", "p < 0.05, H 2 O. Second.", "11111111", None)


def test_own_id_wins_over_cited_id():
    rec = (
        "<PubmedArticle><MedlineCitation><PMID>22222222</PMID><Article><ArticleTitle>T</ArticleTitle></Article>"
        "<CommentsCorrectionsList><CommentsCorrections><PMID>33333333</PMID></CommentsCorrections>"
        "</CommentsCorrectionsList></MedlineCitation></PubmedArticle>"
    )
    assert ps.parse_xml_record(rec)[2] == "22222222"


def test_malformed_sets_error():
    t, c, p, err = ps.parse_xml_record("<PubmedArticle><MedlineCitation><PMID>1</PMID></PubmedArticle>")
    assert err.startswith("malformed") and (t, c, p) == (None, None, None)


@pytest.fixture()
def cases(spark):
    recs = {
        "full": REC,
        "no_abstract": "<PubmedArticle><PMID>44444444</PMID><ArticleTitle>Only title</ArticleTitle></PubmedArticle>",
        "nothing": "<PubmedArticle><PMID>55555555</PMID></PubmedArticle>",
        "no_id": "<PubmedArticle><ArticleTitle>T</ArticleTitle><Abstract>A</Abstract></PubmedArticle>",
        "no_title": "<PubmedArticle><PMID>66666666</PMID><Abstract>Body</Abstract></PubmedArticle>",
        "empty_abstract": "<PubmedArticle><PMID>77777777</PMID><ArticleTitle>T</ArticleTitle><Abstract></Abstract></PubmedArticle>",
        "bad": "<PubmedArticle><PMID>8</PubmedArticle>",
    }
    df = spark.createDataFrame(list(recs.items()), "seq string, record string")
    return ps.parse_xml(df, keep=("seq",))


def test_cleaning_rules(cases):
    got = {r["seq"]: r for r in cn.finalize(cases, require_title=True).collect()}
    assert got["full"]["reject_reason"] is None
    assert got["no_abstract"]["content"] == "Only title" and got["no_abstract"]["title_as_content"]
    assert got["nothing"]["reject_reason"] == "missing_title_and_content"
    assert got["no_id"]["reject_reason"] == "missing_id"
    assert got["no_title"]["reject_reason"] == "missing_title"
    assert got["empty_abstract"]["content"] == "" and got["empty_abstract"]["reject_reason"] is None
    assert got["bad"]["reject_reason"].startswith("malformed")


def test_titleless_kept_without_require_title(cases):
    got = {r["seq"]: r for r in cn.finalize(cases, require_title=False).collect()}
    assert got["no_title"]["reject_reason"] is None and got["no_title"]["content"] == "Body"


def test_counts(cases):
    row = cn.ingest_counts(cn.finalize(cases)).first()
    assert (row["n_read"], row["n_valid"], row["n_rejected"]) == (7, 3, 4)


def test_file_scan_ignores_ids_outside_records_and_attributes(spark, tmp_dir):
    import os

    os.makedirs(tmp_dir, exist_ok=True)
    body = (
        '<?xml version="1.0"?>\n<PubmedArticleSet>\n'
        '<PubmedArticle Status="x">' + REC[len("<PubmedArticle>"):] + "\n"
        + REC + "\n<DeleteCitation><PMID>99999999</PMID></DeleteCitation>\n</PubmedArticleSet>\n"
    )
    with open(f"{tmp_dir}/a.XML", "w") as f:
        f.write(body)
    with open(f"{tmp_dir}/empty.xml", "w") as f:
        f.write("<PubmedArticleSet></PubmedArticleSet>")
    with open(f"{tmp_dir}/skip.json", "w") as f:
        f.write(REC)
    recs = read_xml_records(spark, tmp_dir)
    parsed = ps.parse_xml(recs).collect()
    assert len(parsed) == 2
    assert all(r["permalink"] == "11111111" and r["error"] is None for r in parsed)
    with pytest.raises(ValueError):
        read_xml_records(spark, tmp_dir, on_bad="error")


def test_record_scan_survives_tiny_splits(spark, tmp_dir):
    import os

    os.makedirs(tmp_dir, exist_ok=True)
    recs = "".join(
        f'<PubmedArticle><MedlineCitation><PMID>{30000000 + i}</PMID><Article><ArticleTitle>T{i}</ArticleTitle>'
        f"<Abstract><AbstractText>body &amp; text {i}</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>\n"
        for i in range(50)
    )
    with open(f"{tmp_dir}/big.xml", "w") as f:
        f.write('<?xml version="1.0"?>\n<PubmedArticleSet>\n' + recs + "</PubmedArticleSet>\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        recs_df = read_xml_records(spark, tmp_dir)
        assert recs_df.rdd.getNumPartitions() > 10
        rows = ps.parse_xml(recs_df).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r["permalink"] for r in rows) == [str(30000000 + i) for i in range(50)]
    assert all(r["error"] is None and r["content"] == f"body & text {int(r['permalink']) - 30000000}" for r in rows)
