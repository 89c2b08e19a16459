import pytest
from pyspark.sql import functions as F

from textcluster.operators import features as fe
from textcluster.operators import tokens as tk
from textcluster.operators import vectors as vz

EXPECTED = {
    (0, "aa"): 0.724500, (0, "bb"): 0.275500, (1, "bb"): 0.5, (1, "cc"): 0.5, (2, "cc"): 0.431988, (2, "dd"): 0.568012,
}
PARAMS = fe.TfidfParams(min_df=0.0, max_df=1.0, stop_words=())


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(0, "aa bb aa"), (1, "bb cc"), (2, "cc dd")], "doc_id long, content string")


def test_hand_checked_example(docs):
    tf = tk.term_freq(docs, stop_words=())
    n = fe.doc_count(docs)
    idf = fe.idf_table(fe.vocabulary(tf, n, PARAMS), n)
    idfs = {r["term"]: r["idf"] for r in idf.collect()}
    assert idfs["aa"] == pytest.approx(1.693147, abs=1e-6) and idfs["bb"] == pytest.approx(1.287682, abs=1e-6)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in fe.tfidf_long(tf, idf, "l1").collect()}
    assert got.keys() == EXPECTED.keys()
    for k, v in EXPECTED.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


def test_vocabulary_index_alphabetical_and_df_bounds(docs):
    tf = tk.term_freq(docs, stop_words=())
    n = fe.doc_count(docs)
    voc = fe.vocabulary(tf, n, fe.TfidfParams(min_df=0.5, max_df=1.0, stop_words=())).orderBy("term_idx").collect()
    assert [(r["term_idx"], r["term"]) for r in voc] == [(0, "bb"), (1, "cc")]
    capped = fe.vocabulary(tf, n, fe.TfidfParams(min_df=0.0, max_df=1.0, max_features=2, stop_words=())).collect()
    assert sorted(r["term"] for r in capped) == ["aa", "bb"]  # cf 2, 2, 2, 1: ties by term


def test_ml_vectors_equal_long_form(docs):
    vec = vz.fit_tfidf(docs, PARAMS)
    assert vec.vocabulary == ["aa", "bb", "cc", "dd"]
    rows = vec.transform(docs, keep=("doc_id",)).collect()
    for r in rows:
        v = r["features"]
        for i, w in zip(v.indices, v.values):
            assert w == pytest.approx(EXPECTED[(r["doc_id"], vec.vocabulary[i])], abs=1e-6)


def test_l1_rows_sum_to_one_or_zero(spark):
    docs = spark.createDataFrame([(0, "aa bb"), (1, "the and"), (2, "cc cc aa")], "doc_id long, content string")
    vec = vz.fit_tfidf(docs, fe.TfidfParams(min_df=0.0, max_df=1.0))
    sums = {r["doc_id"]: float(sum(abs(x) for x in r["features"].values)) for r in vec.transform(docs).collect()}
    assert sums[1] == 0.0 and sums[0] == pytest.approx(1.0) and sums[2] == pytest.approx(1.0)


def test_hashing_vectors_normalised(docs):
    vec = vz.fit_vectorizer(docs, "hashing", PARAMS)
    stats = vz.vector_stats(vec.transform(docs, keep=("doc_id",))).collect()
    assert all(r["l1"] == pytest.approx(1.0) for r in stats)
    with pytest.raises(ValueError):
        vec.vocabulary_df(docs.sparkSession)


def test_unknown_vectorizer_rejected(docs):
    with pytest.raises(ValueError):
        vz.fit_vectorizer(docs, "bogus")


def test_term_freq_independent_of_partitioning(spark, docs):
    a = sorted(tk.term_freq(docs.repartition(1), stop_words=()).collect())
    b = sorted(tk.term_freq(docs.repartition(3), stop_words=()).collect())
    assert a == b and sum(r["tf"] for r in a) == 7
    assert tk.term_freq(docs, stop_words=()).where(F.col("tf") > 1).count() == 1


def test_term_stats_without_text_exchange_equal_per_document_path(docs):
    a = sorted(tk.term_stats(tk.term_freq(docs, stop_words=())).collect())
    b = sorted(tk.term_stats_from_docs(docs, stop_words=()).collect())
    assert a == b
    assert {r["term"]: (r["df"], r["cf"]) for r in b} == {"aa": (1, 2), "bb": (2, 2), "cc": (2, 2), "dd": (1, 1)}
