from textcluster.operators import counts as ct
from textcluster.operators import report as rp

BASE = "https://example.org/?term="


def test_collate_example(spark):
    mem = spark.createDataFrame(
        [(0, 0, "10000000"), (2, 1, "10000001"), (0, 2, "10000002")], "cluster_id int, seq long, permalink string"
    )
    got = {r["cluster_id"]: r["clickable_content"] for r in rp.collate(mem, 3, BASE).collect()}
    assert got == {0: BASE + "10000000%2010000002", 1: BASE, 2: BASE + "10000001"}


def test_collate_pages_never_hold_more_than_page_size(spark):
    mem = spark.createDataFrame([(0, i, str(i)) for i in range(7)], "cluster_id int, seq long, permalink string")
    rows = sorted((r["page"], r["clickable_content"]) for r in rp.collate(mem, 1, BASE, page_size=3).collect())
    assert rows == [(0, BASE + "0%201%202"), (1, BASE + "3%204%205"), (2, BASE + "6")]


def test_top_terms_ties_zero_fill_and_report(spark):
    cents = spark.createDataFrame(
        [(0, "b", 0.5), (0, "a", 0.5), (0, "c", 0.9), (1, "z", 0.1)], "cluster_id int, term string, weight double"
    )
    vocab = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "c", "y", "z"])], "term_idx long, term string")
    clusters = spark.range(3).selectExpr("cast(id as int) as cluster_id")
    kw = {r["cluster_id"]: r["keywords"] for r in rp.top_terms(cents, 3, clusters=clusters, vocab=vocab).collect()}
    assert kw == {0: "c, a, b", 1: "z, a, b", 2: "a, b, c"}
    lines = rp.report_lines(rp.top_terms(cents, 2), "kmeans").orderBy("cluster_id").collect()
    assert lines[0]["line"] == "Cluster #: 0   Top terms: c, a"


def test_part_numbers_example(spark):
    df = spark.range(10).withColumnRenamed("id", "seq")
    parts = {r["seq"]: r["part"] for r in ct.with_parts(df, "seq", 3).collect()}
    assert [parts[i] for i in range(10)] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_dense_index_with_gaps_and_small_buckets(spark):
    keys = [5, 17, 18, 40, 41, 99, 1000]
    df = spark.createDataFrame([(k,) for k in keys], "seq long")
    got = sorted((r["seq"], r["idx"]) for r in ct.dense_index(df, "seq").collect())
    assert got == [(k, i) for i, k in enumerate(keys)]
    totals = ct.part_counts(ct.with_parts(spark.range(10).withColumnRenamed("id", "seq"), "seq", 3)).orderBy("part")
    assert [(r["part"], r["n_docs"], r["running_total"]) for r in totals.collect()] == [(1, 4, 4), (2, 3, 7), (3, 3, 10)]


def test_collate_pages_cross_bucket_boundaries(spark):
    # Cluster 0 members at sparse keys; with page_size 4 the buckets are {0,1}, {5,6,7}, {12},
    # so the first page spans two buckets. Cluster 1 interleaves and cluster 2 is empty.
    rows = [(0, o, f"a{o}") for o in (0, 1, 5, 6, 7, 12)] + [(1, o, f"b{o}") for o in (2, 3, 4, 8, 9)]
    mem = spark.createDataFrame(rows, "cluster_id int, seq long, permalink string")
    got = sorted((r["cluster_id"], r["page"], r["clickable_content"]) for r in rp.collate(mem, 3, BASE, page_size=4).collect())
    assert got == [
        (0, 0, BASE + "a0%20a1%20a5%20a6"),
        (0, 1, BASE + "a7%20a12"),
        (1, 0, BASE + "b2%20b3%20b4%20b8"),
        (1, 1, BASE + "b9"),
        (2, 0, BASE),
    ]
