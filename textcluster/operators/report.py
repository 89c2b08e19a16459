"""Cluster reports: centroids in long form, top terms (W3, L4, J3, C9, K9) and collation.

Fixed values (report formats):
  * ``Cluster #: {id}   Top terms: {terms}`` for k-means, ``Topic #: {id}   Top terms: {terms}`` for LDA
  * terms joined by ``, ``; member ids joined by one space, then URL-quoted after the base URL
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import join_terms, url_quote

DEFAULT_SEARCH_URL = "https://www.ncbi.nlm.nih.gov/pubmed/?term="
REPORT_FORMATS = {"kmeans": "Cluster #: %d   Top terms: %s", "lda": "Topic #: %d   Top terms: %s"}
# Ties among equal weights are broken by term; weights are compared at this many decimals so that
# sums taken in a different order still tie.
RANK_DECIMALS = 12


def centroids_long(
    weights: DataFrame, membership: DataFrame, cluster_col: str = "cluster_id", id_col: str = "doc_id"
) -> DataFrame:
    """A9 (long form): ``(cluster_col, term, weight)`` = mean of member vectors.

    A member without rows in ``weights`` is a zero vector: it counts in the denominator only.
    Aggregation is partial per task, so a cluster holding a third of all documents is combined
    map-side; the final step is keyed by (cluster, term) and spreads over terms.
    """
    sizes = membership.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n_members"))
    sums = (
        weights.join(membership.select(id_col, cluster_col), id_col)
        .groupBy(cluster_col, "term")
        .agg(F.sum("weight").alias("w_sum"))
    )
    return sums.join(sizes, cluster_col).select(
        cluster_col, "term", (F.col("w_sum") / F.col("n_members")).alias("weight")
    )


def top_terms(
    centroids: DataFrame,
    n: int = 20,
    cluster_col: str = "cluster_id",
    clusters: DataFrame | None = None,
    vocab: DataFrame | None = None,
) -> DataFrame:
    """``(cluster_col, keywords)``: the ``n`` heaviest terms of each centroid, joined by ``, ``.

    Order: weight descending, then term ascending. A centroid row is dense over the vocabulary, so a
    cluster with fewer than ``n`` non-zero terms is filled with zero-weight terms in term order
    (needs ``vocab``); every cluster in ``clusters`` gets a row, empty ones included.
    """
    win = Window.partitionBy(cluster_col).orderBy(F.round("weight", RANK_DECIMALS).desc(), F.col("term").asc())
    ranked = (
        centroids.where(F.col("weight") != 0)
        .withColumn("rk", F.row_number().over(win))
        .where(F.col("rk") <= n)
    )
    tops = ranked.groupBy(cluster_col).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rk", "term"))), lambda x: x["term"]).alias("top")
    )
    if clusters is not None:
        tops = clusters.select(cluster_col).join(tops, cluster_col, "left")
    tops = tops.withColumn("top", F.coalesce(F.col("top"), F.array().cast("array<string>")))
    top = F.col("top")
    if vocab is not None:
        # The first n vocabulary terms (a scalar subquery of at most n terms) hold every
        # zero-weight term a cluster can need.
        fill = vocab.orderBy("term").limit(n).agg(F.sort_array(F.collect_list("term")).alias("f")).scalar()
        tops = tops.withColumn("fill", F.coalesce(fill, F.array().cast("array<string>")))
        top = F.slice(F.concat(top, F.filter(F.col("fill"), lambda t: ~F.array_contains(F.col("top"), t))), 1, n)
    return tops.select(cluster_col, join_terms(top).alias("keywords"))


def report_lines(keywords: DataFrame, model: str = "kmeans", cluster_col: str = "cluster_id") -> DataFrame:
    """K9: one printable line per cluster or topic."""
    if model not in REPORT_FORMATS:
        raise ValueError(f"model must be one of {sorted(REPORT_FORMATS)}")
    return keywords.select(
        cluster_col, F.format_string(REPORT_FORMATS[model], F.col(cluster_col), F.col("keywords")).alias("line")
    )


def collate(
    membership: DataFrame,
    k: int,
    base_url: str = DEFAULT_SEARCH_URL,
    page_size: int = 100000,
    order_col: str = "seq",
    cluster_col: str = "cluster_id",
    id_col: str = "permalink",
) -> DataFrame:
    """``(cluster_id, page, clickable_content)``: the members of each cluster 0..k-1 as one search
    URL, in ``order_col`` order; an empty cluster gives the bare base URL.

    A cluster of up to ``page_size`` members is one row (page 0). Larger clusters are cut into pages
    of ``page_size`` members so that no task ever holds a whole cluster: members are ranked inside
    fixed-width ``order_col`` buckets, and bucket offsets come from per-bucket counts.
    ``order_col`` must be a unique integer key.
    """
    m = membership.select(
        F.col(cluster_col).cast("int").alias("cluster_id"),
        F.col(order_col).cast("bigint").alias("ord"),
        F.col(id_col).cast("string").alias("member"),
    ).withColumn("bucket", F.floor(F.col("ord") / F.lit(page_size)))
    counts = m.groupBy("cluster_id", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("cluster_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cluster_id", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("cluster_id", "bucket").orderBy("ord"))
    ranked = m.withColumn("local_rank", local).join(offsets, ["cluster_id", "bucket"])
    paged = ranked.withColumn("page", F.floor((F.col("offset") + F.col("local_rank") - 1) / F.lit(page_size)))
    urls = paged.groupBy("cluster_id", "page").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "member"))), lambda x: x["member"]), " ")
        .alias("ids")
    )
    full = urls.select(
        "cluster_id",
        F.col("page").cast("bigint").alias("page"),
        F.concat(F.lit(base_url), url_quote(F.col("ids"))).alias("clickable_content"),
    )
    all_ids = m.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    # Non-empty clusters come from the small per-bucket counts, not from the URLs.
    empty = all_ids.join(counts.select("cluster_id"), "cluster_id", "left_anti").select(
        "cluster_id", F.lit(0).cast("bigint").alias("page"), F.lit(base_url).alias("clickable_content")
    )
    in_range = full.where((F.col("cluster_id") >= 0) & (F.col("cluster_id") < k))
    return in_range.unionByName(empty)


def url_for(ids: Column, base_url: str = DEFAULT_SEARCH_URL) -> Column:
    """C8 on its own: base URL + quoted text."""
    return F.concat(F.lit(base_url), url_quote(ids))
