"""k-means building blocks on dense vectors (W5, A9, A10, M6) and on sparse tf-idf vectors.

Dense vectors are ``array<double|float>`` columns. Centroids are a k x d table; k is a parameter,
so the table is small by construction. It reaches the tasks as one scalar-subquery value (computed
once per query), and each row finds its nearest centroid in place: no join, no shuffle of vectors.
Centroid updates aggregate partially per task over (cluster, dim), so a cluster holding a third of
all vectors is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def centroids_from_labels(vectors: DataFrame, cluster_col: str, vec_col: str = "embedding") -> DataFrame:
    """``(cluster_id, dim, value)`` = per-cluster mean of each dimension (dim is 0-based)."""
    return (
        vectors.select(F.col(cluster_col).cast("int").alias("cluster_id"), F.posexplode(vec_col).alias("dim", "x"))
        .groupBy("cluster_id", "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("value"))
        .select("cluster_id", F.col("dim").cast("bigint").alias("dim"), "value")
    )


def centroid_value(centroids_long: DataFrame) -> Column:
    """The centroid table as one value ``array<struct<cluster_id int, c array<double>>>`` (a scalar
    subquery, evaluated once). Dimensions are ordered by ``dim``; clusters by id."""
    per_cluster = centroids_long.groupBy("cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda e: e["value"]).alias("c")
    )
    return per_cluster.agg(F.sort_array(F.collect_list(F.struct("cluster_id", "c"))).alias("cs")).scalar()


def nearest(vec: Column, centroids: Column) -> Column:
    """``struct<dist2 double, cluster_id int>`` of the closest centroid (ties: smaller id)."""
    dists = F.transform(
        centroids,
        lambda c: F.struct(
            F.aggregate(
                F.zip_with(vec, c["c"], lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
                F.lit(0.0),
                lambda s, x: s + x,
            ).alias("dist2"),
            c["cluster_id"].alias("cluster_id"),
        ),
    )
    return F.array_min(dists)


def assign(vectors: DataFrame, centroids_long: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """M6: ``(id_col, cluster_id, dist2)`` for every vector."""
    cs = centroid_value(centroids_long)
    best = vectors.select(id_col, vec_col).withColumn("cs", cs).select(id_col, nearest(F.col(vec_col), F.col("cs")).alias("b"))
    return best.select(id_col, F.col("b.cluster_id").alias("cluster_id"), F.col("b.dist2").alias("dist2"))


def inertia(assigned: DataFrame) -> DataFrame:
    """A10: ``(n_vectors, inertia)`` = count and sum of squared distances to the nearest centroid."""
    return assigned.agg(F.count(F.lit(1)).alias("n_vectors"), F.sum("dist2").alias("inertia"))


def lloyd_step(vectors: DataFrame, centroids_long: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id"):
    """One Lloyd iteration: assign to ``centroids_long`` and recompute means, in one pass over the
    vectors (assignment and the new sums come from the same row); the k x d means are then joined to
    the old centroids, so a cluster that loses every member keeps its own. Returns
    ``(new_centroids, cost)``; computing the cost is a pass of its own."""
    cs = centroid_value(centroids_long)
    scored = vectors.select(id_col, vec_col).withColumn("cs", cs).select(
        vec_col, nearest(F.col(vec_col), F.col("cs")).alias("b")
    )
    new = (
        scored.select(F.col("b.cluster_id").alias("cluster_id"), F.posexplode(vec_col).alias("dim", "x"))
        .groupBy("cluster_id", "dim")
        .agg(F.avg(F.col("x").cast("double")).alias("value"))
        .select("cluster_id", F.col("dim").cast("bigint").alias("dim"), "value")
    )
    cost = scored.agg(F.sum("b.dist2").alias("inertia"))
    old = centroids_long.select("cluster_id", "dim", F.col("value").alias("old"))
    moved = old.join(new, ["cluster_id", "dim"], "left")
    return moved.select("cluster_id", "dim", F.coalesce("value", "old").alias("value")), cost
